"""Rule operators: stage of work, area of interest, plan availability, quality, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MMU = 8000.0
#: What a stage is called.
STAGE_LABELS = {0: "no construction", 5: "site clearing", 10: "grading and levelling", 15: "foundation work"}


def fixed(value: Column, places: int, grouped: bool = False) -> Column:
    """A number as text with so many places, halves to even."""
    return F.format_string(f"%{',' if grouped else ''}.{places}f", F.bround(value.cast("double"), places))


def foundation_signals(d: DataFrame) -> dict[str, Column]:
    """Seven signals, each false where its input is unknown."""
    f = lambda c: F.coalesce(c, F.lit(False))
    return {
        "bright_area": f(F.col("high_area") >= 2000), "connected_area": f(F.col("largest") >= MMU), "persistence": f(F.col("persistence") >= 0.6),
        "geometry": f(F.col("rectangularity") >= 0.6), "footprint_proximity": f(F.col("dist_to_building") <= 300), "prior_veg_loss": f(F.col("prior_veg_loss") >= MMU),
        "visual": f(F.col("visual")),
    }


AREAS = ("changed_area", "veg_area", "soil_area", "high_area", "largest")


def stage_classify(d: DataFrame, need_prior_loss: bool = False) -> DataFrame:
    """Adds stage_pct (null where the rules abstain), stage_group, stage_label, confidence, signals (names), n_signals; first rule that holds wins.

    Unknown areas are 0.
    """
    known = d.withColumns({f"_v_{a}": F.coalesce(F.col(a), F.lit(0.0)) for a in AREAS})
    s = foundation_signals(d)
    known = known.withColumns({f"_{k}": v for k, v in s.items()}).withColumn("n_signals", sum((F.col(f"_{k}").cast("int") for k in s), F.lit(0)))
    changed, veg, soil, n = F.col("_v_changed_area"), F.col("_v_veg_area"), F.col("_v_soil_area"), F.col("n_signals")
    quiet = (F.col("_v_largest") < MMU) & (veg < MMU)
    fleeting = F.coalesce(F.col("persistence") < 0.5, F.lit(False))
    worked = F.col("_bright_area") & (soil >= MMU)
    prior = F.col("_prior_veg_loss") if need_prior_loss else F.lit(True)
    share = F.when(changed > 0, soil / changed).otherwise(0.0)
    graded = (soil >= MMU) & (share >= 0.6) & F.coalesce(F.col("rectangularity") >= 0.55, F.lit(True))
    rule = (
        F.when(quiet, "none").when(fleeting, "fleeting").when(worked & (n >= 4) & prior, "foundation").when(worked & (n >= 2), "unresolved")
        .when(graded & F.col("_bright_area") & (n >= 2), "unresolved_pad").when(graded, "grading").when((veg >= MMU) | (soil >= MMU), "clearing").otherwise("below")
    )
    known = known.withColumn("rule", rule)
    is_ = lambda *names: F.col("rule").isin(*names)
    open_ = is_("unresolved", "unresolved_pad")
    base = F.when(is_("none"), 0.6).when(is_("fleeting"), 0.55).when(is_("foundation", "grading"), 0.6).when(open_, 0.45).otherwise(0.5)
    adjusted = (
        base + F.coalesce(0.30 * (F.col("persistence") - 0.5), F.lit(0.0)) + F.coalesce(0.20 * (F.col("rectangularity") - 0.5), F.lit(0.0)) + 0.03 * F.greatest(F.lit(0), n - 2)
        + F.when(F.col("aoi_source") == "siteplan", 0.10).when(F.col("aoi_source") == "point_box", -0.10).otherwise(0.0)
    )
    flat = is_("none", "fleeting", "below")
    pct = F.when(is_("foundation"), 15).when(is_("grading"), 10).when(is_("clearing"), 5).when(flat, 0)
    label = F.when(open_, "grading or foundation (unresolved)")
    for k, v in STAGE_LABELS.items():
        label = label.when(pct == k, v)
    out = known.withColumns(
        {
            "stage_pct": pct, "stage_group": F.when(open_, "10-15"), "stage_label": label,
            "confidence": F.when(flat, base).otherwise(F.bround(F.greatest(F.lit(0.05), F.least(F.lit(0.95), adjusted)), 3)),
            "signals": F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in s])),
        }
    )
    return out.drop(*[f"_{k}" for k in s], *[f"_v_{a}" for a in AREAS])


# ------------------------------------------------------------------ site plans

PLAN_TYPES = ("masterplan", "phase", "as_built", "unknown")


def plan_type(explicit: Column, name: Column, sheet: Column | None = None) -> Column:
    """An explicit type that is known, else what the name and sheet say."""
    own = F.lower(F.trim(explicit))
    t = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(sheet, F.lit("")) if sheet is not None else F.lit("")))
    return (
        F.when(own.isin(*PLAN_TYPES), own).when(t.contains("as-built") | t.contains("as built"), "as_built")
        .when(t.contains("phase"), "phase").when(t.contains("master") | t.contains("overall"), "masterplan").otherwise("unknown")
    )


def plan_gate(policy: str = "strict") -> Column:
    """The date that gates a plan. strict: all its dates are past; relaxed: the earlier paper date, or what there is."""
    known = F.greatest("document_date", "revision_date", "public_date")
    return known if policy == "strict" else F.coalesce(F.least("document_date", "revision_date"), known)


def plan_refusal(observed: Column, policy: str = "strict") -> Column:
    """Why a plan may not be used at a look (null: it may)."""
    gate = plan_gate(policy)
    late = F.concat(F.lit(f"{policy}: usable_from "), gate.cast("string"), F.lit(" postdates observation "), observed.cast("string"))
    return (
        F.when(F.col("plan_type") == "as_built", "as-built plan: records what was built, circular").when(F.col("n_rings") < 1, "no building rings")
        .when(gate.isNull(), "no usable date on the sheet").when(observed.isNotNull() & (gate > observed), late)
    )


def plan_usable_from(policy: str = "strict") -> Column:
    """Date from which a plan may be used at all; null: never."""
    return F.when((F.col("plan_type") != "as_built") & (F.col("n_rings") > 0), plan_gate(policy))


def plan_as_of(plans: DataFrame, looks: DataFrame, policy: str = "strict", residual_hard: float = 60.0) -> DataFrame:
    """uid, obs_date, plan: the plan usable last before each look, of those fitted well enough."""
    p = plans.withColumn("usable_from", plan_usable_from(policy)).where("usable_from is not null").where(F.coalesce(F.col("residual") <= residual_hard, F.lit(True)))
    both = looks.join(p.select("uid", "plan", "usable_from"), "uid").where(F.col("usable_from") <= F.col("obs_date"))
    return both.groupBy("uid", "obs_date").agg(F.max_by("plan", F.struct("usable_from", "plan")).alias("plan"))


def plan_candidates(plans: DataFrame, looks: DataFrame, policy: str = "strict", residual_hard: float = 60.0, residual_warn: float = 15.0) -> DataFrame:
    """What the plans of a site allow at each look: one row per (uid, obs_date) of ``looks`` whose site has a plan.

    ``plans(uid, key, at, document_date, revision_date, public_date, plan_type, residual, date_provenance, n_rings)``
    with ``at`` the place in the index. Returns plan_keys, n_footprints, siteplan_date (the
    latest of the dates known), plan_warnings in index order with refusals after them, and plan_refusal
    (the first refusal, where no plan is usable).
    """
    why = plan_refusal(F.col("obs_date"), policy)
    residual = fixed(F.col("residual"), 1)
    each = looks.join(plans, "uid").withColumn(
        "refused",
        F.when(why.isNotNull(), F.struct(why.alias("why"), F.lit("temporal leakage").alias("kind")))
        .when(F.col("residual") > residual_hard, F.struct(F.concat(F.lit("residual "), residual, F.lit(" m")).alias("why"), F.lit("unusable georeferencing").alias("kind"))),
    )
    usable = F.col("refused").isNull()
    weak = F.concat(F.lit("siteplan "), "key", F.lit(": georeferencing residual "), residual, F.lit(f" m (> {residual_warn:.0f} m)"))
    dated = F.concat(F.lit("siteplan "), "key", F.lit(": "), "date_provenance")
    notes = F.array_compact(F.array(F.when(usable & (F.col("residual") > residual_warn), weak), F.when(usable & (F.coalesce("date_provenance", F.lit("")) != ""), dated)))
    refusal = F.concat(F.lit("siteplan "), "key", F.lit(" rejected ("), "refused.kind", F.lit("): "), "refused.why")
    row = F.struct("at", "key", "n_rings", notes.alias("notes"), refusal.alias("refusal"), F.col("refused.why").alias("why"), F.greatest("document_date", "revision_date", "public_date").alias("latest"))
    held = each.groupBy("uid", "obs_date").agg(F.array_sort(F.collect_list(row)).alias("d"))
    fit = F.filter("d", lambda x: x["why"].isNull())
    return held.select(
        "uid", "obs_date", F.transform(fit, lambda x: x["key"]).alias("plan_keys"), F.aggregate(fit, F.lit(0).cast("long"), lambda t, x: t + x["n_rings"]).alias("n_footprints"),
        F.array_max(F.transform(fit, lambda x: x["latest"])).alias("siteplan_date"),
        F.concat(F.flatten(F.transform("d", lambda x: x["notes"])), F.array_compact(F.transform("d", lambda x: x["refusal"]))).alias("plan_warnings"),
        F.when(F.size(fit) == 0, F.get(F.transform("d", lambda x: x["why"]), F.lit(0))).alias("plan_refusal"),
    )


# ------------------------------------------------------------ area of interest

#: Words in a warning, what the deduction is called, and what it costs; the first that occurs counts.
DEDUCTIONS = [
    ("OUTSIDE the parcel", "point/polygon disagreement", -0.15),
    ("from the recorded point", "point/polygon disagreement", -0.15),
    ("fragmented", "fragmented parcel", -0.05),
    ("is large", "large parcel — tiled search", -0.10),
    ("residual", "weak georeferencing", -0.10),
    ("optimistic", "plan availability date optimistic", -0.05),
]


def coordinate_quality(confirmed: Column, lat: Column, lon: Column) -> Column:
    return F.when(F.coalesce(confirmed, F.lit(False)), "confirmed").when(lat.isNotNull() & lon.isNotNull(), "approximate").otherwise("inferred")


def aoi_deductions(coordinates: Column, warnings: Column) -> Column:
    """Itemised array of (what, cost): the coordinate's first, then one for each warning that costs."""
    item = lambda what, cost: F.struct(F.lit(what).alias("what"), F.lit(cost).alias("cost"))
    own = F.when(coordinates == "approximate", item("coordinate approximate", -0.05)).when(coordinates == "inferred", item("coordinate inferred", -0.15))

    def cost(w):
        c = None
        for words, what, d in DEDUCTIONS:
            c = F.when(w.contains(words), item(what, d)) if c is None else c.when(w.contains(words), item(what, d))
        return c

    return F.array_compact(F.concat(F.array(own), F.transform(warnings, cost)))


def aoi_quality(source: Column, deductions: Column) -> Column:
    base = F.when(source == "siteplan", 0.9).when(source == "parcel", 0.65).otherwise(0.4)
    total = F.aggregate(deductions, base, lambda t, d: t + d["cost"])
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.0), total)), 3)


def resolve_aoi(
    sites: DataFrame,
    with_plans: bool = True,
    far_m: float = 5000.0,
    notable_m: float = 1000.0,
    large_ha: float = 150.0,
    tile_ha: float = 100.0,
    boxes: tuple[float, float] = (400.0, 1000.0),
    plan_buffer: float = 150.0,
) -> DataFrame:
    """Adds the area of interest of each site: its plan, else its parcel, else a box around its point, else null, and all that was noted on the way.

    Inputs: lat, lon, coord_confirmed, site_source (``parcel...`` or another), parcel_m2 (null: empty), parcel_valid, parcel_parts,
    parcel_inside (whether it holds the point), parcel_offset_m (from its centroid to the point); and, with plans, those of
    ``plan_candidates``, plan_m2 (null: empty union) and plan_offset_m. ``with_plans=False``: there is no plan index.

    A level is refused for unusable geometry and for lying more than ``far_m`` from the point, never for its size.
    Adds coordinate_quality, aoi_source, buffer_m, point_sizes_m, point_offset_m, needs_tiling, warnings, fallback_reason, deductions, quality.
    """
    metres = lambda c: fixed(c, 0)
    has_point = F.col("lat").isNotNull()
    none = F.array().cast("array<string>")
    if with_plans:
        off = F.when(has_point, F.col("plan_offset_m"))
        refusal = (
            F.when(F.col("plan_keys").isNull(), "no site plan for campus").when(F.size("plan_keys") == 0, F.coalesce("plan_refusal", F.lit("no usable sheet")))
            .when(F.col("plan_m2").isNull(), "footprint union empty").when(F.col("plan_m2") <= 0, "footprint area zero")
            .when(off > far_m, F.concat(F.lit("site plan centroid "), metres(off), F.lit(" m from the point — not the same place")))
        )
        notes = F.coalesce("plan_warnings", none)
        d = sites.withColumn("_plan_why", refusal).withColumn("_plan_off", off)
        far = F.when(F.col("_plan_why").isNull() & (F.col("_plan_off") > notable_m), F.concat(F.lit("site plan centroid "), metres(F.col("_plan_off")), F.lit(" m from the recorded point")))
        d = d.withColumn("_plan_notes", F.concat(notes, F.array_compact(F.array(far))))
    else:
        d = sites.withColumn("_plan_why", F.lit("no plan index supplied")).withColumn("_plan_off", F.lit(None).cast("double")).withColumn("_plan_notes", none)
    # the parcel
    source, ha = F.coalesce("site_source", F.lit("")), F.col("parcel_m2") / 1e4
    off = F.when(has_point & ~F.coalesce("parcel_inside", F.lit(False)), F.col("parcel_offset_m"))
    unusable = (
        F.when(~source.startswith("parcel"), F.concat(F.lit("no parcel geometry (aoi_source="), F.when(source == "", "none").otherwise(source), F.lit(")")))
        .when(F.col("parcel_m2").isNull(), "parcel geometry empty").when(F.col("parcel_m2") <= 0, "parcel area zero")
    )
    away = F.when(off > far_m, F.concat(F.lit("point "), metres(off), F.lit(" m outside the parcel — not the same place")))
    large = F.concat(
        F.lit("parcel is large ("), fixed(ha, 0, True), F.lit(" ha): an 8,000 m2 event is "), fixed(F.lit(8000.0) / F.col("parcel_m2") * 100, 3),
        F.lit("% of it — use the tiled component search, never the parcel mean"),
    )
    parcel_notes = F.array_compact(
        F.array(
            F.when(~F.coalesce("parcel_valid", F.lit(True)), "parcel geometry was invalid; repaired with buffer(0)"), F.when(ha > large_ha, large),
            F.when(F.col("parcel_parts") > 1, F.concat(F.lit("parcel is fragmented ("), F.col("parcel_parts").cast("string"), F.lit(" parts)"))),
            F.when(away.isNull() & off.isNotNull(), F.concat(F.lit("project point falls OUTSIDE the parcel ("), metres(off), F.lit(" m from its centroid)"))),
        )
    )
    d = d.withColumns({"_parcel_why": F.coalesce(unusable, away), "_parcel_off": off, "_parcel_notes": F.when(unusable.isNull(), parcel_notes).otherwise(none)})
    # the point
    quality = coordinate_quality(F.col("coord_confirmed"), F.col("lat"), F.col("lon"))
    small, wide = min(boxes), max(boxes)
    point_notes = F.array_compact(
        F.array(
            F.when(quality != "confirmed", F.concat(F.lit("coordinate is "), quality, F.lit(f": a {small:.0f} m box may miss the pad"))),
            F.lit(f"point AOI only — {small:.0f} m box for sensitivity (8,000 m2 = {8000 / small**2 * 100:.1f}% of it), {wide:.0f} m for discovery"),
        )
    )
    point_why = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no coordinate")
    plan, parcel = F.col("_plan_why").isNull(), F.col("_parcel_why").isNull()
    chosen = F.when(plan, "siteplan").when(parcel, "parcel").when(point_why.isNull(), "point_box")
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("siteplan: "), F.col("_plan_why")), F.when(~plan, F.concat(F.lit("parcel: "), F.col("_parcel_why"))),
            F.when(~plan & ~parcel, F.concat(F.lit("point: "), point_why)),
        )
    )
    warned = F.concat("_plan_notes", F.when(plan, none).otherwise(F.concat("_parcel_notes", F.when(~parcel & point_why.isNull(), point_notes).otherwise(none))))
    d = d.withColumns({"coordinate_quality": quality, "aoi_source": chosen, "warnings": warned, "fallback_reason": F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons))})
    src = F.col("aoi_source")
    d = d.withColumns(
        {
            "buffer_m": F.when(src == "siteplan", plan_buffer).when(src.isNotNull(), 0.0),
            "point_sizes_m": F.when(src == "point_box", F.array(F.lit(small), F.lit(wide))),
            "point_offset_m": F.when(src == "siteplan", F.col("_plan_off")).when(src == "parcel", F.col("_parcel_off")),
            "needs_tiling": F.coalesce((src == "parcel") & (ha > tile_ha), F.lit(False)),
            "deductions": aoi_deductions(F.col("coordinate_quality"), F.col("warnings")),
        }
    )
    quality = F.when(src.isNotNull(), aoi_quality(src, F.col("deductions")))
    return d.withColumn("quality", quality).drop("_plan_why", "_plan_off", "_plan_notes", "_parcel_why", "_parcel_off", "_parcel_notes")


def provenance(resolved: DataFrame, policy: str = "strict") -> Column:
    """The twelve facts that go with each record: one struct of a resolved site."""
    has = set(resolved.columns)
    get = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    plan = F.col("aoi_source") == "siteplan"
    return F.struct(
        F.col("aoi_source"), F.bround(get("aoi_m2", "double"), 1).alias("aoi_area_m2"), F.col("buffer_m").alias("aoi_buffer_m"), F.col("quality").alias("aoi_confidence"),
        F.struct(F.col("quality").alias("score"), F.col("deductions")).alias("aoi_quality"), F.col("needs_tiling").alias("aoi_needs_tiling"), F.when(plan, policy).alias("siteplan_policy"),
        F.col("coordinate_quality"), F.when(plan, get("siteplan_date", "string")).alias("siteplan_date"), F.when(F.col("aoi_source") == "parcel", get("uid", "string")).alias("parcel_id"),
        F.col("fallback_reason").alias("aoi_fallback_reason"), F.col("warnings").alias("aoi_warnings"),
    )


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
