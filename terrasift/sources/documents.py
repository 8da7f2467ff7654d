"""JSON documents: grids, features, plan layers, lookups; header-based CSV inputs; what is written back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.periods import lenient_date, ordinal_of_name
from terrasift.operators.geometry import parts_of
from terrasift.operators.rules import plan_type

_SHAPE = "struct<type:string,coordinates:string>"
GRID_SCHEMA = (
    "uid string, name string, state string, area_ha double, n_buildings int, start_period string, start_is_pseudo boolean, class_label string, bbox array<double>, width int, height int, "
    f"res_m_x double, res_m_y double, periods array<string>, lat double, lon double, geometry {_SHAPE}, aoi_geometry {_SHAPE}, outer_buffer_m double, "
    f"aoi struct<analysis_zones:map<string,{_SHAPE}>,footprint_kind:string>, aoi_provenance struct<aoi_source:string,aoi_needs_tiling:boolean,tile_px:int,tile_overlap_px:int>"
)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """One row a grid document (``*/grid.json``): its columns, ``slug`` (its folder) and ``parts`` of its geometry."""
    d = spark.read.schema(GRID_SCHEMA).option("multiLine", True).json(path).withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    box = {n: F.get("bbox", F.lit(i)) for i, n in enumerate(("west", "south", "east", "north"))}
    return d.withColumns({**box, "parts": parts_of(F.col("geometry.type"), F.col("geometry.coordinates"))})


def zones_of(grids: DataFrame) -> DataFrame:
    """uid, zone, parts of the zones that a grid document holds."""
    return grids.select("uid", F.explode("aoi.analysis_zones").alias("zone", "shape")).select("uid", "zone", parts_of(F.col("shape.type"), F.col("shape.coordinates")).alias("parts"))


FEATURE_SCHEMA = (
    "site struct<uid:string,name:string,state:string,start_period:string>, records array<struct<period:string,zone:string,zone_area_m2:double,n_valid_px:int,veg_loss_area_m2:double,new_soil_area_m2:double,"
    "new_high_albedo_area_m2:double,total_changed_area_m2:double,pct_zone_affected:double,n_components:int,largest_component_m2:double,largest_component_compactness:double,"
    "largest_component_rectangularity:double,dist_to_building_m:double,dist_to_point_m:double,persistence:double,prior_veg_loss_m2:double,detection_state:string,provisional_period:string,confirmed_period:string,stage_pct:int>>"
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the feature documents: uid, start (ordinal), zone, ord and the record's columns. Of records alike in uid, zone and period the last stays."""
    d = spark.read.schema(FEATURE_SCHEMA).option("multiLine", True).json(path)
    r = d.select(F.col("site.uid").alias("uid"), ordinal_of_name(F.col("site.start_period")).alias("start"), F.posexplode("records").alias("at", "r"))
    r = r.select("uid", "start", "at", "r.*").withColumn("ord", ordinal_of_name(F.col("period")))
    last = r.groupBy("uid", "zone", "ord").agg(F.max("at").alias("at"))
    return r.join(last, ["uid", "zone", "ord", "at"]).drop("at")


PLAN_SCHEMA = (
    "layers array<struct<key:string,campus_uid:string,name:string,sheet:string,sheet_date:string,document_date:string,revision_date:string,public_date:string,filing_date:string,plan_type:string,"
    "fit:struct<residual_m:double,jackknife_p90_m:double>,features:array<struct<ring:array<array<double>>>>>>"
)


def read_plan_layers(spark: SparkSession, path: str) -> DataFrame:
    """One row a plan document of the index: uid, key, at, its dates, plan_type, residual, date_provenance, rings, n_rings and parts.

    Rings need four points. The sheet's date stands in for a document date; without a public or filing date the plan's date is optimistic.
    """
    layer = spark.read.schema(PLAN_SCHEMA).option("multiLine", True).json(path).select(F.posexplode("layers").alias("at", "l")).select("at", "l.*")
    has = lambda c: F.nullif(F.col(c), F.lit(""))
    day = lambda *names: lenient_date(F.trim(F.coalesce(*[has(n) for n in names])))
    rings = F.filter(F.transform(F.coalesce("features", F.array().cast("array<struct<ring:array<array<double>>>>")), lambda f: f["ring"]), lambda r: F.size(r) >= 4)
    d = layer.withColumns({"rings": rings, "_doc": day("document_date", "sheet_date"), "_rev": day("revision_date"), "_pub": day("public_date", "filing_date")})
    said = F.when(has("document_date").isNotNull(), "document_date explicit").when(has("sheet_date").isNotNull(), "document_date from sheet_date")
    notes = F.array_compact(F.array(said, F.when(F.col("_pub").isNull(), "no public/filing date known -- usable_from is optimistic")))
    return d.select(
        F.coalesce("campus_uid", F.lit("?")).alias("uid"), F.coalesce("key", F.lit("?")).alias("key"), "at", F.col("_doc").alias("document_date"), F.col("_rev").alias("revision_date"),
        F.col("_pub").alias("public_date"), plan_type(F.col("plan_type"), F.col("name"), F.col("sheet")).alias("plan_type"), F.col("fit.residual_m").alias("residual"),
        F.array_join(notes, "; ").alias("date_provenance"), F.size("rings").alias("n_rings"), F.transform("rings", lambda r: F.array(r)).alias("parts"),
    )


def read_lookup(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """key, value (text) of a JSON object of plain values, or of the object under ``field``."""
    kind = "map<string,string>" if field is None else f"struct<`{field}`:map<string,string>>"
    parsed = F.from_json("value", kind)
    return spark.read.text(path, wholetext=True).select(F.explode(parsed if field is None else parsed[field]).alias("key", "value"))


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """place, uid of a JSON list of uids."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "uid"))


def unanchored(picks: DataFrame, starts: DataFrame) -> DataFrame:
    """Picks without a verified start or a pseudo-start: there must be none before anything is fetched."""
    return picks.join(starts.where("start is not null"), "uid", "left_anti").select("uid")


def read_headed(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The named columns, as text, of those CSV files that are there and have them all, in whatever order."""
    out = None
    for path in paths:
        try:
            d = spark.read.option("header", True).csv(path)
        except AnalysisException:  # a sweep that was never run
            continue
        if set(columns) <= set(d.columns):
            out = d.select(*columns) if out is None else out.unionByName(d.select(*columns))
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)) if out is None else out


def flat_stats(rows: DataFrame, prefix: str = "", stats: tuple[str, ...] = ("std", "low", "high", "p10", "p25", "p50", "p75", "p90"), indices: tuple[str, ...] = ("ndbi", "swir", "ndvi")) -> DataFrame:
    """Scalar columns of ``rows(..., ndbi, swir, ndvi, valid_frac, sample_count, dist map<index, map<stat, value>>)``, each with a prefix."""
    plain = [c for c in rows.columns if c not in (*indices, "valid_frac", "sample_count", "dist")]
    own = [F.col(c).alias(f"{prefix}{c}") for c in (*indices, "valid_frac", "sample_count")]
    return rows.select(*plain, *own, *[F.try_element_at(F.try_element_at("dist", F.lit(i)), F.lit(k)).alias(f"{prefix}{i}_{k}") for i in indices for k in stats])


def usable_number(value: Column) -> Column:
    """Whether a JSON value (as text) is a finite number: not a boolean, not null, and not the text "NaN"."""
    return F.coalesce(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & (F.abs(value.try_cast("double")) < F.lit(float("inf"))), F.lit(False))


def write_lookup(rows: DataFrame, path: str) -> None:
    """One JSON object {key: value} of rows (key, value): a table as small as its readers take it to be."""
    rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value")).coalesce(1).write.text(path)
