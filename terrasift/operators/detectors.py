"""Rule detectors over site series, each with whether it could be computed at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.baseline import by_site, delta, lag_exact, with_robust_trail, zscore

#: Fixed values of the detectors.
V5_SCALE = {"ndvi": 0.0683, "swir": 0.0384, "z": 1.0867}
V5_WEIGHT = {"ndvi": -1.0, "swir": 1.0, "z": 0.35}
V5_THRESHOLD, V5_MIN_VALID = 2.2, 0.60


def threshold_rule(d_ndbi: Column, d_swir: Column) -> Column:
    return (d_ndbi >= 0.04) | ((d_ndbi >= 0.02) & (d_swir >= 0.03))


def with_detectors(series: DataFrame) -> DataFrame:
    """Adds ``v1, v3, v4, v5, prod_raw`` and ``<name>_ok`` to (uid, ord, ndvi, ndbi, swir, valid_frac)."""
    no = F.lit(False)
    s = with_robust_trail(series, "ndbi", -6, -1, "near")
    s = with_robust_trail(s, "ndbi", -7, -2, "gap")
    for c in ("ndbi", "swir", "ndvi"):
        s = s.withColumn(f"d1_{c}", delta(c, 1)).withColumn(f"d3_{c}", delta(c, 3))
    s = s.withColumn("yoy", F.col("ndbi") - lag_exact("ndbi", 24))
    year = by_site().rangeBetween(-12, -1)
    for c in ("ndvi", "ndbi"):
        s = s.withColumn(f"n_{c}", F.count(c).over(year)).withColumn(f"z_{c}", zscore(F.col(c), F.avg(c).over(year), F.stddev_pop(c).over(year)))
    s = s.withColumn("top_ndvi", F.max("ndvi").over(year))
    rule = threshold_rule(F.col("d1_ndbi"), F.col("d1_swir"))
    stepped = F.col("d1_ndbi").isNotNull() & F.col("d1_swir").isNotNull()
    z_near = F.when(F.col("near_sigma") > 1e-6, (F.col("ndbi") - F.col("near_median")) / F.col("near_sigma"))
    z_gap = (F.col("ndbi") - F.col("gap_median")) / F.greatest("gap_sigma", F.lit(0.005))
    v3 = (rule | F.coalesce((z_near >= 2.5) & (F.col("d1_ndbi") > 0), no)) & F.coalesce(F.col("yoy") >= 0.02, F.lit(True))
    veto = (F.col("d1_ndbi") < 0.04) & F.coalesce(F.col("yoy") < 0, no)
    clearing = F.coalesce((F.col("d1_ndvi") <= -0.05) & (F.col("d1_ndbi") >= 0.015), no)
    v4 = ~veto & (rule | F.coalesce((z_gap >= 2.5) & (F.col("d1_ndbi") >= 0.01), no) | clearing)
    v5_ok = F.coalesce(F.col("valid_frac") >= V5_MIN_VALID, F.lit(True)) & F.col("d3_ndvi").isNotNull() & F.col("d3_swir").isNotNull()
    score = (
        V5_WEIGHT["ndvi"] * F.col("d3_ndvi") / V5_SCALE["ndvi"]
        + V5_WEIGHT["swir"] * F.col("d3_swir") / V5_SCALE["swir"]
        + V5_WEIGHT["z"] * F.coalesce(z_gap, F.lit(0.0)) / V5_SCALE["z"]
    )
    prod_ok = (F.col("n_ndvi") >= 3) & (F.col("n_ndbi") >= 3) & F.col("z_ndvi").isNotNull() & F.col("z_ndbi").isNotNull()
    composite = (0.40 * -F.col("z_ndvi") + 0.35 * F.col("z_ndbi")) / 0.75
    green = F.col("top_ndvi") >= 0.4
    alone = F.when(green, (F.col("z_ndvi") < -2.5) & (F.col("z_ndbi") > 2.5)).otherwise(F.col("z_ndbi") > 2.5)
    made = {
        "v1": (stepped, rule), "v3": (stepped, v3), "v4": (stepped, v4), "v5": (v5_ok, score >= V5_THRESHOLD), "prod_raw": (prod_ok, (composite > 2.0) | alone),
    }
    for name, (ok, fired) in made.items():
        s = s.withColumn(f"{name}_ok", F.coalesce(ok, no)).withColumn(name, F.coalesce(ok & fired, no))
    return s


def first_flags(detected: DataFrame, targets: DataFrame, lo: int = -8, hi: int = 8, persist: int = 4) -> DataFrame:
    """uid, detector, first_offset, n_computable in a window around each target.

    The production detector needs three raw flags within ``persist`` periods, counted
    from the start of the window.
    """
    near = detected.join(F.broadcast(targets) if targets.isLocal() else targets, "uid").withColumn("off", F.col("ord") - F.col("target")).where(F.col("off").between(lo, hi))
    recent = F.sum(F.col("prod_raw").cast("int")).over(by_site().rangeBetween(-persist, 0))
    near = near.withColumn("prod", F.col("prod_raw_ok") & (recent >= 3)).withColumn("prod_ok", F.col("prod_raw_ok"))
    names = ("v1", "v3", "v4", "v5", "prod")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).alias("fired"), F.col(f"{n}_ok").alias("ok")) for n in names])).alias("d")
    long = near.select("uid", "off", each).select("uid", "off", "d.*")
    return long.groupBy("uid", "detector").agg(F.min(F.when(F.col("fired"), F.col("off"))).alias("first_offset"), F.count_if("ok").alias("n_computable"))


def detector_summary(flags: DataFrame, min_computable: int = 3) -> DataFrame:
    """Per detector: n, fired, within_1, early, late, median_offset."""
    off = F.col("first_offset")
    return flags.where(F.col("n_computable") >= min_computable).groupBy("detector").agg(
        F.count("*").alias("n"), F.count(off).alias("fired"), F.count_if(F.abs(off) <= 1).alias("within_1"),
        F.count_if(off < -1).alias("early"), F.count_if(off > 1).alias("late"), F.median(off).alias("median_offset"),
    )


def ranked_first(flags: DataFrame) -> DataFrame:
    return flags.withColumn("rank", F.dense_rank().over(Window.partitionBy("detector").orderBy("first_offset")))
