"""Lags, trailing windows and seasonal baselines of site series.

Series are long tables keyed ``(uid, ord)``. A lag is exact: a missing
period gives null. Range frames on the integer ordinal say just that, so all lags
and trailing windows of a series share one shuffle by ``uid`` and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD = 1.4826


def by_site(*more: str):
    return Window.partitionBy("uid", *more).orderBy("ord")


def lag_exact(column: str, k: int) -> Column:
    """The value ``k`` periods before, null where that period is missing."""
    return F.max(column).over(by_site().rangeBetween(-k, -k))


def delta(column: str, k: int) -> Column:
    return F.col(column) - lag_exact(column, k)


def trailing(column: str, lo: int, hi: int) -> Column:
    """The non-null values from ``lo`` to ``hi`` periods relative to the row, sorted."""
    return F.array_sort(F.collect_list(column).over(by_site().rangeBetween(lo, hi)))


def upper_median(values: Column) -> Column:
    """``sorted[n // 2]``: not interpolated."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def with_robust_trail(series: DataFrame, column: str, lo: int, hi: int, prefix: str) -> DataFrame:
    """Adds upper median and scaled upper-median deviation of a trailing window; null below three values."""
    held, mid = f"_{prefix}_values", f"_{prefix}_mid"
    enough = F.size(held) >= 3
    s = series.withColumn(held, trailing(column, lo, hi)).withColumn(mid, upper_median(F.col(held)))
    spread = upper_median(F.array_sort(F.transform(held, lambda v: F.abs(v - F.col(mid)))))
    return (
        s.withColumn(f"{prefix}_median", F.when(enough, F.col(mid)))
        .withColumn(f"{prefix}_sigma", F.when(enough, MAD * spread))
        .drop(held, mid)
    )


def seasonal_slots(series: DataFrame, column: str, years=(1, 2, 3), tolerance: int = 1) -> DataFrame:
    """One row for each target and each earlier observation of its season.

    The interval join ``prior.ord in {t - 24 y +- tolerance}`` is an equi-join:
    each observation is exploded to the targets it can serve.
    """
    ahead = [24 * y + d for y in years for d in range(-tolerance, tolerance + 1)]
    served = F.array(*[F.col("ord") + a for a in ahead])
    prior = series.select("uid", F.explode(served).alias("ord"), F.col(column).alias("prior"))
    return series.select("uid", "ord", F.col(column).alias("value")).join(prior, ["uid", "ord"])


def seasonal_baseline(
    series: DataFrame, column: str, years=(1, 2, 3), tolerance: int = 1, sigma_floor: float = 0.04, min_slots: int = 3, robust: bool = True
) -> DataFrame:
    """uid, ord, value, centre, sigma, n_slots, z against the same season of earlier years.

    Robust: interpolated median and 1.4826 times the interpolated median deviation;
    raw: mean and population deviation. Sigma never falls below its floor.
    """
    both = anomaly_scores(series, column, years, tolerance, sigma_floor, min_slots)
    kind = "robust" if robust else "raw"
    return both.select("uid", "ord", "value", *[F.col(f"{kind}_{c}").alias(c) for c in ("centre", "sigma")], "n_slots", F.col(f"{kind}_z").alias("z"))


def middle(values: Column) -> Column:
    """The interpolated median of a sorted array."""
    n = F.size(values)
    at = lambda i: F.get(values, F.floor(i).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def anomaly_scores(series: DataFrame, column: str, years=(1, 2, 3), tolerance: int = 1, sigma_floor: float = 0.04, min_slots: int = 3) -> DataFrame:
    """uid, ord, value, n_slots and centre, sigma, z of both scores, ``robust_`` and ``raw_``, in one group-by.

    The priors of a target (at most nine by default) stand in one sorted array, whose median and median
    deviation are read off in place.
    """
    slots = seasonal_slots(series, column, years, tolerance).where("prior is not null")
    d = slots.groupBy("uid", "ord", "value").agg(F.array_sort(F.collect_list("prior")).alias("_p"), F.avg("prior").alias("raw_centre"), F.stddev_pop("prior").alias("_sd"))
    d = d.withColumn("n_slots", F.size("_p").cast("long")).where(F.col("n_slots") >= min_slots).withColumn("robust_centre", middle(F.col("_p")))
    d = d.withColumn("_d", F.array_sort(F.transform("_p", lambda v: F.abs(v - F.col("robust_centre")))))
    floor = F.lit(sigma_floor)
    d = d.withColumns({"robust_sigma": F.greatest(MAD * middle(F.col("_d")), floor), "raw_sigma": F.greatest(F.col("_sd"), floor)})
    z = lambda kind: ((F.col("value") - F.col(f"{kind}_centre")) / F.col(f"{kind}_sigma")).alias(f"{kind}_z")
    return d.select("uid", "ord", "value", "n_slots", "robust_centre", "robust_sigma", z("robust"), "raw_centre", "raw_sigma", z("raw"))


def change_mask(scored: DataFrame, k_sigma=2.5, min_delta: float = 0.10, up: bool = True) -> DataFrame:
    """Adds ``changed``: z and difference both reach their thresholds, in one direction."""
    sign = 1 if up else -1
    d = sign * (F.col("value") - F.col("centre"))
    return scored.withColumn("changed", (sign * F.col("z") >= k_sigma) & (d >= min_delta))


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-9, (value - mean) / sd)


def causal_delta(series: DataFrame, column: str, trail: int = 3, years=(1, 2)) -> DataFrame:
    """Adds ``delta``: the mean of the last periods less the mean of the same windows of earlier years, where there are any."""
    mean = lambda back: F.avg(column).over(by_site().rangeBetween(-trail - back, -back))
    controls = [mean(24 * y) for y in years]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in controls), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in controls), F.lit(0.0))
    return series.withColumn("delta", F.when(n > 0, mean(0) - total / n))


def onset_delta(series: DataFrame, anchors: DataFrame, column: str, window=(-1, 2), years=(1, 2)) -> DataFrame:
    """uid, delta: mean around each anchor less the mean of the available yearly means of the same window."""
    offsets = list(range(window[0], window[1] + 1))
    slots = anchors.select(
        "uid", F.explode(F.array(*[F.struct(F.lit(y).alias("year"), (F.col("anchor") - 24 * y + d).alias("ord")) for y in (0, *years) for d in offsets])).alias("s")
    ).select("uid", "s.year", "s.ord")
    means = slots.join(series.select("uid", "ord", column), ["uid", "ord"]).where(F.col(column).isNotNull()).groupBy("uid", "year").agg(F.avg(column).alias("m"))
    wide = means.groupBy("uid").agg(F.max(F.when(F.col("year") == 0, F.col("m"))).alias("onset"), F.avg(F.when(F.col("year") > 0, F.col("m"))).alias("control"))
    return wide.where("onset is not null and control is not null").select("uid", (F.col("onset") - F.col("control")).alias("delta"))
