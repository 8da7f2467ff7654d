"""The causal onset state machine and what is read off it.

Each site's observations, at most 24 a year, are folded in order by one
higher-order function; nothing but the site's own array is ever together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.periods import period_end, period_start
from terrasift.operators.baseline import by_site

INSUFFICIENT, NO_CHANGE, PROVISIONAL, CONFIRMED = "insufficient_evidence", "no_change", "provisional_start", "confirmed_start"

_OUT = "array<struct<ord:int,state:string,changed_now:boolean,n_clear:int,run:int,provisional:int,confirmed:int>>"


def run_causal(observations: DataFrame, keys=("uid",), confirm_n: int = 2, min_clear_history: int = 3, allow_gap: int = 1) -> DataFrame:
    """Calls for ``(keys, ord, clear, changed)``: each uses only what came up to it."""
    null = F.lit(None).cast("int")
    zero = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(0).alias("miss"), null.alias("p"), null.alias("c"), F.array().cast(_OUT).alias("out")
    )

    def step(s, o):
        clear, changed = o["clear"], o["clear"] & o["changed"]
        n = s["n"] + clear.cast("int")
        miss = F.when(~clear, s["miss"]).when(changed, 0).otherwise(s["miss"] + 1)
        broken = clear & ~changed & (s["miss"] + 1 > allow_gap)
        run = F.when(changed, s["run"] + 1).when(broken, 0).otherwise(s["run"])
        kept = F.when(broken & s["c"].isNull(), null).otherwise(s["p"])
        known = clear & (n >= min_clear_history)
        p = F.when(known & (run > 0), F.coalesce(kept, o["ord"])).otherwise(kept)
        c = F.when(known & (run >= confirm_n), F.coalesce(s["c"], p)).otherwise(s["c"])
        state = F.when(~known, INSUFFICIENT).when(run == 0, NO_CHANGE).when(run >= confirm_n, CONFIRMED).otherwise(PROVISIONAL)
        row = F.struct(
            o["ord"].alias("ord"), state.alias("state"), changed.alias("changed_now"), n.alias("n_clear"), run.alias("run"), p.alias("provisional"), c.alias("confirmed")
        )
        return F.struct(n.alias("n"), run.alias("run"), miss.alias("miss"), p.alias("p"), c.alias("c"), F.concat(s["out"], F.array(row)).cast(_OUT).alias("out"))

    ordered = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.coalesce("clear", F.lit(False)).alias("clear"), F.coalesce("changed", F.lit(False)).alias("changed"))))
    folded = observations.groupBy(*keys).agg(ordered.alias("o")).select(*keys, F.aggregate("o", zero, step, lambda s: s["out"]).alias("o"))
    return folded.select(*keys, F.explode("o").alias("r")).select(*keys, "r.*")


def first_confirmed(calls: DataFrame, keys=("uid",)) -> DataFrame:
    """keys, onset: the onset of the first confirmed call; null where there is none."""
    hit = (F.col("state") == CONFIRMED) & F.col("confirmed").isNotNull()
    return calls.groupBy(*keys).agg(F.min_by("confirmed", F.when(hit, F.col("ord"))).alias("onset"))


def latest_call(calls: DataFrame, keys=("uid",)) -> DataFrame:
    return calls.groupBy(*keys).agg(F.max("ord").alias("ord"), F.max_by("state", "ord").alias("state"))


def persistence(observations: DataFrame, confirm_n: int = 2, keys=("uid",)) -> DataFrame:
    """Share of changed looks among the last ``confirm_n + 1`` clear ones; null below two."""
    looks = Window.partitionBy(*keys).orderBy("ord").rowsBetween(-confirm_n, 0)
    c = observations.where("clear")
    share = F.bround(F.avg(F.col("changed").cast("int")).over(looks), 3)
    return c.select(*keys, "ord", F.when(F.count("*").over(looks) >= 2, share).alias("persistence"))


def running_max(series: DataFrame, column: str) -> DataFrame:
    """The largest value up to each row."""
    upto = by_site().rowsBetween(Window.unboundedPreceding, 0)
    return series.select("uid", "ord", F.max(column).over(upto).alias("so_far"))


def start_interval(calls: DataFrame, wide: int = 45) -> DataFrame:
    """uid, last_unchanged, first_changed, their dates, width_days, is_bounded, n_clear_before, n_clear_after, notes.

    The first sighting is the first provisional or confirmed call, even one withdrawn
    later; it is dated to its provisional period. The interval goes from the first day of the last
    unchanged period to the first day after the first changed one.
    """
    seen = F.col("state").isin(PROVISIONAL, CONFIRMED)
    first = calls.groupBy("uid").agg(F.min_by(F.coalesce("provisional", "ord"), F.when(seen, F.col("ord"))).alias("first_changed"))
    quiet = ~F.col("changed_now") & (F.col("state") != INSUFFICIENT)
    before = quiet & (F.col("ord") < F.col("first_changed"))
    d = (
        calls.join(first, "uid")
        .groupBy("uid", "first_changed")
        .agg(F.max(F.when(before, F.col("ord"))).alias("last_unchanged"), F.count_if(quiet).alias("n_clear_before"), F.count_if("changed_now").alias("n_clear_after"))
    )
    lo, hi = F.col("last_unchanged"), F.col("first_changed")
    d = d.withColumns({"last_unchanged_date": period_start(lo), "first_changed_date": period_end(hi), "is_bounded": lo.isNotNull() & hi.isNotNull()})
    d = d.withColumn("width_days", F.datediff("first_changed_date", "last_unchanged_date"))
    width = F.concat(F.lit("bracket is "), F.col("width_days").cast("string"), F.lit(" days wide — cloud-limited; do not score this site to the fortnight"))
    notes = F.array_compact(
        F.array(
            F.when(hi.isNull(), "no change ever detected: interval is open at the right"),
            F.when(lo.isNull() & hi.isNotNull(), "no confirmed-unchanged observation before the first change: interval is open at the left, the start may predate the record"),
            F.when(F.col("width_days") > wide, width),
        )
    )
    return d.withColumn("notes", notes)


def interval_contains(interval: DataFrame, at: str) -> DataFrame:
    """Adds ``contains``: at in (last_unchanged, first_changed]; false where a side is open."""
    held = (F.col(at) > F.col("last_unchanged")) & (F.col(at) <= F.col("first_changed"))
    return interval.withColumn("contains", F.when(F.col("last_unchanged").isNotNull() & F.col("first_changed").isNotNull(), held).otherwise(False))


def interval_agrees(interval: DataFrame, reported: str, tolerance: int = 0) -> DataFrame:
    """Adds ``agrees``: whether a reported period is in the interval widened on both sides; null where either is missing."""
    lo, hi = F.col("last_unchanged") - tolerance, F.col("first_changed") + tolerance
    return interval.withColumn("agrees", (F.col(reported) > lo) & (F.col(reported) <= hi))


def ring_gate(zone: DataFrame, ring: DataFrame, ratio=1.0, mmu: float = 8000.0) -> DataFrame:
    """Observations in which the zone changes as much as its ring times ``ratio``; periods that both have.

    Several ratios add a key ``ratio``: a sweep is one more column.
    """
    z = zone.select("uid", "ord", F.coalesce("pct", F.lit(0.0)).alias("zp"), F.coalesce("area", F.lit(0.0)).alias("za"))
    r = ring.select("uid", "ord", F.coalesce("pct", F.lit(0.0)).alias("cp"))
    both, keys = z.join(r, ["uid", "ord"]), ["uid", "ord"]
    if not isinstance(ratio, (int, float)):
        both, keys, ratio = both.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratio]))), ["ratio", *keys], F.col("ratio")
    return both.select(*keys, F.lit(True).alias("clear"), ((F.col("za") >= mmu) & (F.col("zp") >= ratio * F.col("cp"))).alias("changed"))
