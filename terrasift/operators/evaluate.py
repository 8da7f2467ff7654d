"""How well a score separates classes: AUC, lift, KS, verdicts, sweeps, bootstrap intervals."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.session import ship


def below(rows: DataFrame, order: str, values: list[str], keys=(), cuts: int = 200) -> DataFrame:
    """Adds ``under_<v>``: the sum of each value over the rows of the key with a smaller ``order`` (distinct within a key).

    Rows are dealt to ranges at approximate quantiles of the order; each range adds its own running sum to
    the totals of the ranges before it, so no task holds more than a range.
    """
    at = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), 100 * cuts)).first()[0]
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(at or []))]).cast("array<double>")
    d = rows.withColumn("_range", F.size(F.filter(bounds, lambda c: c < F.col(order))))
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_all_{v}") for v in values])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_all_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    d = d.withColumns({f"_own_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(totals, [*keys, "_range"])
    return d.withColumns({f"under_{v}": F.col(f"_own_{v}") + F.col(f"_before_{v}") for v in values}).drop("_range", *[f"_{p}_{v}" for p in ("own", "before") for v in values])


def auc(scored: DataFrame, keys=()) -> DataFrame:
    """keys, n_pos, n_neg, auc: P(positive > negative), ties one half, by mid-ranks of score groups.

    Scores are first summed by value; the running sum over distinct scores goes by ranges of them.
    """
    by_value = scored.where("score is not null").groupBy(*keys, "score").agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    pairs = below(by_value, "score", ["n"], keys)
    sums = pairs.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("under_n") + 0.5 * F.col("n"))).alias("won"))
    return sums.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def lift_at(scored: DataFrame, k: int) -> DataFrame:
    """k, precision, base, lift among the k highest scores; ties keep ``input_order``."""
    known = scored.where("score is not null")
    top = known.orderBy(F.col("score").desc(), "input_order").limit(k)
    hit = top.agg(F.count("*").alias("k"), F.avg(F.col("is_positive").cast("int")).alias("precision"))
    base = known.agg(F.avg(F.col("is_positive").cast("int")).alias("base"))
    return hit.join(base).select("k", "precision", "base", F.when(F.col("base") > 0, F.col("precision") / F.col("base")).alias("lift"))


def ks_distance(values: DataFrame) -> DataFrame:
    """ks: largest gap between the distribution functions of ``value`` in the two classes."""
    by_value = values.where("value is not null").groupBy("value").agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    total = by_value.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    d = below(by_value, "value", ["p", "n"]).join(F.broadcast(total))
    share = lambda c: (F.col(f"under_{c}") + F.col(c)) / F.nullif(F.col(f"n{c}"), F.lit(0))
    return d.select(F.abs(share("p") - share("n")).alias("gap")).agg(F.max("gap").alias("ks"))


def classify_hit(onset: Column, start: Column, hit_k: int) -> Column:
    return F.when(onset.isNull(), "never").when(onset < start - 2, "early").when(onset <= start + hit_k, "hit").otherwise("late")


def scan_summary(found: DataFrame, hit_k: int, keys=()) -> DataFrame:
    """Per key: detect, early, never, fired, fa, precision, base, lift of (onset, start, is_positive)."""
    kind = classify_hit(F.col("onset"), F.col("start"), hit_k)
    pos = F.col("is_positive")
    fired = F.col("onset").isNotNull()
    s = found.groupBy(*keys).agg(
        F.count_if(pos & (kind == "hit")).alias("detect"), F.count_if(pos & (kind == "early")).alias("early"), F.count_if(pos & (kind == "never")).alias("never"),
        F.count_if(pos & fired).alias("fired"), F.count_if(~pos & fired).alias("fa"), F.avg(pos.cast("int")).alias("base"),
    )
    s = s.withColumn("precision", F.when(F.col("fired") + F.col("fa") > 0, F.col("fired") / (F.col("fired") + F.col("fa"))))
    return s.withColumn("lift", F.when(F.col("base") > 0, F.col("precision") / F.col("base")))


def tau_summary(found: DataFrame, looks: DataFrame, hit_k: int, keys=("tau",)) -> DataFrame:
    """Per key: detect and early (shares of positives), median_lag of hits, fa (share of negatives with any confirmed call), per_window (share of
    the negatives' clear looks that are flagged), precision (hits over hits, negatives that fire and early calls).

    ``found(keys, uid, onset, start, is_positive)``; ``looks(keys, uid, clear, changed, is_positive)``.
    """
    kind, pos = classify_hit(F.col("onset"), F.col("start"), hit_k), F.col("is_positive")
    hit, early, fa = pos & (kind == "hit"), pos & (kind == "early"), ~pos & F.col("onset").isNotNull()
    s = found.groupBy(*keys).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"), F.count_if(hit).alias("_h"), F.count_if(early).alias("_e"), F.count_if(fa).alias("_f"),
        F.median(F.when(hit, F.col("onset") - F.col("start"))).alias("median_lag"),
    )
    clear = ~pos & F.coalesce("clear", F.lit(False))
    w = looks.groupBy(*keys).agg(F.count_if(clear & F.coalesce("changed", F.lit(False))).alias("_flags"), F.count_if(clear).alias("_clear"))
    over = lambda a, b: F.when(b > 0, a / b)
    called = F.col("_h") + F.col("_f") + F.col("_e")
    return s.join(w, list(keys), "left").select(
        *keys, over(F.col("_h"), F.col("_p")).alias("detect"), "median_lag", over(F.col("_f"), F.col("_n")).alias("fa"), over(F.col("_e"), F.col("_p")).alias("early"),
        over(F.col("_flags"), F.col("_clear")).alias("per_window"), over(F.col("_h"), called).alias("precision"),
    )


def _interval(draws: np.ndarray) -> tuple[float, float]:
    return float(np.percentile(draws, 2.5)), float(np.percentile(draws, 97.5))


def resampled_means(v: np.ndarray, draws: int, rng: np.random.Generator, held: int = 4_000_000) -> np.ndarray:
    """Means of ``draws`` resamples; the same numbers however the draws are cut into arrays of at most ``held`` cells."""
    step = max(1, held // max(1, len(v)))
    return np.concatenate([v[rng.integers(0, len(v), (min(step, draws - k), len(v)))].mean(axis=1) for k in range(0, draws, step)])


def resampled_auc(p: np.ndarray, n: np.ndarray, draws: int, rng: np.random.Generator, held: int = 4_000_000) -> np.ndarray:
    """AUC of ``draws`` resamples of both classes, each drawn apart, the positives of a draw before its negatives.

    A draw is a vector of counts for each class, and its AUC a bilinear form of them.
    """
    won = (p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])
    high = np.array([len(p)] * len(p) + [len(n)] * len(n))
    step, out = max(1, held // len(high)), []
    for k in range(0, draws, step):
        m = min(step, draws - k)
        at = rng.integers(0, high, (m, len(high)))
        row = np.arange(m)[:, None]
        a = np.bincount((row * len(p) + at[:, : len(p)]).ravel(), minlength=m * len(p)).reshape(m, len(p))
        b = np.bincount((row * len(n) + at[:, len(p) :]).ravel(), minlength=m * len(n)).reshape(m, len(n))
        out.append(((a @ won) * b).sum(axis=1) / (len(p) * len(n)))
    return np.concatenate(out)


def bootstrap(values: DataFrame, kind: str, draws: int = 20_000, seed: int = 0, key: str = "metric") -> DataFrame:
    """key, n, estimate, lo, hi for each group's values (bounded studies, one NumPy kernel a group).

    kind ``mean`` (also of paired differences): resampled means, null interval below three.
    kind ``auc``: both classes (``is_positive``) resampled apart, three of each at least.
    Values keep their ``input_order`` where there is one (else they are sorted), so that a seed names the draws.
    """
    ship(values.sparkSession)
    order = "input_order" if "input_order" in values.columns else "value"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.dropna(subset=["value"]).sort_values(order, kind="stable")
        name = pdf[key].iloc[0] if len(pdf) else None
        lo = hi = estimate = None
        if kind == "mean":
            v = pdf["value"].to_numpy(float)
            estimate = float(v.mean()) if len(v) else None
            if len(v) >= 3:
                lo, hi = _interval(resampled_means(v, draws, rng))
        else:
            p, n = (pdf.loc[pdf["is_positive"] == b, "value"].to_numpy(float) for b in (True, False))
            if len(p) and len(n):
                estimate = float(((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean())
            if len(p) >= 3 and len(n) >= 3:
                lo, hi = _interval(resampled_auc(p, n, draws, rng))
        return pd.DataFrame([[name, len(pdf), estimate, lo, hi]], columns=[key, "n", "estimate", "lo", "hi"]).astype({"estimate": float, "lo": float, "hi": float})

    return values.groupBy(key).applyInPandas(run, f"{key} string, n long, estimate double, lo double, hi double")


def verdict(real: DataFrame, placebo: DataFrame) -> DataFrame:
    """REAL if the interval leaves out 0, the estimate beats the placebo's, and the placebo's interval holds 0; where only the first holds, ``sig, but placebo too``."""
    p = placebo.select("metric", F.col("estimate").alias("p_est"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    no = F.lit(False)
    clear = F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), no)
    beats = clear & F.coalesce((F.abs("estimate") > F.abs("p_est")) & (F.col("p_lo") <= 0) & (F.col("p_hi") >= 0), no)
    return real.join(p, "metric", "left").withColumn("verdict", F.when(beats, "REAL").when(clear, "sig, but placebo too").otherwise("no signal"))


def paired_verdict(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "SEPARATES").when(hi < 0, "wrong sign").otherwise("no separation")


def study(rows: DataFrame, most: int = 200_000) -> pd.DataFrame:
    """A matching study's table (uid, area) on the driver; one of more than ``most`` rows is refused, never cut."""
    held = rows.limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"a matching study holds at most {most} rows")
    return held


def _pool(negatives: pd.DataFrame, used=()) -> pd.DataFrame:
    """Negatives with an area, not used yet, in their order."""
    return negatives[(negatives["area"] > 0) & ~negatives["uid"].isin(list(used))]


def greedy_match(positives: pd.DataFrame, negatives: pd.DataFrame) -> pd.DataFrame:
    """negative, positive: each positive, by ascending area, takes the free negative of nearest log area (ties: smaller uid).

    Free negatives stand in one queue for each distinct area, and emptied queues are skipped by path
    compression, so n positives and m negatives take about (n + m) log m steps.
    """
    queues = _pool(negatives).sort_values("uid", ascending=False).groupby("area")["uid"].agg(list)
    logs, free = np.log(queues.index.to_numpy(dtype=float)), queues.tolist()
    skip = {-1: list(range(len(free) + 1)), 1: list(range(len(free) + 1))}

    def nearest(at: int, step: int) -> int:
        """The first queue with members from ``at`` on, in the direction of ``step``; -1 or len(free) if none."""
        path, to = [], skip[step]
        while 0 <= at < len(free) and not free[at]:
            path.append(at)
            at = to[at] if to[at] != at else at + step
        for k in path:
            to[k] = at
        return at

    out = []
    for uid, area in positives[positives["area"] > 0].sort_values("area", kind="stable")[["uid", "area"]].itertuples(index=False):
        x = np.log(area)
        at = int(np.searchsorted(logs, x))
        near = [k for k in (nearest(at - 1, -1), nearest(at, 1)) if 0 <= k < len(free)]
        if not near:
            break
        best = min(near, key=lambda k: (abs(logs[k] - x), free[k][-1]))
        out.append((free[best].pop(), uid))
    return pd.DataFrame(out, columns=["negative", "positive"], dtype=object)


def extend_match(pairs: pd.DataFrame, positives: pd.DataFrame, negatives: pd.DataFrame, size: int) -> pd.DataFrame:
    """``pairs`` and, up to ``size`` rows, unused negatives without a positive.

    Each is the one that makes the KS distance of log area between chosen negatives and positives
    smallest (ties: first in the table). Adding a value lifts the chosen side's counts from its place on,
    so one prefix and one suffix maximum over the distinct values judge all candidates of a step.
    """
    area = dict(zip(negatives["uid"], negatives["area"], strict=True))
    left = _pool(negatives, pairs["negative"])
    chosen = np.log([area[u] for u in pairs["negative"]])
    goal, pool = np.log(positives.loc[positives["area"] > 0, "area"].to_numpy(dtype=float)), np.log(left["area"].to_numpy(dtype=float))
    if not len(goal):
        return pairs
    grid = np.unique(np.concatenate([goal, pool, chosen]))
    share = np.searchsorted(np.sort(goal), grid, "right") / len(goal)
    counts = np.searchsorted(np.sort(chosen), grid, "right")
    place, uids = np.searchsorted(grid, pool), left["uid"].tolist()
    open_, extra = np.ones(len(uids), dtype=bool), []
    while len(pairs) + len(extra) < size and open_.any():
        n = len(pairs) + len(extra) + 1
        before = np.concatenate([[0.0], np.maximum.accumulate(np.abs(counts / n - share))])
        after = np.maximum.accumulate(np.abs((counts + 1) / n - share)[::-1])[::-1]
        best = int(np.argmin(np.where(open_, np.maximum(before[place], after[place]), np.inf)))
        open_[best] = False
        counts[place[best] :] += 1
        extra.append((uids[best], None))
    rows = [*pairs.itertuples(index=False, name=None), *extra]
    return pd.DataFrame(rows, columns=["negative", "positive"], dtype=object)


#: Fixed value: the seed of the matching design.
DESIGN_SEED = 20260908


def pseudo_starts(design: pd.DataFrame, starts: dict, seed: int = DESIGN_SEED) -> pd.DataFrame:
    """uid, start: a paired negative takes its positive's start; the others draw from the sorted starts in the design's order."""
    draw, values = random.Random(seed), sorted(starts.values())
    made = [(u, draw.choice(values) if p is None else starts[p]) for u, p in design[["negative", "positive"]].itertuples(index=False)]
    return pd.DataFrame(made, columns=["uid", "start"])
