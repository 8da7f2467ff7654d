"""Spectral indices, constrained unmixing as generated columns, and endmember search."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
ENDMEMBERS = ("vegetation", "soil", "high_albedo", "low_albedo")
#: Reflectances of four plain materials, for when no scene was searched.
LIBRARY = np.array([
    [0.03, 0.06, 0.04, 0.45, 0.20, 0.09],
    [0.10, 0.14, 0.19, 0.27, 0.36, 0.31],
    [0.38, 0.41, 0.43, 0.46, 0.48, 0.45],
    [0.04, 0.04, 0.04, 0.05, 0.04, 0.03],
])


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + F.lit(1e-6))


def with_indices(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"ndvi": normalized_difference(F.col("b08"), F.col("b04")), "ndbi": normalized_difference(F.col("b11"), F.col("b08")), "swir": F.col("b11")})


def physical(pixels: DataFrame, top: float = 1.2) -> DataFrame:
    """Pixels whose bands all lie strictly between 0 and ``top``; NaN and null go."""
    ok = F.lit(True)
    for b in BANDS:
        ok = ok & (F.col(b) > 0) & (F.col(b) < top)
    return pixels.where(ok)


def clear_pixels(pixels: DataFrame, clp_max: float = 0.65 * 255) -> DataFrame:
    """Valid pixels under the cloud probability limit, where one is given."""
    return pixels.where((F.col("valid") > 0.5) & (F.col("clp").isNull() | (F.col("clp") <= clp_max)))


def supported(pixels: DataFrame, keys=("uid", "ord"), least: int = 20) -> DataFrame:
    """Pixels of site periods with ``least`` pixels or more."""
    enough = pixels.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return pixels.join(enough, list(keys), "left_semi")


def unmix_subsets(spectra: np.ndarray) -> list[tuple[int, tuple[int, ...], np.ndarray, np.ndarray]]:
    """(mask, members, gain, offset) of each subset: fractions = gain @ r + offset minimise the error under sum 1.

    Singular subsets are left out.
    """
    out = []
    for mask in range(1, 1 << len(spectra)):
        members = tuple(i for i in range(len(spectra)) if mask >> i & 1)
        e = spectra[list(members)]
        k = len(members)
        kkt = np.block([[2 * e @ e.T, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        if np.linalg.matrix_rank(kkt) < k + 1:
            continue
        inverse = np.linalg.inv(kkt)
        out.append((mask, members, inverse[:k, :k] @ (2 * e), inverse[:k, k]))
    return out


def unmix(pixels: DataFrame, spectra: np.ndarray = LIBRARY, names=ENDMEMBERS, slack: float = 1e-9) -> DataFrame:
    """Adds fractions that are non-negative and add up to 1, and ``rmse``.

    All subsets of endmembers are solved in closed form as plain column arithmetic; the
    feasible one of least error wins, the lowest subset mask on a tie. No Python runs.
    """
    # a null band is -1, which no subset takes as a fraction of 1; without nulls the generated code stays within one method
    subsets = unmix_subsets(spectra)
    r = {b: F.col(f"_r{b}") for b in BANDS}
    dot = lambda row, offset: sum((F.lit(float(w)) * r[b] for w, b in zip(row, BANDS, strict=True)), F.lit(float(offset)))
    p = pixels.withColumns({f"_r{b}": F.coalesce(F.col(b).cast("double"), F.lit(-1.0)) for b in BANDS})
    p = p.withColumns({f"_f{mask}_{m}": dot(gain[k], offset[k]) for mask, members, gain, offset in subsets for k, m in enumerate(members)})
    errors = {}
    for mask, members, gain, offset in subsets:
        # what a subset leaves of a spectrum is linear in it too
        left, rest = spectra[list(members)].T @ gain - np.eye(len(BANDS)), spectra[list(members)].T @ offset
        error = F.lit(0.0)
        for j in range(len(BANDS)):
            d = dot(left[j], rest[j])
            error = error + F.pow(d, F.lit(2.0))
        feasible = F.lit(True)
        for m in members:
            feasible = feasible & (F.col(f"_f{mask}_{m}") >= -slack)
        errors[f"_e{mask}"] = F.when(feasible, error).otherwise(F.lit(float("inf")))
    p = p.withColumns(errors)
    p = p.withColumn("_least", F.least(*[F.col(f"_e{mask}") for mask, *_ in subsets]))
    best = None
    for mask, *_ in sorted(subsets, key=lambda x: x[0]):
        best = F.when(F.col(f"_e{mask}") == F.col("_least"), mask) if best is None else best.when(F.col(f"_e{mask}") == F.col("_least"), mask)
    p = p.withColumn("_best", best)

    def chosen(i: int) -> Column:
        c = None
        for mask, members, _, _ in subsets:
            if i in members:
                c = F.when(F.col("_best") == mask, F.col(f"_f{mask}_{i}")) if c is None else c.when(F.col("_best") == mask, F.col(f"_f{mask}_{i}"))
        return F.greatest(c.otherwise(0.0), F.lit(0.0))

    p = p.withColumns({f"_raw_{n}": chosen(i) for i, n in enumerate(names)})
    p = p.withColumn("_total", sum((F.col(f"_raw_{n}") for n in names[1:]), F.col(f"_raw_{names[0]}")))
    p = p.withColumns({n: F.col(f"_raw_{n}") / F.col("_total") for n in names})
    error = F.lit(0.0)
    for j, b in enumerate(BANDS):
        d = sum((F.col(n) * F.lit(float(spectra[i, j])) for i, n in enumerate(names)), F.lit(0.0)) - F.col(b)
        error = error + d * d
    p = p.withColumn("rmse", F.sqrt(error / len(BANDS)))
    return p.drop(*[c for c in p.columns if c.startswith(("_r", "_f", "_e")) or c in ("_best", "_total", "_least")])


def site_period(fractions: DataFrame, pixel_area: float, tau: float = 0.5, names=ENDMEMBERS, sizes: DataFrame | None = None) -> DataFrame:
    """One row per site period: n, mean fractions, rmse, and the area above ``tau`` of each.

    With ``sizes(uid, n_grid, n_aoi_px)`` also valid_frac, the share of the grid, and clear_frac, the share of the site's own area, at most 1.
    """
    means = [F.avg(n).alias(n) for n in (*names, "rmse")]
    areas = [(F.count_if(F.col(n) >= tau) * F.lit(pixel_area)).alias(f"{n}_area") for n in names]
    s = fractions.groupBy("uid", "ord").agg(F.count("*").alias("n"), *means, *areas)
    if sizes is None:
        return s
    d = s.join(sizes, "uid").withColumns({"valid_frac": F.col("n") / F.col("n_grid"), "clear_frac": F.least(F.col("n") / F.col("n_aoi_px"), F.lit(1.0))})
    return d.drop("n_grid")


def index_means(pixels: DataFrame, keys=("uid", "ord"), least: int = 20) -> DataFrame:
    """keys, n, ndvi, ndbi, swir: the mean of each pixel's index (not the index of the means); keys with too few pixels are left out."""
    s = with_indices(physical(pixels)).groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("ndvi", "ndbi", "swir")])
    return s.where(F.col("n") >= least)


#: The direction in which a start is expected to move each metric.
EXPECTED = {"soil": 1, "high_albedo": 1, "vegetation": -1, "low_albedo": 1, "ndvi": -1, "ndbi": 1, "swir": 1}


def oriented(metric: Column, value: Column) -> Column:
    """The value with the sign that makes a start positive; null for an unknown metric."""
    signs = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    return F.try_element_at(signs, metric) * value


def distribution(values: DataFrame, column: str, keys=("uid",)) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, (0.10, 0.25, 0.50, 0.75, 0.90))))
    s = values.groupBy(*keys).agg(F.stddev_pop(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"), q.alias("q"))
    return s.select(*keys, "std", "low", "high", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


def trimmed(pool: DataFrame, q: float = 0.005, least: int = 1000) -> DataFrame:
    """Rows within [q, 1 - q] on all bands; small pools stay whole."""
    limits = pool.agg(F.count("*").alias("_n"), *[F.percentile(b, F.array(F.lit(q), F.lit(1 - q))).alias(f"_{b}") for b in BANDS])
    inside = F.lit(True)
    for b in BANDS:
        inside = inside & F.col(b).between(F.col(f"_{b}")[0], F.col(f"_{b}")[1])
    return pool.join(F.broadcast(limits)).where((F.col("_n") <= least) | inside).select(*pool.columns)


def sampled(pixels: DataFrame, per_period: int | None = 4000, per_site: int | None = 60_000, seed: int = 0) -> DataFrame:
    """A seeded sample without replacement: at most so many pixels a site period and a site (None: all)."""
    d = pixels.withColumn("_h", F.xxhash64(F.lit(seed), "uid", "ord", "y", "x"))
    for keys, most in ((("uid", "ord"), per_period), (("uid",), per_site)):
        if most is not None:
            d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_k") <= most).drop("_k")
    return d.drop("_h")


#: Spectra that the search for corners holds, of all sites together: the model is fitted on this bounded sample.
POOL = 300_000


def search_pool(sample: DataFrame, most: int = POOL, seed: int = 0) -> DataFrame:
    """The trimmed sample, and of a larger one the first ``most`` pixels by a hash."""
    return trimmed(sample).orderBy(F.xxhash64(F.lit(seed), "uid", "ord", "y", "x"), "uid", "ord", "y", "x").limit(most)


def endmembers(pool: np.ndarray, sweeps: int = 60, tries: int = 512, near: int = 200, seed: int = 0) -> tuple[dict[str, list[float]], list[str]]:
    """The corners of a bounded pixel pool (n, 6): largest simplex in three principal components,
    each corner smoothed by the median of its neighbours, and labelled by its shape."""
    rng = np.random.default_rng(seed)
    centred = pool - pool.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov(centred.T))
    points = centred @ vectors[:, ::-1][:, :3]
    volume = lambda ids: abs(np.linalg.det(np.vstack([np.ones(4), points[ids].T])))
    corners = rng.choice(len(points), 4, replace=False)
    for _ in range(sweeps):
        before = volume(corners)
        for v in range(4):
            options = rng.choice(len(points), min(tries, len(points)), replace=False)
            sizes = [volume(np.concatenate([corners[:v], [o], corners[v + 1 :]])) for o in options]
            if max(sizes) > volume(corners):
                corners[v] = options[int(np.argmax(sizes))]
        if volume(corners) <= before:
            break
    smooth = []
    for c in corners:
        nearest = np.argsort(((points - points[c]) ** 2).sum(axis=1), kind="stable")[:near]
        smooth.append(np.median(pool[nearest], axis=0))
    return label_endmembers(np.array(smooth))


def label_endmembers(spectra: np.ndarray) -> tuple[dict[str, list[float]], list[str]]:
    """Names claimed in turn: vegetation by NDVI, soil by its rise to short-wave infrared, then the brightest, then the darkest.

    What is left takes the names left by brightness, and is noted; so are ice-like corners and a bright one that isn't.
    """
    b, notes = spectra, []
    ndvi = (b[:, 3] - b[:, 2]) / (b[:, 3] + b[:, 2] + 1e-6)
    bright, contrast = b.mean(axis=1), b[:, 4] - b[:, 3]
    ice = (bright > 0.24) & (contrast < -0.10) & (ndvi < 0.40)
    left, out = list(range(len(b))), {}

    def claim(name, score, allowed=None) -> bool:
        options = [i for i in left if allowed is None or allowed[i]]
        if options:
            out[name] = max(options, key=lambda i: score[i])  # the first on a tie
            left.remove(out[name])
        return bool(options)

    claim("vegetation", ndvi)
    claim("soil", contrast, (contrast > 0) & ~ice)
    bright_found = claim("high_albedo", bright, ~ice)
    claim("low_albedo", -bright)
    for name in ENDMEMBERS:
        if name not in out:
            claim(name, bright)
            notes.append(f"{name}: no vertex matched its shape rule; filled by brightness rank — fractions for it are not trustworthy")
    if ice.any():
        notes.append(f"{int(ice.sum())} of 4 vertices look like cloud/snow (bright with SWIR collapse) — CLP masking did not remove them from the endmember pool")
    high, soil = bright[out["high_albedo"]], bright[out["soil"]]
    if high < 0.20 or high <= soil:
        notes.append(
            f"UNRELIABLE: 'high_albedo' vertex has brightness {high:.3f} (dimmer than soil at {soil:.3f}) — this pixel pool contains no bright impervious surface, "
            "so the high/low albedo fractions are not interpretable. Vegetation and soil remain valid."
        )
    if not bright_found:
        notes.append("no non-ice bright vertex available for high_albedo")
    return {n: b[out[n]].tolist() for n in ENDMEMBERS}, notes
