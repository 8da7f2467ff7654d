"""Rasters as long tables: components, shape measures, tiles, ranked disturbances.

A mask is a table of its true cells (keys, y, x). Components are found per
raster by a union-find over its sorted cells, one raster a group; a raster too
large for that is cut into tiles with an overlap and merged by shared cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions.session import checkpointed, ship
from terrasift.operators.geometry import LAT_M, pixel_centre
from terrasift.operators.graph import components as graph_components
from terrasift.operators.graph import folded


def label_cells(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """8-connected component of each cell of a mask sorted by row, then column: the index of its first cell.

    Cells are cut into runs of neighbours in a row; runs of adjacent rows that touch, found by binary
    search, are the edges of a small graph.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    y, x = y.astype(np.int64) - int(y.min()), x.astype(np.int64) - int(x.min()) + 1
    width = int(x.max()) + 2
    key = y * width + x
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key) != 1]))
    end = np.concatenate([begin[1:], [len(key)]]) - 1
    lo = np.searchsorted(key[end], key[begin] + width - 1, "left")
    hi = np.searchsorted(key[begin], key[end] + width + 1, "right")
    n = np.maximum(hi - lo, 0)
    above = np.repeat(np.arange(len(begin)), n)
    below = np.repeat(lo, n) + np.arange(len(above)) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(begin))
    nodes, least = folded(above, below)
    label[nodes] = least
    return np.repeat(begin[label], end - begin + 1)


def components(mask: DataFrame, keys=("uid",), min_size: int = 6) -> DataFrame:
    """keys, y, x, label for cells of 8-connected components of ``min_size`` cells or more.

    Labels count from 1 within each raster, in row order of the components' first cells.
    """
    ship(mask.sparkSession)
    fields = [f for f in mask.schema.fields if f.name in keys]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["y", "x"]).sort_values(["y", "x"], ignore_index=True)
        first = label_cells(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        size = np.bincount(first, minlength=len(pdf))
        keep = size[first] >= min_size
        out = pdf[[*keys, "y", "x"]][keep].copy()
        out["label"] = np.unique(first[keep], return_inverse=True)[1].astype(np.int64) + 1
        return out

    schema = T.StructType([*fields, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.LongType())])
    cells = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return cells.groupBy(*keys).applyInPandas(run, schema)


def measures(labelled: DataFrame, keys=("uid",)) -> DataFrame:
    """Per component: n_px, centroid, bounding box, 4-neighbour perimeter with outer edges, compactness.

    Perimeter is 4 n less twice the number of side-by-side pairs, which two window lags count.
    """
    across = Window.partitionBy(*keys, "label", "y").orderBy("x")
    down = Window.partitionBy(*keys, "label", "x").orderBy("y")
    near = labelled.withColumn("_r", (F.col("x") - F.lag("x").over(across) == 1).cast("int")).withColumn("_d", (F.col("y") - F.lag("y").over(down) == 1).cast("int"))
    m = near.groupBy(*keys, "label").agg(
        F.count("*").alias("n_px"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"),
        (4 * F.count("*") - 2 * (F.coalesce(F.sum("_r"), F.lit(0)) + F.coalesce(F.sum("_d"), F.lit(0)))).alias("perimeter"),
    )
    n = F.col("n_px")
    return m.withColumn("compactness", F.when(n >= 3, F.bround(F.lit(4 * np.pi) * n / (F.col("perimeter") * F.col("perimeter")), 4)))


def least_rectangle(points: np.ndarray) -> float:
    """Area of the smallest rotated rectangle around points (calipers on the hull's edges)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def half(pts):
        out = []
        for q in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    hull = np.array(half(p)[:-1] + half(p[::-1])[:-1], dtype=float)
    if len(hull) < 3:
        return 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    unit = edge / np.linalg.norm(edge, axis=1)[:, None]
    normal = np.column_stack([-unit[:, 1], unit[:, 0]])
    a, b = hull @ unit.T, hull @ normal.T
    return float(((a.max(axis=0) - a.min(axis=0)) * (b.max(axis=0) - b.min(axis=0))).min())


def rectangularity(labelled: DataFrame, keys=("uid",)) -> DataFrame:
    """keys, label, rectangularity: cells over the least rectangle around their centres, at most 1; null for degenerate ones."""
    ship(labelled.sparkSession)
    fields = [f for f in labelled.schema.fields if f.name in (*keys, "label")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        area = least_rectangle(pdf[["x", "y"]].to_numpy()) if len(pdf) >= 3 else 0.0
        out = pdf[[*keys, "label"]].iloc[:1].copy()
        out["rectangularity"] = round(min(1.0, len(pdf) / area), 4) if area > 0 else None
        return out.astype({"rectangularity": float})

    return labelled.groupBy(*keys, "label").applyInPandas(run, T.StructType([*fields, T.StructField("rectangularity", T.DoubleType())])).withColumn("rectangularity", F.nanvl("rectangularity", F.lit(None).cast("double")))


def tiles(width: int, height: int, tile: int = 64, overlap: int = 16):
    """(ix, iy, x0, y0, x1, y1) with ragged last tiles; each 2 x 2 block lies in one if overlap >= 1."""
    step = tile - overlap
    spans = lambda n: [(i, a, min(a + tile, n)) for i, a in enumerate(range(0, max(1, n - overlap), step))]
    return [(ix, iy, x0, y0, x1, y1) for iy, y0, y1 in spans(height) for ix, x0, x1 in spans(width)]


def tiled_components(mask: DataFrame, keys=("uid",), tile: int = 64, overlap: int = 16, min_size: int = 6) -> DataFrame:
    """The same components as ``components``, labelled per tile and merged across them.

    Only cells in overlaps link tiles; links are contracted to components in a logarithmic
    number of rounds over the (small) table of tile components, and sizes are tested after merging.
    """
    step = tile - overlap
    reach = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - tile) / step) + 1), F.floor(F.col(c) / step)))
    dealt = mask.withColumn("iy", reach("y")).withColumn("ix", reach("x"))
    local = components(dealt.select(*keys, "iy", "ix", "y", "x"), (*keys, "iy", "ix"), 1)
    piece = F.xxhash64(*keys, "iy", "ix", "label")
    named = checkpointed(local.withColumn("piece", piece))
    shared = named.groupBy(*keys, "y", "x").agg(F.min("piece").alias("low"), F.collect_set("piece").alias("pieces"))
    links = shared.where(F.size("pieces") > 1).select("low", F.explode("pieces").alias("piece")).where("low <> piece").distinct()
    root = graph_components(links.select(F.col("low").alias("a"), F.col("piece").alias("b"))).select(F.col("node").alias("_node"), F.col("label").alias("_root"))
    joined = named.join(root, F.col("piece") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "piece"))
    cells = joined.select(*keys, "y", "x", "root").distinct()
    whole = Window.partitionBy(*keys, "root")
    kept = cells.withColumn("_n", F.count("*").over(whole)).where(F.col("_n") >= min_size)
    first = kept.withColumn("_first", F.min(F.struct("y", "x")).over(whole))
    return first.withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")).cast("long")).select(*keys, "y", "x", "label")


def component_score(area: Column, rect: Column, near: Column, mmu: float = 8000.0) -> Column:
    """Size up to four times the least unit, favouring rectangles and closeness; unknown terms are left out."""
    size = F.least(area / mmu, F.lit(4.0))
    return F.bround(size * F.coalesce(0.6 + 0.8 * rect, F.lit(1.0)) * F.coalesce(1 / (1 + near / 500), F.lit(1.0)), 4)


def rank_disturbances(measured: DataFrame, grid: DataFrame, k: int | None = None, keys=("uid",)) -> DataFrame:
    """Adds area_m2, the centroid's lon and lat, dist_to_point_m, score and rank to measured components.

    ``measured`` as from ``measures``, with ``rectangularity`` and ``dist_to_building_m`` (null: unknown);
    ``grid(uid, west, north, dx, dy, px_area, point_lon, point_lat)`` has one row a site.
    """
    d = measured.join(grid, "uid").withColumn("area_m2", F.col("n_px") * F.col("px_area"))
    lon, lat = pixel_centre(F.col("cx"), F.col("cy"), F.col("west"), F.col("north"), F.col("dx"), F.col("dy"))
    d = d.withColumns({"_lon": lon, "_lat": lat})
    here = F.sqrt(F.pow((F.col("point_lon") - F.col("_lon")) * F.cos(F.radians("_lat")), 2) + F.pow(F.col("point_lat") - F.col("_lat"), 2)) * LAT_M
    near = F.coalesce("dist_to_building_m", here)
    d = d.withColumns({"lon": F.bround("_lon", 7), "lat": F.bround("_lat", 7), "dist_to_point_m": F.bround(here, 1), "score": component_score(F.col("area_m2"), F.col("rectangularity"), near)})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "label"))
    d = d.withColumn("rank", rank).drop("_lon", "_lat", "west", "north", "dx", "dy", "px_area", "point_lon", "point_lat")
    return d if k is None else d.where(F.col("rank") <= k)


def top_components(scored: DataFrame, k: int = 5, keys=("uid",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "label"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def largest_component(measured: DataFrame, keys=("uid",)) -> DataFrame:
    """The component with the most cells of each raster; the first label on a tie."""
    order = Window.partitionBy(*keys).orderBy(F.col("n_px").desc(), "label")
    return measured.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def later_persistence(labelled: DataFrame, masks: DataFrame, keys=("uid",)) -> DataFrame:
    """keys, label, persistence: the share of later masks that still hold half of a component's cells or more.

    ``masks(keys, ord, y, x)`` are the cells of the later masks; a mask without a cell is not known to be one.
    """
    size = labelled.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    looks = masks.groupBy(*keys).agg(F.count_distinct("ord").alias("_looks"))
    held = labelled.join(masks, [*keys, "y", "x"]).groupBy(*keys, "label", "ord").agg(F.count("*").alias("_held"))
    hits = held.join(size, [*keys, "label"]).where(F.col("_held") >= F.greatest(F.lit(1), F.floor(0.5 * F.col("_n")))).groupBy(*keys, "label").agg(F.count("*").alias("_hits"))
    d = size.join(looks, list(keys)).join(hits, [*keys, "label"], "left")
    return d.select(*keys, "label", F.bround(F.coalesce("_hits", F.lit(0)) / F.col("_looks"), 3).alias("persistence"))
