"""Geometry on longitude and latitude, as columns where a formula does.

Polygons are tables of edges or arrays of (lon, lat); zones are sets of pixels,
so union, intersection and difference are distinct, semi-join and anti-join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a degree of latitude, and of longitude at the equator.
LAT_M, LON_M = 110_540.0, 111_320.0
#: Metres in a degree, by which the box around a site without a parcel is drawn.
BOX_M = 111_111.0
#: WGS84.
_A, _F = 6_378_137.0, 1 / 298.257223563


def pixel_area(west: Column, south: Column, east: Column, north: Column, width: Column, height: Column) -> Column:
    mid = F.radians((south + north) / 2)
    return (east - west) / width * LON_M * F.cos(mid) * (north - south) / height * LAT_M


def resolution_degrees(metres: Column, lat: Column) -> tuple[Column, Column]:
    return metres / (LON_M * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))), metres / LAT_M


def grid_size(metres: Column, res: Column, most: int) -> Column:
    return F.least(F.greatest(F.bround(metres / res), F.lit(16.0)), F.lit(float(most))).cast("int")


def ground_square(lon: Column, lat: Column, side: float, degree: float | None = None) -> list[Column]:
    """west, south, east, north of a square on the ground; ``degree``: metres in a degree of either axis, for the box of a site."""
    north = degree or LAT_M
    dx, dy = side / 2 / ((degree or LON_M) * F.cos(F.radians(lat))), F.lit(side / 2 / north)
    return [(lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north")]


def pixel_centre(x: Column, y: Column, west: Column, north: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre; row 0 is north."""
    return west + (x + 0.5) * dx, north - (y + 0.5) * dy


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    c = F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow((lon1 - lon2) * c, 2) + F.pow(lat1 - lat2, 2)) * LAT_M


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """Metres on the ellipsoid by Vincenty's inverse formula (not for places nearly opposite on the globe)."""
    b = _A * (1 - _F)
    reduced = lambda lat: F.atan((1 - _F) * F.tan(F.radians(lat)))
    start = F.struct(
        F.radians(lon2 - lon1).alias("l"), F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2")
    )

    def state(p, lam):
        y = F.sqrt(F.pow(p["c2"] * F.sin(lam), 2) + F.pow(p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam), 2))
        x = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)

        def more(t):
            sin_a = F.when(t["y"] > 0, p["c1"] * p["c2"] * F.sin(lam) / t["y"]).otherwise(0.0)
            return _bind(
                F.struct(t["y"].alias("y"), t["x"].alias("x"), F.atan2(t["y"], t["x"]).alias("sigma"), sin_a.alias("a"), (1 - sin_a * sin_a).alias("k")),
                lambda u: F.struct(u["y"].alias("y"), u["x"].alias("x"), u["sigma"].alias("sigma"), u["a"].alias("a"), u["k"].alias("k"),
                                   F.when(u["k"] > 1e-15, u["x"] - 2 * p["s1"] * p["s2"] / u["k"]).otherwise(0.0).alias("m")),
            )

        return _bind(F.struct(y.alias("y"), x.alias("x")), more)

    def solve(p):
        def step(lam, _):
            def next_(t):
                c = _F / 16 * t["k"] * (4 + _F * (4 - 3 * t["k"]))
                return p["l"] + (1 - c) * _F * t["a"] * (t["sigma"] + c * t["y"] * (t["m"] + c * t["x"] * (2 * t["m"] * t["m"] - 1)))

            return _bind(state(p, lam), next_)

        def length(t):
            u = t["k"] * (_A * _A - b * b) / (b * b)
            big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
            small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
            d = small * t["y"] * (t["m"] + small / 4 * (t["x"] * (2 * t["m"] * t["m"] - 1) - small / 6 * t["m"] * (4 * t["y"] * t["y"] - 3) * (4 * t["m"] * t["m"] - 3)))
            return b * big * (t["sigma"] - d)

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p["l"], step)
        return _bind(lam, lambda x: _bind(state(p, x), length))

    return _bind(start, solve)


# ------------------------------------------------------------------- polygons

_PARTS = "array<array<array<array<double>>>>"


def parts_of(kind: Column, coordinates: Column) -> Column:
    """Polygons (parts of rings of points) of a GeoJSON type and its coordinates as JSON text; null for anything else."""
    single, several = F.from_json(coordinates, "array<array<array<double>>>"), F.from_json(coordinates, _PARTS)
    made = F.when(kind == "Polygon", F.when(single.isNotNull(), F.array(single))).when(kind == "MultiPolygon", several)
    return F.when(F.size(made) > 0, made)


def mean_latitude(parts: Column) -> Column:
    """The mean latitude of all points of some polygons, 0 without any."""
    lats = F.transform(F.flatten(F.flatten(parts)), lambda p: p[1])
    return F.coalesce(F.aggregate(lats, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(lats), F.lit(0)), F.lit(0.0))


def edges_of(polygons: DataFrame) -> DataFrame:
    """Edges (id, part, ring, x1, y1, x2, y2) of ``(id, rings)``, one polygon, or ``(id, parts)``, several; rings after the first are holes.

    Rings of fewer than three points and empty parts have none.
    """
    parts = F.col("parts") if "parts" in polygons.columns else F.array("rings")
    ring = polygons.select("id", F.posexplode(parts).alias("part", "rings")).select("id", "part", F.posexplode("rings").alias("ring", "r")).where(F.size("r") >= 3)
    closed = ring.select("id", "part", "ring", "r", F.explode(F.sequence(F.lit(0), F.size("r") - 1)).alias("i")).withColumn("j", F.pmod(F.col("i") + 1, F.size("r")))
    p = lambda k, c: F.get(F.get(F.col("r"), F.col(k)), F.lit(c))
    return closed.select("id", "part", "ring", p("i", 0).alias("x1"), p("i", 1).alias("y1"), p("j", 0).alias("x2"), p("j", 1).alias("y2"))


def inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points (id, px, py, ...) inside any part of the polygons of their id, each by the parity of its edges crossed."""
    e = edges.where("y1 <> y2")
    crossing = points.select("id", "px", "py").distinct().join(e, "id").where(
        ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py")))
        & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    )
    odd = crossing.groupBy("id", "px", "py", "part").agg(F.count("*").alias("_k")).where(F.col("_k") % 2 == 1).select("id", "px", "py").distinct()
    return points.join(odd, ["id", "px", "py"], "left_semi")


def polygon_distance(points: DataFrame, edges: DataFrame, ground: bool = True) -> DataFrame:
    """points and ``distance`` to the nearest polygon of their id, 0 inside; null where the id has none.

    ``ground``: metres, longitudes scaled at each point's own latitude; else plain degrees.
    """
    k = F.greatest(F.cos(F.radians("py")), F.lit(1e-6)) if ground else F.lit(1.0)
    own = points.select("id", "px", "py").distinct()
    e = own.join(edges, "id").select("id", "px", "py", *[(k * (F.col(x) - F.col("px"))).alias(x) for x in ("x1", "x2")], *[(F.col(y) - F.col("py")).alias(y) for y in ("y1", "y2")])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.when(dx * dx + dy * dy > 0, -(F.col("x1") * dx + F.col("y1") * dy) / (dx * dx + dy * dy)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    near = e.groupBy("id", "px", "py").agg(F.min(F.pow(F.col("x1") + t * dx, 2) + F.pow(F.col("y1") + t * dy, 2)).alias("_sq"))
    within = inside(own, edges).withColumn("_in", F.lit(True))
    d = points.join(near, ["id", "px", "py"], "left").join(within, ["id", "px", "py"], "left")
    return d.withColumn("distance", F.when(F.col("_in"), 0.0).otherwise(F.sqrt("_sq") * (LAT_M if ground else 1.0))).drop("_sq", "_in")


def _rings(edges: DataFrame) -> DataFrame:
    """id, part, ring, area and centroid in degrees, geodesic area; each ring relative to its own corner."""
    corner = edges.groupBy("id", "part", "ring").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"))
    e = edges.join(corner, ["id", "part", "ring"])
    x1, x2, y1, y2 = (F.col(c) - F.col(o) for c, o in (("x1", "x0"), ("x2", "x0"), ("y1", "y0"), ("y2", "y0")))
    cross = x1 * y2 - x2 * y1
    e2 = _F * (2 - _F)
    root = math.sqrt(e2)

    def authalic(lat):
        s = F.sin(F.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - root * s) / (1 + root * s)) / (2 * root))

    strip = F.radians(F.col("x2") - F.col("x1")) * ((authalic(F.col("y1")) + authalic(F.col("y2"))) / 2 - authalic(F.col("y0")))
    s = e.groupBy("id", "part", "ring", "x0", "y0").agg(F.sum(cross).alias("c"), F.sum((x1 + x2) * cross).alias("mx"), F.sum((y1 + y2) * cross).alias("my"), F.sum(strip).alias("s"))
    whole = F.when(F.col("c") != 0, F.col("c"))
    return s.select(
        "id", "part", "ring", (F.abs("c") / 2).alias("deg2"), (F.col("x0") + F.col("mx") / (3 * whole)).alias("cx"), (F.col("y0") + F.col("my") / (3 * whole)).alias("cy"),
        (F.abs("s") * (_A * _A / 2)).alias("m2"),
    )


def polygon_facts(edges: DataFrame) -> DataFrame:
    """id, m2 (geodesic area of all parts less their holes), cx and cy (centroid in degrees), n_parts."""
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    w = sign * F.col("deg2")
    total = F.nullif(F.sum(w), F.lit(0.0))
    return _rings(edges).groupBy("id").agg(
        F.sum(sign * F.col("m2")).alias("m2"), (F.sum(w * F.col("cx")) / total).alias("cx"), (F.sum(w * F.col("cy")) / total).alias("cy"), F.count_distinct("part").alias("n_parts")
    )


def ring_area(ring: list[list[float]]) -> float:
    """Geodesic area of a lon/lat ring in square metres, by its authalic latitudes (small rings)."""
    e2 = _F * (2 - _F)
    e = math.sqrt(e2)

    def authalic(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    p = np.array(ring, dtype=float)
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    q = [authalic(lat) for lat in p[:, 1]]
    n = len(p)
    total = sum(math.radians(p[(i + 1) % n, 0] - p[i, 0]) * (q[i] + q[(i + 1) % n]) / 2 for i in range(n))
    return abs(total) * _A * _A / 2


def polygon_area(rings: list[list[list[float]]]) -> float:
    """The first ring less its holes."""
    return ring_area(rings[0]) - sum(ring_area(r) for r in rings[1:])


# ----------------------------------------------------------- sets of pixels


def within_metres(points: DataFrame, pixels: DataFrame, metres: float) -> DataFrame:
    """Pixels (id, lon, lat) within a distance of any point (id, lon, lat) of the same id: a metre buffer as a set of pixels.

    Both are dealt to cells as wide as the distance (in longitude: at the strip's own latitude), and a
    point meets the pixels of its own cell and the eight around it only.
    """
    high = metres / LAT_M
    strip = lambda lat: F.floor(lat / high)
    # the least cosine in a strip and those beside it, so that a cell is never narrower than the distance
    wide = lambda s: high / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs((s - 1) * high), F.abs((s + 2) * high)))))
    beside = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.select("id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(beside).alias("_i")).withColumn("_s", strip(F.col("_lat")) + F.col("_i"))
    p = p.withColumn("_j", F.explode(beside)).withColumn("_c", F.floor(F.col("_lon") / wide(F.col("_s"))) + F.col("_j"))
    cells = pixels.withColumn("_s", strip(F.col("lat"))).withColumn("_c", F.floor(F.col("lon") / wide(F.col("_s"))))
    near = cells.join(p, ["id", "_s", "_c"]).where(planar_distance(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) <= metres)
    return near.select(*pixels.columns).distinct()


def annulus(points: DataFrame, pixels: DataFrame, inner: float = 120.0, outer: float = 400.0) -> DataFrame:
    """Pixels in the ring between two distances from points."""
    return within_metres(points, pixels, outer).join(within_metres(points, pixels, inner), ["id", "lon", "lat"], "left_anti")


def buffered(pixels: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """Pixels (id, px, py, ...) within so many metres of the polygons of their id."""
    return polygon_distance(pixels, edges).where(F.col("distance") <= metres).drop("distance")


def control_ring(pixels: DataFrame, edges: DataFrame, inner: float = 120.0, outer: float = 400.0) -> DataFrame:
    """Pixels (id, px, py, ...) in the ring around the polygons of their id: both buffers by the mean size of a degree at the centroid."""
    lat = polygon_facts(edges).select("id", F.col("cy").alias("_cy"))
    size = (1 / (LON_M * F.greatest(F.cos(F.radians("_cy")), F.lit(0.01))) + 1 / LAT_M) / 2
    d = polygon_distance(pixels, edges, ground=False).join(lat, "id")
    return d.where((F.col("distance") > inner * size) & (F.col("distance") <= outer * size)).drop("distance", "_cy")


def moved(polygons: DataFrame, offsets: DataFrame) -> DataFrame:
    """(id, parts) of polygons shifted by ``offsets(id, dx, dy)`` in degrees."""
    shift = lambda p: F.array(p[0] + F.col("dx"), p[1] + F.col("dy"))
    made = F.transform("parts", lambda part: F.transform(part, lambda r: F.transform(r, shift)))
    return polygons.join(offsets, "id").select("id", made.alias("parts"))


def united(polygons: DataFrame) -> DataFrame:
    """(id, parts): all usable parts of an id together. A point is in their union if it is in any of them."""
    usable = F.filter("parts", lambda part: F.size(F.get(part, F.lit(0))) >= 3)
    each = polygons.select("id", F.explode(usable).alias("part"))
    return each.groupBy("id").agg(F.collect_list("part").alias("parts"))
