"""Registered queries of zones, grids, polygons and documents, each beside its DuckDB SQL.

Stand-ins: an event type is a site of 10 by 24 pixels (day of the month modulo ten, hour), a user's
remainder a period, and a pixel changes where its events add up so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions import periods as P
from terrasift.operators import geometry as G
from terrasift.operators import raster as R
from terrasift.operators import zones as Z
from terrasift.plans.bindings import r6, table
from terrasift.plans.queries import _COMPONENTS, _MEASURES, _R1, _SWEEP, STAGE, _points, _r, _tau_looks, query
from terrasift.plans.bindings import LATTICE
from terrasift.sources import documents as X

_WIDTH, _HEIGHT, _STEP = 10, 24, 0.001
_WEST, _NORTH = -100.0, 35.024
_ZONED = ("click", "purchase", "signup")
_BUILDING = (-100.0, 35.014, -99.995, 35.024)


def _box(west, south, east, north):
    """One polygon of one ring as columns."""
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    return F.array(F.array(F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))))


def _grids(spark, sf):
    sites = table(spark, sf, "events").select(F.col("event_type").alias("uid")).distinct()
    box = {"west": _WEST, "south": _NORTH - _HEIGHT * _STEP, "east": _WEST + _WIDTH * _STEP, "north": _NORTH, "dx": _STEP, "dy": _STEP, "lon": -99.996, "lat": 35.012, "px_area": 1000.0}
    return sites.select("uid", F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"), *[F.lit(v).alias(k) for k, v in box.items()])


def _zones(spark, sf):
    """Three zones for three sites, a geometry alone for ``error``, nothing for the others."""
    g = _grids(spark, sf)
    p = Z.grid_pixels(g)
    shapes = {"building": _BUILDING, "development": (-100.0, 35.004, -99.99, 35.024), "context": (-100.0, 35.0, -99.99, 35.004)}
    named = None
    for zone, box in shapes.items():
        d = g.where(F.col("uid").isin(*_ZONED)).select("uid", F.lit(zone).alias("zone"), _box(*box).alias("parts"))
        named = d if named is None else named.unionByName(d)
    whole = g.where("uid = 'error'").select("uid", _box(-100.0, 35.012, -99.99, 35.024).alias("parts"))
    return Z.zone_pixels(p, named, whole)


def _changes(spark, sf):
    e = table(spark, sf, "events")
    d = e.groupBy(F.col("event_type").alias("uid"), (F.lit(24 * 1998) + F.col("user_id") % 6).cast("int").alias("ord"), F.hour("ts").alias("y"), (F.dayofmonth("ts") % 10).alias("x")).agg(
        (F.sum("user_id") % 2 == 0).alias("new_soil"), (F.count("*") >= 3).alias("new_high"), (F.sum("event_id") % 3 == 1).alias("veg_loss")
    )
    return Z.layered(d)


_ZONE_PX = f"""px AS (SELECT uid, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT event_type AS uid FROM events) CROSS JOIN range(0, {_HEIGHT}) a(y) CROSS JOIN range(0, {_WIDTH}) b(x)),
zone_px AS (SELECT uid, 'building' AS zone, y, x FROM px WHERE uid IN {_ZONED} AND y < 10 AND x < 5 UNION ALL SELECT uid, 'development', y, x FROM px WHERE uid IN {_ZONED} AND y < 20
  UNION ALL SELECT uid, 'context', y, x FROM px WHERE uid IN {_ZONED} AND y >= 20 UNION ALL SELECT uid, 'development', y, x FROM px WHERE uid = 'error' AND y < 12 UNION ALL SELECT uid, 'development', y, x FROM px WHERE uid NOT IN {_ZONED} AND uid <> 'error')"""
_CHANGES = """changes AS (SELECT event_type AS uid, CAST(24 * 1998 + user_id % 6 AS INTEGER) AS ord, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) % 10 AS INTEGER) AS x, sum(user_id) % 2 = 0 AS new_soil, count(*) >= 3 AS new_high,
  sum(event_id) % 3 = 1 AS veg_loss FROM events GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_ZONE_PX} SELECT * FROM zone_px")
def zone_masks(spark, sf):
    return _zones(spark, sf)


@query(f"WITH {_CHANGES} SELECT uid, ord, y, x, new_soil OR new_high AS combined, new_soil AND NOT veg_loss AS bare FROM changes")
def mask_algebra(spark, sf):
    return _changes(spark, sf).select("uid", "ord", "y", "x", "combined", (F.col("new_soil") & ~F.col("veg_loss")).alias("bare"))


_FEATURES = f"""{_ZONE_PX}, {_CHANGES}, held AS (SELECT c.*, zone FROM changes c JOIN zone_px z ON z.uid = c.uid AND z.y = c.y AND z.x = c.x),
cells AS (SELECT uid || '/' || zone || '/' || ord AS uid, y, x FROM held WHERE new_soil OR new_high){_MEASURES[len(LATTICE):]},
big AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n_px DESC, label) AS k, count(*) OVER (PARTITION BY uid) AS n_components FROM sides) WHERE k = 1),
sums AS (SELECT uid, zone, ord, count(*) FILTER (veg_loss) AS veg, count(*) FILTER (new_soil) AS soil, count(*) FILTER (new_high) AS high, count(*) FILTER (new_soil OR new_high) AS changed FROM held GROUP BY 1, 2, 3),
feats AS (SELECT l.uid, s.zone, l.ord, s.n AS n_valid_px, s.n * 1000.0::DOUBLE AS zone_area, coalesce(veg, 0) * 1000.0::DOUBLE AS veg_area, coalesce(soil, 0) * 1000.0::DOUBLE AS soil_area, coalesce(high, 0) * 1000.0::DOUBLE AS high_area,
  coalesce(changed, 0) * 1000.0::DOUBLE AS changed_area, round_even(100.0::DOUBLE * coalesce(changed, 0) / s.n, 3) AS pct, coalesce(n_components, 0) AS n_components, coalesce(n_px, 0) * 1000.0::DOUBLE AS largest,
  round_even(4 * pi() * n_px / (perimeter * perimeter), 4) AS compactness, {_WEST} + (cx + 0.5::DOUBLE) * {_STEP}::DOUBLE AS lon, {_NORTH} - (cy + 0.5::DOUBLE) * {_STEP}::DOUBLE AS lat
  FROM (SELECT DISTINCT uid, ord FROM changes) l JOIN (SELECT uid, zone, count(*) AS n FROM zone_px GROUP BY 1, 2) s ON s.uid = l.uid LEFT JOIN sums m ON m.uid = l.uid AND m.zone = s.zone AND m.ord = l.ord
  LEFT JOIN big b ON b.uid = l.uid || '/' || s.zone || '/' || l.ord),
far AS (SELECT *, CASE WHEN uid IN {_ZONED} THEN round_even(sqrt(power(greatest({_BUILDING[0]} - lon, lon - {_BUILDING[2]}, 0) * cos(radians(lat)), 2) + power(greatest({_BUILDING[1]} - lat, lat - {_BUILDING[3]}, 0), 2)) * 110540, 1) END AS dist_to_building,
  round_even(sqrt(power((-99.996 - lon) * cos(radians(lat)), 2) + power(35.012 - lat, 2)) * 110540, 1) AS dist_to_point FROM feats)"""


def _zone_features(spark, sf):
    c, g = _changes(spark, sf), _grids(spark, sf)
    f = Z.zone_features(c, _zones(spark, sf), c.select("uid", "ord").distinct(), g.select("uid", "px_area"))
    buildings = g.where(F.col("uid").isin(*_ZONED)).select(F.col("uid").alias("id"), _box(*_BUILDING).alias("parts"))
    return Z.with_distances(f, g.select("uid", "west", "north", "dx", "dy", "lon", "lat"), buildings)


_FEATURE_COLUMNS = "uid zone ord n_valid_px zone_area veg_area soil_area high_area changed_area pct n_components largest compactness dist_to_building dist_to_point".split()


@query(f"WITH RECURSIVE {_FEATURES} SELECT {', '.join(_FEATURE_COLUMNS)} FROM far")
def zone_features(spark, sf):
    return _zone_features(spark, sf).select(*_FEATURE_COLUMNS)


_ZONE_OBS = "obs AS (SELECT uid || '/' || zone AS uid, uid AS u, zone, ord, true AS clear, changed_area >= 8000 AS changed FROM far)"


@query(
    f"WITH RECURSIVE {_FEATURES}, {_ZONE_OBS}, {_R1}, named AS (SELECT DISTINCT uid, u, zone FROM obs) SELECT u AS uid, zone, ord, state, changed_now, n AS n_clear, run, p AS provisional, c AS confirmed FROM calls JOIN named USING (uid)"
)
def zone_calls(spark, sf):
    return Z.zone_calls(_zone_features(spark, sf))


_RECORD_COLUMNS = "uid zone ord changed_area largest persistence prior_veg_loss state provisional confirmed n_clear stage_pct stage_group stage_label confidence aoi_source".split()


@query(
    f"WITH RECURSIVE {_FEATURES}, {_ZONE_OBS}, {_R1}, kept AS (SELECT u, zone, ord, CASE WHEN count(*) OVER w >= 2 THEN round_even(avg(CAST(changed AS INTEGER)) OVER w, 3) END AS pers FROM obs WINDOW w AS (PARTITION BY uid ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), "
    "f AS (SELECT x.uid, x.zone, x.ord, largest, veg_area AS veg, soil_area AS soil, high_area AS high, changed_area AS changed, pers, CAST(NULL AS DOUBLE) AS rect, dist_to_building AS dist, max(veg_area) OVER (PARTITION BY x.uid, x.zone ORDER BY x.ord ROWS UNBOUNDED PRECEDING) AS prior, "
    "NULL::BOOLEAN AS visual, CASE WHEN x.uid = 'error' THEN 'point_box' ELSE 'parcel' END AS src FROM far x JOIN kept k ON k.u = x.uid AND k.zone = x.zone AND k.ord = x.ord), "
    f"{STAGE}, dev AS (SELECT * FROM staged WHERE zone = 'development') SELECT f.uid, f.zone, f.ord, f.changed AS changed_area, f.largest, f.pers AS persistence, f.prior AS prior_veg_loss, c.state, c.p AS provisional, c.c AS confirmed, c.n AS n_clear, "
    "d.stage_pct, d.stage_group, d.stage_label, d.confidence, f.src AS aoi_source FROM f JOIN calls c ON c.uid = f.uid || '/' || f.zone AND c.ord = f.ord LEFT JOIN dev d ON d.uid = f.uid AND d.zone = f.zone AND d.ord = f.ord"
)
def zone_records(spark, sf):
    """Whole records, but without the rectangularity that only a kernel gives."""
    f = _zone_features(spark, sf).withColumn("rectangularity", F.lit(None).cast("double"))
    own = _grids(spark, sf).select("uid", F.struct(F.when(F.col("uid") == "error", "point_box").otherwise("parcel").alias("aoi_source")).alias("provenance"))
    return Z.records(f, own).withColumn("aoi_source", F.col("provenance.aoi_source")).select(*_RECORD_COLUMNS)


@query(
    f"WITH RECURSIVE {_CHANGES}, cells AS (SELECT uid, y, x FROM changes WHERE ord = 24 * 1998 AND (new_soil OR new_high)){_COMPONENTS[len(LATTICE):]}, later AS (SELECT uid, ord, y, x FROM changes WHERE ord > 24 * 1998 AND (new_soil OR new_high)), "
    "looks AS (SELECT uid, count(DISTINCT ord) AS looks FROM later GROUP BY uid), own AS (SELECT uid, label, count(*) AS n FROM labelled GROUP BY 1, 2), "
    "held AS (SELECT l.uid, l.label, m.ord, count(*) AS held FROM labelled l JOIN later m ON m.uid = l.uid AND m.y = l.y AND m.x = l.x GROUP BY 1, 2, 3), hits AS (SELECT h.uid, h.label, count(*) AS hits FROM held h JOIN own o ON o.uid = h.uid AND o.label = h.label WHERE held >= greatest(1, n // 2) GROUP BY 1, 2) "
    "SELECT o.uid, o.label, round_even(coalesce(hits, 0) / looks, 3) AS persistence FROM own o JOIN looks USING (uid) LEFT JOIN hits h ON h.uid = o.uid AND h.label = o.label"
)
def later_persistence(spark, sf):
    c = _changes(spark, sf).where("combined")
    labelled = R.components(c.where("ord = 24 * 1998").select("uid", "y", "x"))
    return R.later_persistence(labelled, c.where("ord > 24 * 1998").select("uid", "ord", "y", "x"))


@query(
    f"WITH RECURSIVE {_SWEEP} SELECT tau, count(*) FILTER (clear AND changed) AS flagged, count(*) FILTER (clear) AS clear, {_r('count(*) FILTER (clear AND changed) / nullif(count(*) FILTER (clear), 0)')} AS rate FROM obs GROUP BY tau"
)
def clear_rates(spark, sf):
    return Z.clear_rates(_tau_looks(spark, sf), ("tau",)).withColumn("rate", r6(F.col("rate")))


# ------------------------------------------------------------ pixels and polygons


def _points_of(spark, sf):
    p = Z.grid_pixels(_grids(spark, sf))
    return p.select(F.col("uid").alias("id"), "uid", "y", "x", F.col("lon").alias("px"), F.col("lat").alias("py"))


def _building_edges(spark, sf):
    return G.edges_of(_grids(spark, sf).select(F.col("uid").alias("id"), _box(*_BUILDING).alias("parts")))


_PLACED = f"{_ZONE_PX}, placed AS (SELECT *, {_WEST} + (x + 0.5::DOUBLE) * {_STEP}::DOUBLE AS lon, {_NORTH} - (y + 0.5::DOUBLE) * {_STEP}::DOUBLE AS lat FROM px), off AS (SELECT *, greatest({_BUILDING[0]} - lon, lon - {_BUILDING[2]}, 0) AS dx, greatest({_BUILDING[1]} - lat, lat - {_BUILDING[3]}, 0) AS dy FROM placed)"


@query(
    f"WITH {_PLACED}, size AS (SELECT (1 / (111320.0::DOUBLE * cos(radians(35.019::DOUBLE))) + 1 / 110540.0::DOUBLE) / 2 AS k) SELECT uid, y, x FROM off CROSS JOIN size WHERE sqrt(dx * dx + dy * dy) > 120 * k AND sqrt(dx * dx + dy * dy) <= 400 * k"
)
def control_ring(spark, sf):
    return G.control_ring(_points_of(spark, sf), _building_edges(spark, sf)).select("uid", "y", "x")


@query(f"WITH {_PLACED} SELECT uid, 'context' AS zone, y, x FROM off WHERE y >= 12 AND sqrt(power(dx * cos(radians(lat)), 2) + dy * dy) * 110540 > 350")
def context_ring(spark, sf):
    p = _points_of(spark, sf)
    spilt = G.buffered(p, _building_edges(spark, sf), 350.0).select("uid", "y", "x")
    on = p.select("uid", "y", "x")
    return Z.ring_zone(on, on.where("y < 12"), spilt)


@query(f"WITH {_ZONE_PX} SELECT uid, CAST(CASE WHEN count(*) FILTER (uid <> 'view' AND y % 3 = 0) > 0 THEN count(*) FILTER (uid <> 'view' AND y % 3 = 0) ELSE count(*) END AS BIGINT) AS n_aoi_px FROM px GROUP BY uid")
def aoi_fill(spark, sf):
    p = Z.grid_pixels(_grids(spark, sf))
    return Z.fill(p, p.where("uid <> 'view' and y % 3 = 0"))


def _rows(spark, sf):
    """Parcels (a rectangle each), plans of even sites (a triangle and a square in two rows), and pairs."""
    k = F.col("n_nationkey").cast("long")
    d = table(spark, sf, "nation").select(k.alias("id"), (F.lit(-100.0) + k * 0.01).alias("x"), (F.lit(35.0) + k * 0.01).alias("y"))
    at = lambda a, b: F.array(F.col("x") + a, F.col("y") + b)
    ring = lambda *points: F.array(F.array(*[at(*p) for p in points]))
    parcels = d.select("id", F.array(ring((0.0, 0.0), (0.2, 0.0), (0.2, 0.1), (0.0, 0.1), (0.0, 0.0))).alias("parts"))
    even = d.where("id % 2 = 0")
    plans = even.select("id", F.array(ring((0.01, 0.01), (0.05, 0.01), (0.01, 0.05))).alias("parts"))
    plans = plans.unionByName(even.select("id", F.array(ring((0.1, 0.02), (0.14, 0.02), (0.14, 0.06), (0.1, 0.06))).alias("parts")))
    pairs = d.where("id % 2 = 1").select(F.col("id").alias("negative"), (F.col("id") - 1).alias("positive"))
    return parcels, plans, pairs


_MIDDLE = "(0.0008::DOUBLE * (0.01::DOUBLE + 0.04::DOUBLE / 3) + 0.0016::DOUBLE * {}) / 0.0024::DOUBLE"


@query(
    f"WITH d AS (SELECT n_nationkey AS id, -100 + n_nationkey * 0.01::DOUBLE AS x, 35 + n_nationkey * 0.01::DOUBLE AS y FROM nation) SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 2 = 0 THEN 'real' ELSE 'placebo' END AS kind, 2 AS n_parts, "
    f"{_r(f'CASE WHEN id % 2 = 0 THEN x + 0.11::DOUBLE / 2 + 0.055::DOUBLE ELSE x + 0.1::DOUBLE + (0.11::DOUBLE - {_MIDDLE.format("0.12::DOUBLE")}) END')} AS x, {_r(f'CASE WHEN id % 2 = 0 THEN y + 0.03::DOUBLE ELSE y + 0.05::DOUBLE + (0.03::DOUBLE - {_MIDDLE.format("0.04::DOUBLE")}) END')} AS y FROM d"
)
def footprints(spark, sf):
    """The footprint of each site, its own or a placebo; x and y: 0.11 and 0.03 degrees from its leftmost and lowest point, less 0.01 each."""
    f = Z.footprints(*_rows(spark, sf))
    every = F.flatten(F.flatten("parts"))
    low = lambda i: F.array_min(F.transform(every, lambda p: p[i]))
    return f.select("id", "kind", F.size("parts").alias("n_parts"), r6(low(0) + 0.1).alias("x"), r6(low(1) + 0.02).alias("y"))


_Q = "((1 - {e}) * (sin(radians({y})) / (1 - {e} * power(sin(radians({y})), 2)) - ln((1 - sqrt({e}) * sin(radians({y}))) / (1 + sqrt({e}) * sin(radians({y})))) / (2 * sqrt({e}))))"


def _q(y: str) -> str:
    f = 1 / 298.257223563
    return _Q.format(e=f"{f * (2 - f)!r}::DOUBLE", y=y)


@query(
    f"WITH d AS (SELECT n_nationkey AS id, -100 + n_nationkey * 0.01::DOUBLE AS x, 35 + n_nationkey * 0.01::DOUBLE AS y FROM nation) SELECT CAST(id AS BIGINT) AS id, {_r('x + 0.1')} AS cx, {_r('y + 0.05')} AS cy, 1 AS n_parts, "
    f"round_even(radians(0.2) * ({_q('(y + 0.1)')} - {_q('y')}) * power(6378137.0::DOUBLE, 2) / 2 / 1e6, 4) AS km2 FROM d"
)
def polygon_facts(spark, sf):
    d = G.polygon_facts(G.edges_of(_rows(spark, sf)[0]))
    return d.select("id", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), F.col("n_parts").cast("int").alias("n_parts"), F.bround(F.col("m2") / 1e6, 4).alias("km2"))


@query()
def geodesic_distance(spark, sf):
    """Metres on the ellipsoid from each customer's place to a fixed one."""
    p = _points(spark, sf)
    return p.select("pix", G.geodesic_distance(F.col("lon"), F.col("lat"), F.lit(-99.5), F.lit(35.5)).alias("metres"))


_POINT_SQL = "points AS (SELECT c_custkey AS pix, c_custkey * 37 % 1000 / 1000.0::DOUBLE - 100 AS lon, c_custkey * 91 % 1000 / 1000.0::DOUBLE + 35 AS lat FROM customer)"


@query(
    f"WITH {_POINT_SQL} SELECT pix, {_r('lon - 375 / (111111 * cos(radians(lat)))')} AS west, {_r('lat - 375 / 111111.0::DOUBLE')} AS south, {_r('lon + 375 / (111111 * cos(radians(lat)))')} AS east, {_r('lat + 375 / 111111.0::DOUBLE')} AS north FROM points"
)
def ground_box(spark, sf):
    d = _points(spark, sf).select("pix", *G.ground_square(F.col("lon"), F.col("lat"), 750.0, G.BOX_M))
    return d.select("pix", *[r6(F.col(c)).alias(c) for c in ("west", "south", "east", "north")])


@query(
    f"WITH {_POINT_SQL}, r AS (SELECT pix, 10 / (111320.0::DOUBLE * greatest(cos(radians(lat)), 0.01)) AS dx, 10 / 110540.0::DOUBLE AS dy, lon, lat FROM points) SELECT pix, {_r('dx * 1000')} AS dx, {_r('dy * 1000')} AS dy, "
    f"CAST(least(greatest(round_even(pix * 3 / 10.0::DOUBLE, 0), 16), 400) AS INTEGER) AS width, {_r('lon + 3.5 * dx')} AS x_lon, {_r('lat - 7.5 * dy')} AS y_lat FROM r"
)
def grid_sizing(spark, sf):
    p = _points(spark, sf)
    dx, dy = G.resolution_degrees(F.lit(10.0), F.col("lat"))
    lon, lat = G.pixel_centre(F.lit(3), F.lit(7), F.col("lon"), F.col("lat"), dx, dy)
    return p.select("pix", r6(dx * 1000).alias("dx"), r6(dy * 1000).alias("dy"), G.grid_size(F.col("pix") * 3.0, F.lit(10.0), 400).alias("width"), r6(lon).alias("x_lon"), r6(lat).alias("y_lat"))


@query(
    "WITH t AS (SELECT event_id, ts - INTERVAL 8 HOUR AS t FROM events) SELECT event_id, printf('%04d-%02d-H%d', CAST(year(t) AS INTEGER), CAST(month(t) AS INTEGER), CASE WHEN day(t) <= 15 THEN 1 ELSE 2 END) AS period FROM t"
)
def period_of_instant(spark, sf):
    """The half-month of each event by Pacific wall clock (all events are in winter time)."""
    e = table(spark, sf, "events")
    return e.select("event_id", P.period_name(P.ordinal_of_instant(F.col("ts"))).alias("period"))


# ------------------------------------------------------------------- documents


@query(
    "SELECT c_custkey AS uid, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS n_parts, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 50 + 0.5 WHEN 1 THEN c_custkey % 50 + 1.0 ELSE 0.0 END::DOUBLE AS latitude FROM customer"
)
def geojson_coercion(spark, sf):
    k = F.col("c_custkey")
    ring = lambda d: F.format_string(f"[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", k % 90, k % 50 + d, k % 90 + 1, k % 50 + d, k % 90 + 1, k % 50 + 1 + d, k % 90, k % 50 + 1 + d)  # noqa: E731, F541
    kind = F.when(k % 4 == 0, "Polygon").when(k % 4 == 1, "MultiPolygon").when(k % 4 == 2, "Point").otherwise("Polygon")
    text = F.when(k % 4 == 0, F.concat(F.lit("["), ring(0), F.lit("]"))).when(k % 4 == 1, F.concat(F.lit("[["), ring(0), F.lit("],["), ring(1), F.lit("]]"))).when(k % 4 == 2, "[1,2]").otherwise("no json")
    d = table(spark, sf, "customer").select(k.alias("uid"), G.parts_of(kind, text).alias("parts"))
    return d.select("uid", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_parts"), G.mean_latitude(F.col("parts")).alias("latitude"))


@query(
    "SELECT p_partkey AS uid, p_retailprice AS a_ndbi, CAST(p_size AS DOUBLE) AS a_swir, CAST(NULL AS DOUBLE) AS a_ndvi, 0.5::DOUBLE AS a_valid_frac, p_size AS a_sample_count, p_retailprice * 2 AS a_ndbi_std, CAST(p_size AS DOUBLE) AS a_ndbi_p50, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS a_swir_std, CAST(NULL AS DOUBLE) AS a_swir_p50 FROM part"
)
def flat_stats(spark, sf):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    none = F.lit(None).cast("double")
    own = F.create_map(F.lit("ndbi"), F.create_map(F.lit("std"), price * 2, F.lit("p50"), size), F.lit("swir"), F.create_map(F.lit("std"), F.when(F.col("p_partkey") % 2 == 0, price)))
    d = table(spark, sf, "part").select(
        F.col("p_partkey").alias("uid"), price.alias("ndbi"), size.alias("swir"), none.alias("ndvi"), F.lit(0.5).alias("valid_frac"), F.col("p_size").alias("sample_count"), own.alias("dist")
    )
    out = X.flat_stats(d, "a_", ("std", "p50"), ("ndbi", "swir", "ndvi"))
    return out.drop("a_ndvi_std", "a_ndvi_p50")
