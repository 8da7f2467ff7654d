"""Zones of a site: their pixels, what changes in them, and the record of each zone and period.

A zone is a table of pixels (uid, zone, y, x); change layers are the pixels that changed
(uid, ord, y, x, new_soil, new_high, veg_loss). Everything below is joins and
group-bys on those, and one component kernel for each (site, zone, period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.session import checkpointed
from terrasift.operators import geometry as G
from terrasift.operators import onset as O
from terrasift.operators import raster as R
from terrasift.operators import rules as U

MMU = 8000.0
ZONES = ("building", "development", "context")


def grid_pixels(grids: DataFrame) -> DataFrame:
    """uid, y, x, lon, lat of each pixel of ``grids(uid, west, south, east, north, width, height)``; row 0 is north."""
    row = grids.where("width > 0 and height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    p = row.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    dx, dy = (F.col("east") - F.col("west")) / F.col("width"), (F.col("north") - F.col("south")) / F.col("height")
    lon, lat = G.pixel_centre(F.col("x"), F.col("y"), F.col("west"), F.col("north"), dx, dy)
    return p.select("uid", "y", "x", lon.alias("lon"), lat.alias("lat"))


def zone_pixels(pixels: DataFrame, zones: DataFrame, whole: DataFrame) -> DataFrame:
    """uid, zone, y, x: the pixels whose centre is in each zone's polygons.

    ``zones(uid, zone, parts)``; a site without any zone has its whole geometry ``whole(uid, parts)`` as its
    development zone, and one without that, all its pixels.
    """
    known = zones.where(F.col("zone").isin(*ZONES) & F.col("parts").isNotNull()).select("uid", "zone", "parts")
    without = pixels.select("uid").distinct().join(known, "uid", "left_anti")
    shapes = whole.where("parts is not null").select("uid", "parts")
    named = known.unionByName(without.join(shapes, "uid").select("uid", F.lit("development").alias("zone"), "parts"))
    edges = G.edges_of(named.select(F.struct("uid", "zone").alias("id"), "parts"))
    points = pixels.join(named.select("uid", "zone"), "uid").select(F.struct("uid", "zone").alias("id"), F.col("lon").alias("px"), F.col("lat").alias("py"), "y", "x")
    held = G.inside(points, edges).select("id.uid", "id.zone", "y", "x")
    bare = pixels.join(without.join(shapes, "uid", "left_anti"), "uid").select("uid", F.lit("development").alias("zone"), "y", "x")
    return held.unionByName(bare)


def ring_zone(fetched: DataFrame, parcel: DataFrame, footprint: DataFrame) -> DataFrame:
    """The context zone: pixels fetched, less the parcel's, less those of the buffered footprint. All are (uid, y, x)."""
    on = ["uid", "y", "x"]
    return fetched.join(parcel, on, "left_anti").join(footprint, on, "left_anti").select("uid", F.lit("context").alias("zone"), "y", "x")


def footprints(sites: DataFrame, plans: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, parts, kind of each site's footprint: its own (``real``), or its matched positive's moved to the parcel's centroid (``placebo``).

    ``sites(id, parts)`` are parcels, ``plans(id, parts)`` polygons of plans, several rows a site, ``pairs(negative, positive)``. A
    placebo still has to be cut by its parcel: keep the pixels that are in both.
    """
    own = G.united(plans)
    real = own.join(sites.select("id"), "id", "left_semi").withColumn("kind", F.lit("real"))
    centre = lambda d, x, y: G.polygon_facts(G.edges_of(d)).select("id", F.col("cx").alias(x), F.col("cy").alias(y))
    left = pairs.join(own, F.col("negative") == F.col("id"), "left_anti").select(F.col("negative").alias("id"), "positive")
    source = own.select(F.col("id").alias("positive"), "parts").join(centre(own, "fx", "fy").withColumnRenamed("id", "positive"), "positive")
    offset = left.join(source, "positive").join(centre(sites, "sx", "sy"), "id")
    shift = offset.select("id", (F.col("sx") - F.col("fx")).alias("dx"), (F.col("sy") - F.col("fy")).alias("dy"))
    placebo = G.moved(offset.select("id", "parts"), shift).withColumn("kind", F.lit("placebo"))
    return real.unionByName(placebo)


def fill(pixels: DataFrame, inside: DataFrame) -> DataFrame:
    """uid, n_aoi_px: pixels of the site's area, the denominator of its clear share; all its pixels where none is inside."""
    n = inside.groupBy("uid").agg(F.count("*").alias("_in"))
    every = pixels.groupBy("uid").agg(F.count("*").alias("_all"))
    return every.join(n, "uid", "left").select("uid", F.coalesce("_in", "_all").alias("n_aoi_px"))


def layered(changed: DataFrame) -> DataFrame:
    """Adds ``combined``: new soil or new bright ground, the evidence for construction. Unknown layers are unchanged."""
    d = changed.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("new_soil", "new_high", "veg_loss")})
    return d.withColumn("combined", F.col("new_soil") | F.col("new_high"))


def zone_features(changed: DataFrame, zones: DataFrame, looks: DataFrame, sites: DataFrame, min_px: int = 6) -> DataFrame:
    """One row for each zone of a site and each look: areas, share and its largest component.

    ``changed`` as from ``layered``; ``looks(uid, ord)`` are the periods seen, with or without a change;
    ``sites(uid, px_area)``. Largest: the most cells, the first label on a tie.
    """
    keys = ["uid", "zone", "ord"]
    size = zones.groupBy("uid", "zone").agg(F.count("*").alias("n_valid_px"))
    held = changed.join(zones, ["uid", "y", "x"])
    sums = held.groupBy(*keys).agg(*[F.count_if(c).alias(f"_{c}") for c in ("veg_loss", "new_soil", "new_high", "combined")])
    # kept: the component kernel runs once, whatever reads its cells
    labelled = checkpointed(R.components(held.where("combined").select(*keys, "y", "x"), tuple(keys), min_px))
    measured = R.measures(labelled, tuple(keys))
    count = measured.groupBy(*keys).agg(F.count("*").alias("n_components"))
    big = R.largest_component(measured, tuple(keys))
    rect = R.rectangularity(labelled.join(big.select(*keys, "label"), [*keys, "label"], "left_semi"), tuple(keys)).drop("label")
    d = looks.join(size, "uid").join(sites.select("uid", "px_area"), "uid").join(sums, keys, "left").join(count, keys, "left")
    d = d.join(big.select(*keys, "n_px", "cx", "cy", "compactness"), keys, "left").join(rect, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    area = lambda c: n(c) * F.col("px_area")
    return d.select(
        *keys, area("n_valid_px").alias("zone_area"), "n_valid_px", area("_veg_loss").alias("veg_area"), area("_new_soil").alias("soil_area"), area("_new_high").alias("high_area"),
        area("_combined").alias("changed_area"), F.bround(100.0 * n("_combined") / F.greatest(F.col("n_valid_px"), F.lit(1)), 3).alias("pct"), n("n_components").alias("n_components"),
        area("n_px").alias("largest"), "compactness", "rectangularity", "cx", "cy",
    )


def with_distances(features: DataFrame, grids: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds dist_to_building and dist_to_point of the largest component's centroid, in metres to one place.

    ``grids(uid, west, north, dx, dy, lon, lat)``; ``buildings(id, parts)`` by uid. Null without a component, a building or a point.
    """
    d = features.join(grids, "uid", "left")
    px, py = G.pixel_centre(F.col("cx"), F.col("cy"), F.col("west"), F.col("north"), F.col("dx"), F.col("dy"))
    d = d.withColumns({"id": F.col("uid"), "px": px, "py": py})
    here = F.sqrt(F.pow((F.col("lon") - F.col("px")) * F.cos(F.radians("py")), 2) + F.pow(F.col("lat") - F.col("py"), 2)) * G.LAT_M
    far = G.polygon_distance(d.where("px is not null").select("id", "px", "py").distinct(), G.edges_of(buildings))
    d = d.join(far, ["id", "px", "py"], "left").withColumns({"dist_to_building": F.bround("distance", 1), "dist_to_point": F.bround(here, 1)})
    return d.drop("id", "px", "py", "distance", "west", "north", "dx", "dy", "lon", "lat")


def zone_observations(features: DataFrame, mmu: float = MMU) -> DataFrame:
    """uid, zone, ord, clear, changed: a zone has changed if its changed area reaches the least unit."""
    return features.select("uid", "zone", "ord", F.lit(True).alias("clear"), (F.col("changed_area") >= mmu).alias("changed"))


def zone_calls(features: DataFrame, mmu: float = MMU, **rules) -> DataFrame:
    """The causal machine over each zone of each site."""
    return O.run_causal(zone_observations(features, mmu), ("uid", "zone"), **rules)


def records(features: DataFrame, provenance: DataFrame, mmu: float = MMU) -> DataFrame:
    """One record a site, zone and period: features, causal persistence, the loss of vegetation so far, the call of its
    own zone, the stage (development zone only) and the provenance of the site's area.

    ``features`` as from ``zone_features`` with its distances; ``provenance(uid, provenance)``.
    """
    keys = ["uid", "zone", "ord"]
    upto = Window.partitionBy("uid", "zone").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    features = checkpointed(features)
    kept = O.persistence(zone_observations(features, mmu), keys=("uid", "zone"))
    calls = zone_calls(features, mmu).select(*keys, "state", "provisional", "confirmed", "n_clear")
    d = features.join(kept, keys, "left").withColumn("prior_veg_loss", F.max("veg_area").over(upto)).join(calls, keys, "left").join(provenance, "uid", "left")
    d = d.withColumns({"visual": F.lit(None).cast("boolean"), "aoi_source": F.col("provenance.aoi_source")})
    staged = U.stage_classify(d)
    dev = F.col("zone") == "development"
    only = {c: F.when(dev, F.col(c)) for c in ("stage_pct", "stage_group", "stage_label", "confidence", "signals", "n_signals")}
    return staged.withColumns(only).drop("rule", "aoi_source")


def clear_rates(observations: DataFrame, keys=()) -> DataFrame:
    """keys, flagged, clear, rate: the share of clear looks that are flagged changed."""
    clear = F.coalesce(F.col("clear"), F.lit(False))
    s = observations.groupBy(*keys).agg(F.count_if(clear & F.coalesce("changed", F.lit(False))).alias("flagged"), F.count_if(clear).alias("clear"))
    return s.withColumn("rate", F.when(F.col("clear") > 0, F.col("flagged") / F.col("clear")))


def scene_class_mask(scl: Column, mask: Column) -> Column:
    """Whether a pixel of the scene classification is ground that can be used: vegetation, bare, water or unclassified, and data."""
    return F.coalesce(scl.isin(4, 5, 6, 7) & (mask > 0), F.lit(False))
