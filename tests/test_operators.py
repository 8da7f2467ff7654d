"""Behaviour that the queries don't show: traps, kernels, and the stream."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.functions import periods as P
from terrasift.operators import baseline as B
from terrasift.operators import evaluate as E
from terrasift.operators import geometry as G
from terrasift.operators import graph
from terrasift.operators import onset as O
from terrasift.operators import raster as R
from terrasift.operators import rules as U
from terrasift.operators import spectral as S
from terrasift.operators import zones as Z
from terrasift.sources import documents as X
from terrasift.sources import tables as T
from terrasift.streaming.onset import advance, causal_stream


def test_periods(spark):
    d = spark.createDataFrame([("2024-01-01 07:59:00",), ("2024-01-16 08:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in d.select(P.period_name(P.ordinal_of_instant(F.col("t")))).collect()] == ["2023-12-H2", "2024-01-H2"]
    every = P.calendar(spark, 2023 * 24, 2024 * 24 + 23).withColumn("back", P.ordinal_of_name(F.col("period"))).withColumn("days", P.period_days(F.col("ord"))).collect()
    assert all(r.ord == r.back and 13 <= r.days <= 16 for r in every)
    assert sum(r.days for r in every) == 365 + 366
    texts = spark.createDataFrame([("2024-02-29T10",), ("2024-2-9",), ("2023-02-29",), (None,), ("x",)], "t string")
    assert [str(r[0]) for r in texts.select(P.lenient_date(F.col("t"))).collect()] == ["2024-02-29", "None", "None", "None", "None"]


def test_two_medians(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 2.0, 3.0, 10.0, 99.0))], "uid long, ord int, v double")
    last = B.with_robust_trail(s, "v", -4, -1, "t").where("ord = 4").first()
    assert last.t_median == 3.0
    assert last.t_sigma == pytest.approx(1.4826 * 2.0)
    assert s.where("ord < 4").agg(F.median("v")).first()[0] == 2.5


def fold(obs):
    state, out = (-1, 0, 0, 0, None, None), []
    for o, clear, changed in obs:
        state, call = advance(state, o, clear, changed)
        out.append(call)
    return out


def test_onset_cards():
    look = lambda s: fold([(i, c != "-", c == "x") for i, c in enumerate(s)])
    assert [c[1] for c in look("...x-x")][-1] == O.CONFIRMED
    assert look("...x-x")[4][1] == O.INSUFFICIENT
    assert look("...x-x")[-1][6] == 3
    assert [c[1] for c in look("...x.x")][4] == O.PROVISIONAL
    assert look("...x..")[-1][5] is None
    assert look("...xx...")[-1][6] == 3
    assert look("xx.")[-1][5] == 2


def test_onset_batch_is_the_machine_and_causal(spark):
    r = random.Random(1)
    obs = [(u, i, r.random() < 0.8, r.random() < 0.5) for u in range(30) for i in range(20)]
    batch = O.run_causal(spark.createDataFrame(obs, "uid long, ord int, clear boolean, changed boolean")).collect()
    got = {(x.uid, x.ord): tuple(x[1:]) for x in batch}
    for u in range(30):
        for cut in (5, 20):
            for call in fold([o[1:] for o in obs if o[0] == u][:cut]):
                assert got[u, call[0]] == call


def test_stream(spark, tmp_path):
    r = random.Random(2)
    obs = [(u, i, r.random() < 0.8, r.random() < 0.5) for u in range(3) for i in range(12)]
    schema = "uid long, ord int, clear boolean, changed boolean"
    for k, half in enumerate(([o for o in obs if o[1] < 6], [o for o in obs if o[1] >= 6])):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
    q = causal_stream(stream).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.uid, x.ord): tuple(x[1:]) for x in spark.table("calls").collect()}
    assert got == {(u, c[0]): c for u in range(3) for c in fold([o[1:] for o in obs if o[0] == u])}


def test_auc_and_lift(spark):
    d = lambda rows: spark.createDataFrame(rows, "score double, is_positive boolean")
    area = lambda rows: E.auc(d(rows)).first()
    assert area([(2.0, True), (1.0, False)]).auc == 1.0
    assert area([(1.0, True), (2.0, False)]).auc == 0.0
    assert area([(1.0, True), (1.0, False), (None, True)]).auc == 0.5
    assert area([(1.0, True)]).auc is None
    top = spark.createDataFrame([(9.0, True, 0), (8.0, True, 1), (1.0, False, 2), (0.0, False, 3)], "score double, is_positive boolean, input_order int")
    assert tuple(E.lift_at(top, 2).first()) == (2, 1.0, 0.5, 2.0)


def test_bootstrap_needs_three(spark):
    d = spark.createDataFrame([("m", 1.0, True), ("m", 2.0, True)], "metric string, value double, is_positive boolean")
    r = E.bootstrap(d, "mean", draws=1000).first()
    assert r.n == 2 and (r.lo is None or math.isnan(r.lo))


def test_unmix_recovers_known_mixtures(spark):
    rng = np.random.default_rng(0)
    f = rng.dirichlet(np.ones(4), 200)
    f[:20, 1] = 0
    f /= f.sum(axis=1, keepdims=True)
    pixels = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(f @ S.LIBRARY)], "pix long, " + ", ".join(f"{b} double" for b in S.BANDS))
    out = S.unmix(pixels).orderBy("pix").select(*S.ENDMEMBERS, "rmse").toPandas()
    assert np.abs(out[list(S.ENDMEMBERS)].to_numpy() - f).max() < 1e-9
    assert out["rmse"].max() < 1e-9


def test_endmembers_find_the_corners():
    rng = np.random.default_rng(1)
    f = np.vstack([rng.dirichlet(np.ones(4) * 0.5, 3000), np.repeat(np.eye(4), 200, axis=0)])
    found, notes = S.endmembers(f @ S.LIBRARY + rng.normal(0, 1e-3, (len(f), 6)))
    assert notes == []
    for name, own in zip(S.ENDMEMBERS, S.LIBRARY, strict=True):
        assert np.abs(np.array(found[name]) - own).max() < 0.05


def test_pad_in_a_field(spark):
    r = np.random.default_rng(3)
    prior = {24 * y: 0.20 + r.normal(0, 0.01, (60, 60)) for y in (1, 2, 3)}
    now = 0.20 + r.normal(0, 0.01, (60, 60))
    now[20:38, 10:32] += 0.55
    rows = [(y * 60 + x, 100 - back, float(a[y, x])) for back, a in [(0, now), *prior.items()] for y in range(60) for x in range(60)]
    base = B.seasonal_baseline(spark.createDataFrame(rows, "uid long, ord int, soil double"), "soil")
    mask = B.change_mask(base).where("changed and ord = 100").select(F.lit("s").alias("uid"), F.floor(F.col("uid") / 60).cast("int").alias("y"), (F.col("uid") % 60).cast("int").alias("x"))
    labelled = R.components(mask)
    m = R.measures(labelled).collect()
    assert len(m) == 1 and abs(m[0].n_px - 396) < 40
    assert R.rectangularity(labelled).first().rectangularity > 0.9


def test_tile_seam_and_random_masks(spark):
    r = random.Random(5)
    cells = [("seam", y, x) for y in range(50, 70) for x in range(50, 70)]
    cells += [(f"r{k}", y, x) for k in range(3) for y in range(24) for x in range(24) if r.random() < 0.45]
    mask = spark.createDataFrame(cells, "uid string, y int, x int")
    key = lambda d: sorted(map(tuple, d.select("uid", "y", "x", "label").collect()))
    whole = key(R.components(mask))
    assert len([c for c in whole if c[0] == "seam"]) == 400
    assert key(R.tiled_components(mask, tile=12, overlap=2)) == whole


def test_metre_buffer_at_six_latitudes(spark):
    for lat in (0.0, 25.0, 35.0, 45.0, 55.0, 65.0):
        east = G.planar_distance(F.lit(0.0), F.lit(lat), F.lit(500 / (G.LON_M * math.cos(math.radians(lat)))), F.lit(lat))
        north = G.planar_distance(F.lit(0.0), F.lit(lat), F.lit(0.0), F.lit(lat + 500 / G.LAT_M))
        e, n = spark.range(1).select(east, north).first()
        assert abs(e - 500) < 12.5 and abs(n - 500) < 12.5


def test_geodesic_area():
    # one square degree at the equator and at 60 north, on the WGS84 ellipsoid
    assert G.ring_area([[0, 0], [1, 0], [1, 1], [0, 1]]) == pytest.approx(12_308_778_361, rel=1e-3)
    assert G.ring_area([[0, 60], [1, 60], [1, 61], [0, 61]]) == pytest.approx(6_122_000_000, rel=5e-3)
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert G.polygon_area([square, [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.4]]]) < G.ring_area(square)


def test_plan_policies(spark):
    plans = spark.createDataFrame(
        [(1, "a", "2024-01-01", "2024-02-01", "2024-09-01", "phase", 2, 10.0), (1, "b", "2023-01-01", None, None, "as_built", 2, 1.0), (1, "c", "2023-06-01", None, None, "phase", 2, 99.0)],
        "uid long, plan string, d1 string, d2 string, d3 string, plan_type string, n_rings int, residual double",
    ).withColumns({n: F.col(c).cast("date") for n, c in (("document_date", "d1"), ("revision_date", "d2"), ("public_date", "d3"))})
    looks = spark.createDataFrame([(1, "2024-03-01"), (1, "2024-10-01")], "uid long, o string").select("uid", F.col("o").cast("date").alias("obs_date"))
    found = lambda policy: {str(r.obs_date): r.plan for r in U.plan_as_of(plans, looks, policy).collect()}
    assert found("strict") == {"2024-10-01": "a"}
    assert found("relaxed") == {"2024-03-01": "a", "2024-10-01": "a"}


def test_stage_abstains_and_never_calls_bright_alone(spark):
    columns = "largest double, veg_area double, soil_area double, high_area double, changed_area double, persistence double, rectangularity double, dist_to_building double, prior_veg_loss double, visual boolean, aoi_source string"
    rows = [(9000.0, 0.0, 0.0, 9000.0, 9000.0, 0.9, 0.9, None, None, False, "parcel"), (9000.0, 9000.0, 9000.0, 3000.0, 12000.0, None, None, None, None, False, "parcel"), (9000.0, 9000.0, 9000.0, 3000.0, 12000.0, 0.9, 0.9, 100.0, 9000.0, True, "siteplan")]
    a, b, c = U.stage_classify(spark.createDataFrame(rows, columns)).collect()
    assert a.stage_pct == 0
    assert (b.stage_pct, b.stage_group) == (None, "10-15")
    assert c.stage_pct == 15 and c.confidence > b.confidence


SITE = "uid string, lat double, lon double, coord_confirmed boolean, site_source string, parcel_m2 double, parcel_valid boolean, parcel_parts int, parcel_inside boolean, parcel_offset_m double"
PLANNED = SITE + ", plan_keys array<string>, plan_warnings array<string>, plan_refusal string, plan_m2 double, plan_offset_m double"


def test_area_of_interest_without_plans(spark):
    far, near, big = ("far", 35.0, -100.0, True, "parcel", 5e5, True, 1, False, 9000.0), ("near", 35.0, -100.0, True, "parcel", 5e5, True, 1, False, 1500.0), ("big", 35.0, -100.0, True, "parcel_union", 9e6, False, 3, True, 0.0)
    none = ("none", None, None, False, None, None, True, 1, False, None)
    d = {r.uid: r for r in U.resolve_aoi(spark.createDataFrame([far, near, big, none], SITE), with_plans=False).collect()}
    assert (d["far"].aoi_source, d["far"].point_sizes_m, d["far"].quality) == ("point_box", [400.0, 1000.0], 0.4)
    assert d["far"].fallback_reason == "siteplan: no plan index supplied; parcel: point 9000 m outside the parcel — not the same place"
    assert (d["near"].aoi_source, d["near"].quality) == ("parcel", 0.5)
    assert d["near"].warnings == ["project point falls OUTSIDE the parcel (1500 m from its centroid)"]
    assert (d["big"].aoi_source, d["big"].needs_tiling, d["big"].quality) == ("parcel", True, 0.5)
    assert d["big"].warnings[1] == "parcel is large (900 ha): an 8,000 m2 event is 0.089% of it — use the tiled component search, never the parcel mean"
    assert (d["none"].aoi_source, d["none"].quality, d["none"].coordinate_quality) == (None, None, "inferred")
    assert "parcel: no parcel geometry (aoi_source=none); point: no coordinate" in d["none"].fallback_reason


def test_area_of_interest_with_plans(spark):
    parcel = (35.0, -100.0, False, "parcel", 5e5, True, 1, True, 0.0)
    rows = [
        ("used", *parcel, ["a"], ["siteplan a: georeferencing residual 20.0 m (> 15 m)"], None, 4e4, 1200.0),
        ("away", *parcel, ["a"], [], None, 4e4, 6000.0), ("late", *parcel, [], ["siteplan a rejected (temporal leakage): x"], "x", None, None), ("no", *parcel, None, None, None, None, None),
    ]
    d = {r.uid: r for r in U.resolve_aoi(spark.createDataFrame(rows, PLANNED)).collect()}
    assert (d["used"].aoi_source, d["used"].buffer_m, d["used"].quality) == ("siteplan", 150.0, 0.6)
    assert [x.what for x in d["used"].deductions] == ["coordinate approximate", "weak georeferencing", "point/polygon disagreement"]
    assert (d["away"].aoi_source, d["away"].fallback_reason) == ("parcel", "siteplan: site plan centroid 6000 m from the point — not the same place")
    assert (d["late"].fallback_reason, d["no"].fallback_reason) == ("siteplan: x", "siteplan: no site plan for campus")
    p = spark.createDataFrame(rows, PLANNED).transform(U.resolve_aoi)
    assert len(p.select(U.provenance(p).alias("p")).select("p.*").columns) == 12


def test_stage_with_unknown_areas(spark):
    names = "largest veg_area soil_area high_area changed_area persistence rectangularity dist_to_building prior_veg_loss".split()
    d = spark.createDataFrame([(None,) * 9 + (None, "parcel")], ", ".join(f"{n} double" for n in names) + ", visual boolean, aoi_source string")
    r = U.stage_classify(d).first()
    assert (r.stage_pct, r.stage_label, r.confidence, r.signals) == (0, "no construction", 0.6, [])


def test_quarantine(spark):
    d = spark.createDataFrame([(x,) for x in ("2027-05-01", "2024-01-01T00", " 2024-01-01 ", "20240101", "2028-01-01", "0001-01-01", "2026-08-20", None, "2026-08-01")], "date string")
    reasons = [r.reason for r in T.quarantine(d).collect()]
    assert reasons == ["future", "unparseable", None, None, "impossible_year", "impossible_year", "unobservable", "unparseable", None]
    assert {r.reason: r.n for r in T.quarantine_counts(T.quarantine(d, strict=False)).collect()} == {"kept": 5, "unparseable": 2, "impossible_year": 2}


def test_site_build(spark):
    b = [
        ("C1", "b1", "Active", "40", "-100", "Y", "Old", "", "p", "TX", 1), ("C1", "b2", " construction", "42", "nan", " y ", "nan", "New hall", "q", None, 2), ("C1", "b3", "Construction", "x", "-100", "N", "Third", "", "q", "TX", 0),
        (" ", "b4", "announcement", "30", "-90", None, None, None, "r", "TX", 3), ("C2", "b5", "construction", None, "-90", "Y", "Nowhere", "", "r", "TX", 4), ("", None, "construction", "1", "1", "Y", "x", "", "r", "TX", 5),
    ]
    d = spark.createDataFrame(b, "campus_uid string, building_uid string, stage string, lat string, lon string, exact string, campus_name string, building_name string, provider string, state string, row int")
    links = T.link_union(*[spark.createDataFrame(x, "unit string, parcel string") for x in ([("C1", "p1"), ("C1", "p2"), ("b4", "p3")], [("C1", "p1"), (None, "p3")])])
    parcels = spark.createDataFrame([("p1", 6000.0), ("p2", 9000.0), ("p3", 100.0)], "parcel string, m2 double").withColumn("parts", F.lit(None).cast("array<array<array<array<double>>>>"))
    s = {r.uid: r for r in T.build_sites(d, ["announcement", "construction"], T.unit_parcels(links, parcels)).collect()}
    assert set(s) == {"C1", "b4"}
    c = s["C1"]
    assert (c.name, c.stage, c.state, c.coord_confirmed, c.mixed_stage, c.lat, c.lon) == ("New hall", "construction", "", True, True, 40.0, -100.0)
    assert (c.aoi_source, c.n_parcels, c.area_m2, c.unit_type) == ("parcel_union", 2, 15000.0, "campus")
    assert (s["b4"].aoi_source, s["b4"].reject_reason, s["b4"].area_m2, s["b4"].name, s["b4"].unit_type) == ("box_parcel_rejected", "parcel 100 m2 < 5000 m2", 562500.0, "Site b4", "building")
    assert T.build_sites(d, ["construction"], every=True).collect() == [] and T.portfolio(T.build_sites(d, ["announcement", "construction"])).first().mixed == 1


def test_endmember_labels():
    rows = {"green": [0.03, 0.06, 0.04, 0.45, 0.20, 0.09], "soil": [0.10, 0.14, 0.19, 0.27, 0.36, 0.31], "ice": [0.8, 0.8, 0.8, 0.8, 0.2, 0.1], "dark": [0.04, 0.04, 0.04, 0.05, 0.04, 0.03]}
    found, notes = S.label_endmembers(np.array(list(rows.values())))
    assert found["vegetation"] == rows["green"] and found["soil"] == rows["soil"]
    # the dark corner is the only one that may be called bright; ice is what is left
    assert found["high_albedo"] == rows["dark"] and found["low_albedo"] == rows["ice"]
    assert notes[0].startswith("1 of 4 vertices look like cloud/snow") and notes[1].startswith("UNRELIABLE: 'high_albedo' vertex has brightness 0.040 (dimmer than soil at 0.228)")
    bare = np.array([rows["green"], rows["dark"], [0.2, 0.2, 0.2, 0.2, 0.1, 0.1], [0.4, 0.4, 0.4, 0.4, 0.3, 0.3]])
    found, notes = S.label_endmembers(bare)
    assert notes[0].startswith("soil: no vertex matched its shape rule") and found["soil"] == bare[3].tolist()  # ice-like, so all that is left


def test_bootstrap_draws_are_those_of_the_seed(spark):
    v = [0.3, -0.1, 0.2, 0.25, 0.05]
    d = spark.createDataFrame([("m", x, i) for i, x in enumerate(v)], "metric string, value double, input_order int").repartition(3)
    r = E.bootstrap(d, "mean", draws=2000, seed=1).first()
    means = np.random.default_rng(1).choice(np.array(v), (2000, 5)).mean(1)
    assert (r.lo, r.hi) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    p, n, rng = np.array([1.0, 2, 3, 3]), np.array([0.5, 2, 2.5]), np.random.default_rng(0)
    plain = []
    for _ in range(300):
        a, b = rng.choice(p, 4), rng.choice(n, 3)
        plain.append(np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b)))
    assert np.allclose(E.resampled_auc(p, n, 300, np.random.default_rng(0), held=50), plain)


def test_verdicts(spark):
    real = spark.createDataFrame([("a", 2.0, 1.0, 3.0), ("b", 2.0, 1.0, 3.0), ("c", 0.0, -1.0, 1.0), ("d", 2.0, 1.0, 3.0)], "metric string, estimate double, lo double, hi double")
    placebo = spark.createDataFrame([("a", 0.5, -1.0, 1.0), ("b", 3.0, 2.0, 4.0), ("c", 0.0, -1.0, 1.0)], "metric string, estimate double, lo double, hi double")
    assert {r.metric: r.verdict for r in E.verdict(real, placebo).collect()} == {"a": "REAL", "b": "sig, but placebo too", "c": "no signal", "d": "sig, but placebo too"}


def _square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


def test_overlapping_parts_and_holes(spark):
    shapes = [("a", [[_square(0.0, 0.0, 1.0)], [_square(0.5, 0.5, 1.0)]]), ("b", [[_square(0.0, 60.0, 1.0), _square(0.25, 60.25, 0.5)]])]
    edges = G.edges_of(spark.createDataFrame(shapes, "id string, parts array<array<array<array<double>>>>"))
    points = spark.createDataFrame([("a", 0.75, 0.75), ("a", 1.25, 1.25), ("a", 1.25, 0.25), ("b", 0.5, 60.5), ("b", 0.1, 60.5), ("c", 0.0, 0.0)], "id string, px double, py double")
    assert sorted((r.id, r.px) for r in G.inside(points, edges).collect()) == [("a", 0.75), ("a", 1.25), ("b", 0.1)]
    far = {(r.id, r.px, r.py): r.distance for r in G.polygon_distance(points, edges, ground=False).collect()}
    assert far["a", 1.25, 0.25] == pytest.approx(0.25) and far["b", 0.5, 60.5] == pytest.approx(0.25) and far["a", 0.75, 0.75] == 0 and far["c", 0.0, 0.0] is None
    facts = {r.id: r for r in G.polygon_facts(edges).collect()}
    assert facts["b"].m2 == pytest.approx(G.polygon_area(shapes[1][1][0]), rel=1e-9) and (facts["a"].n_parts, facts["a"].cx) == (2, pytest.approx(0.75))


def test_geodesic_distance(spark):
    d = lambda *p: G.geodesic_distance(*[F.lit(float(x)) for x in p])
    r = spark.range(1).select(d(0, 0, 1, 0).alias("a"), d(0, 0, 0, 1).alias("b"), d(1, 2, 1, 2).alias("c"), d(-0.1276, 51.5072, -74.006, 40.7128).alias("d")).first()
    assert (r.a, r.b, r.c) == (pytest.approx(111_319.491, abs=1e-3), pytest.approx(110_574.389, abs=1e-3), 0.0) and r.d == pytest.approx(5_585_254, abs=50)


def test_within_metres_against_all_pairs(spark):
    r = random.Random(6)
    p = [(i % 2, r.uniform(-1, 1) * 0.05, 60 + r.uniform(-1, 1) * 0.02) for i in range(12)]
    q = [(i % 2, r.uniform(-1, 1) * 0.05, 60 + r.uniform(-1, 1) * 0.02) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, lon double, lat double")
    gap = lambda a, b: math.hypot((a[1] - b[1]) * math.cos(math.radians((a[2] + b[2]) / 2)), a[2] - b[2]) * G.LAT_M
    for metres in (150.0, 700.0):
        near = {b for b in q if any(a[0] == b[0] and gap(a, b) <= metres for a in p)}
        assert {tuple(x) for x in G.within_metres(frame(p), frame(q), metres).collect()} == near


def test_components_of_runs():
    for seed in range(60):
        r = np.random.default_rng(seed)
        y, x = np.nonzero(r.random((r.integers(1, 12), r.integers(1, 12))) < r.random())
        label = {c: i for i, c in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
        for _ in label:
            for a, b in label:
                label[a, b] = min(label.get((a + i, b + j), len(label)) for i in (-1, 0, 1) for j in (-1, 0, 1))
        assert R.label_cells(y, x).tolist() == list(label.values())


def test_graph_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)] + [(5000, 5000 + k) for k in range(1, 50)]
    found = {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes, least = graph.folded(*(np.array(c) for c in zip(*[e for e in edges if e[0] != e[1]], strict=True)))
    assert found == dict(zip(nodes.tolist(), least.tolist(), strict=True)) and {found[i] for i in range(101)} == {0} and {found[5000 + k] for k in range(50)} == {5000}


def test_documents(spark, tmp_path):
    import json

    box = {"type": "Polygon", "coordinates": [_square(-100.0, 35.0, 0.01)]}
    grid = {"uid": "u1", "name": "n", "bbox": [-100.0, 35.0, -99.99, 35.01], "width": 10, "height": 5, "periods": ["2024-01-H1"], "lat": 35.005, "lon": -99.995, "geometry": box, "start_period": "2024-01-H1"}
    for slug, more in (("a", {"aoi": {"analysis_zones": {"building": {"type": "MultiPolygon", "coordinates": [[_square(-100.0, 35.0, 0.0048)]]}, "context": None}, "footprint_kind": "real"}}), ("b", {"uid": "u2", "aoi": None})):
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "grid.json").write_text(json.dumps({**grid, **more}))
    g = X.read_grids(spark, str(tmp_path / "*" / "grid.json"))
    assert sorted((r.uid, r.slug, r.west, r.parts is None) for r in g.collect()) == [("u1", "a", -100.0, False), ("u2", "b", -100.0, False)]
    zones = Z.zone_pixels(Z.grid_pixels(g), X.zones_of(g), g.select("uid", "parts"))
    assert {(r.uid, r.zone): r["count"] for r in zones.groupBy("uid", "zone").count().collect()} == {("u1", "building"): 10, ("u2", "development"): 50}
    record = lambda p, z, **k: {"period": p, "zone": z, "total_changed_area_m2": 9000.0, **k}
    (tmp_path / "f.json").write_text(json.dumps({"site": {"uid": "u1", "start_period": "2024-01-H2"}, "records": [record("2024-01-H1", "building"), record("2024-01-H1", "building", n_components=2), record("2024-01-H2", "development")]}))
    f = X.read_features(spark, str(tmp_path / "f.json")).orderBy("ord").collect()
    assert [(r.uid, r.start - r.ord, r.zone, r.n_components) for r in f] == [("u1", 1, "building", 2), ("u1", 0, "development", None)]
    ring = _square(0.0, 0.0, 1.0)
    layers = [{"key": "k1", "campus_uid": "u1", "name": "Overall plan", "sheet_date": "2024-02-03T00", "fit": {"residual_m": 3.5}, "features": [{"ring": ring}, {"ring": ring[:3]}, {"n": 1}]}, {"key": "k2", "campus_uid": "u1", "name": "AS-BUILT", "filing_date": "2024-05-01"}]
    (tmp_path / "plans.json").write_text(json.dumps({"layers": layers}))
    a, b = X.read_plan_layers(spark, str(tmp_path / "plans.json")).orderBy("at").collect()
    assert (a.key, a.plan_type, str(a.document_date), a.n_rings, a.residual, a.date_provenance) == ("k1", "masterplan", "2024-02-03", 1, 3.5, "document_date from sheet_date; no public/filing date known -- usable_from is optimistic")
    assert (b.plan_type, b.n_rings, str(b.public_date), b.date_provenance) == ("as_built", 0, "2024-05-01", "")
    X.write_lookup(spark.createDataFrame([("u2", "2024-01-H1"), ("u1", "2023-05-H2")], "key string, value string"), str(tmp_path / "starts"))
    starts = X.read_lookup(spark, str(tmp_path / "starts"))
    assert sorted(map(tuple, starts.collect())) == [("u1", "2023-05-H2"), ("u2", "2024-01-H1")]
    (tmp_path / "picks.json").write_text(json.dumps(["u3", "u1"]))
    picks = X.read_picks(spark, str(tmp_path / "picks.json"))
    assert [r.uid for r in X.unanchored(picks, starts.toDF("uid", "start")).collect()] == ["u3"]
    (tmp_path / "l1.csv").write_text("stage,unit_uid,parcel\nx,u1,p1\n")
    (tmp_path / "l2.csv").write_text("parcel,unit_uid\np2,u1\n")
    (tmp_path / "l3.csv").write_text("other\n1\n")
    links = X.read_headed(spark, [str(tmp_path / n) for n in ("l1.csv", "missing.csv", "l2.csv", "l3.csv")], ["unit_uid", "parcel"])
    assert sorted(map(tuple, links.collect())) == [("u1", "p1"), ("u1", "p2")]
    assert X.read_headed(spark, [str(tmp_path / "missing.csv")], ["a"]).collect() == []


def test_series_sink_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("u1", 1, 0.5), ("u2", 2, 0.25)], "uid string, ord int, ndvi double")
    T.write_documents(rows, str(tmp_path / "out"), "json")
    done = spark.read.schema("uid string, ord int, ndvi double").json(str(tmp_path / "out")).select("uid", "ord", "ndvi")
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, rows.collect()))
    jobs = spark.createDataFrame([("u1", 1), ("u1", 2)], "uid string, ord int")
    assert [tuple(r) for r in T.missing_jobs(jobs, done).collect()] == [("u1", 2)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        T.write_documents(rows, str(tmp_path / "out"), "json")


def test_interval_notes(spark):
    look = lambda s: O.start_interval(O.run_causal(spark.createDataFrame([(1, 48_000 + i, c != "-", c == "x") for i, c in enumerate(s)], "uid long, ord int, clear boolean, changed boolean"))).first()
    assert look("....").notes == ["no change ever detected: interval is open at the right"]
    assert look("xxxx").notes[0].startswith("no confirmed-unchanged observation")
    r = look("...-----xx")
    assert r.is_bounded and r.notes == [f"bracket is {r.width_days} days wide — cloud-limited; do not score this site to the fortnight"] and r.width_days > 45


def test_clear_fraction_fallback_and_series_reader(spark, tmp_path):
    import json

    row = lambda p, **k: {"period": p, "n_valid": 30, "valid_frac": 0.7, "ndvi": 0.1, **k}
    (tmp_path / "a.json").write_text(json.dumps({"site": {"uid": "u1"}, "series": [row("2024-01-H1"), row("2024-01-H2", clear_frac=0.2), row("2024-02-H1", n_valid=3)]}))
    (tmp_path / "b.json").write_text(json.dumps({"site": {"name": "x"}, "series": [row("2024-03-H2")]}))
    (tmp_path / "_skip.json").write_text(json.dumps({"site": {"uid": "no"}, "series": [row("2024-01-H1")]}))
    got = sorted((r.uid, r.period) for r in T.read_series(spark, str(tmp_path)).collect())
    assert got == [("b", "2024-03-H2"), ("u1", "2024-01-H1")]


def test_start_interval_and_slugs(spark):
    d = spark.createDataFrame([("  Nan ",), (None,), (" Big Site, LLC. ",)], "n string")
    assert [r[0] for r in d.select(T.clean_cell(F.col("n"))).collect()] == ["", "", "Big Site, LLC."]
    assert d.select(T.slug(F.col("n"), F.lit("0123456789"))).collect()[2][0] == "big-site-llc-01234567"
    obs = [(1, 48_000 + i, c != "-", c == "x") for i, c in enumerate("....x-xx")]
    call = O.start_interval(O.run_causal(spark.createDataFrame(obs, "uid long, ord int, clear boolean, changed boolean"))).first()
    assert (call.last_unchanged, call.first_changed, call.n_clear_after) == (48_003, 48_004, 3)


def test_greedy_match():
    p, n = pd.DataFrame({"uid": [1, 2], "area": [100.0, 200.0]}), pd.DataFrame({"uid": [8, 9], "area": [190.0, 110.0]})
    assert E.greedy_match(p, n).to_numpy().tolist() == [[9, 1], [8, 2]]


def _study(rng, n, first):
    return pd.DataFrame({"uid": range(first, first + n), "area": [float(rng.choice([1, 2, 3, 5, 8, 13, 21, 40])) for _ in range(n)]})


def test_greedy_match_against_a_scan():
    for seed in range(40):
        rng = random.Random(seed)
        p, n = _study(rng, rng.randrange(0, 12), 0), _study(rng, rng.randrange(0, 15), 100)
        left, expected = list(n.itertuples(index=False, name=None)), []
        for uid, area in p.sort_values("area", kind="stable").itertuples(index=False, name=None):
            if left:
                best = min(left, key=lambda r: (abs(np.log(r[1]) - np.log(area)), r[0]))
                left.remove(best)
                expected.append([best[0], uid])
        assert E.greedy_match(p, n).to_numpy().tolist() == expected


def test_extend_match_against_every_candidate():
    gap = lambda a, b: max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in {*a, *b})
    for seed in range(20):
        rng = random.Random(seed)
        p, n = _study(rng, 6, 0), _study(rng, 14, 100)
        pairs = E.greedy_match(p, n)
        area, chosen = dict(zip(n["uid"], np.log(n["area"]), strict=True)), list(pairs["negative"])
        while len(chosen) < 10:
            chosen.append(min((u for u in n["uid"] if u not in chosen), key=lambda u: gap([area[c] for c in [*chosen, u]], np.log(p["area"]))))
        design = E.extend_match(pairs, p, n, 10)
        assert design["negative"].tolist() == chosen and design["positive"].tolist()[6:] == [None] * 4
        starts = E.pseudo_starts(design, {u: 10 + u for u in p["uid"]})
        assert starts["start"].tolist()[:6] == [10 + u for u in pairs["positive"]] and starts.equals(E.pseudo_starts(design, {u: 10 + u for u in p["uid"]}))
        assert set(starts["start"]) <= set(range(10, 16))


def test_study_refuses_what_it_cannot_hold(spark):
    with pytest.raises(ValueError):
        E.study(spark.range(5).selectExpr("id AS uid", "1.0D AS area"), most=4)
