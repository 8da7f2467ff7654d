"""Every registered query of the change-detection operators against its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from terrasift.operators import evaluate as E
from terrasift.plans import bindings
from terrasift.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: "null" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([cell(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    found = [tuple(r) for r in got.collect()]
    if name in ORACLE:
        expected = tables.sql(ORACLE[name])
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got.columns, found) == rows(expected.columns, expected.fetchall())


def test_bootstrap_paired(spark):
    """Pairs, not sites, are resampled: the estimate is the mean difference within the pairs."""
    got = QUERIES["bootstrap_paired"](spark, FOLDER).collect()
    area = {r.uid: r.n for r in bindings.series(spark, FOLDER).groupBy("uid").agg({"n": "sum"}).toDF("uid", "n").collect()}
    score = {r.uid: r.delta for r in QUERIES["onset_delta"](spark, FOLDER).collect()}
    side = lambda k: pd.DataFrame([(u, area[u]) for u in sorted(area) if u % 2 == k], columns=["uid", "area"])
    pairs = E.greedy_match(side(0), side(1))
    d = [score[a] - score[b] for b, a in pairs.itertuples(index=False) if score.get(a) is not None and score.get(b) is not None]
    assert len(got) == 1 and got[0].n == len(d) >= 3
    assert got[0].estimate == pytest.approx(np.mean(d), abs=1e-5)
    assert got[0].lo < got[0].estimate < got[0].hi
    assert got[0].verdict == ("SEPARATES" if got[0].lo > 0 else "wrong sign" if got[0].hi < 0 else "no separation")


def test_start_frequency(spark):
    got = QUERIES["start_frequency"](spark, FOLDER).collect()
    design = QUERIES["nearest_match"](spark, FOLDER).collect()
    assert sum(r.neg for r in got) == len(design)
    assert sum(r.pos for r in got) >= len({r.positive for r in design if r.positive is not None})


def test_study_parameters_are_those_of_the_reference(spark, monkeypatch):
    """10,000 draws for the AUC's interval; up to 4000 pixels a period and 60,000 a site."""
    drawn, bootstrap = [], E.bootstrap
    monkeypatch.setattr(E, "bootstrap", lambda d, kind, draws=20_000, **k: drawn.append((kind, draws)) or bootstrap(d, kind, draws, **k))
    assert QUERIES["bootstrap_auc"](spark, FOLDER).first().lo is not None
    assert drawn == [("auc", 10_000)]
    whole = bindings.pixels(spark, FOLDER)
    assert whole.groupBy("uid").count().agg({"count": "max"}).first()[0] <= 4000
    assert QUERIES["pixel_sample"](spark, FOLDER).count() == whole.count()


def test_pixel_sample_is_its_sql_beyond_the_bounds(spark, tmp_path):
    """Sites of more than 4000 and of more than 60,000 pixels come whole; the sample itself keeps its bounds."""
    from pyspark.sql import functions as F

    from terrasift.operators import spectral as S

    label = F.when(F.col("id") < 60_500, 1).when(F.col("id") < 65_000, 2).otherwise(None).cast("int")
    values = F.array(*[F.lit(0.5).cast("float")] * 6)
    spark.range(65_100).select(F.col("id").alias("vec_id"), values.alias("embedding"), label.alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = QUERIES["pixel_sample"](spark, str(tmp_path)).select("uid", "pix").collect()
    assert len(got) == 65_100
    assert rows(["uid", "pix"], got) == rows(["uid", "pix"], c.sql(ORACLE["pixel_sample"]).fetchall())
    p = bindings.pixels(spark, str(tmp_path)).withColumns({"ord": F.col("pix") % 16, "y": F.col("pix"), "x": F.lit(0)})
    sizes = {r.uid: r["count"] for r in S.sampled(p, 3000, 40_000).groupBy("uid").count().collect()}
    assert sizes == {1: 40_000, 2: 4500, None: 100}
    assert max(r["count"] for r in S.sampled(p, 3000, None).groupBy("uid", "ord").count().collect()) == 3000
