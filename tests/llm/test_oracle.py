"""Every training-data query that has SQL against it."""

import os

import duckdb
import pytest

from terrasift.llm.oracle import oracle_sql
from terrasift.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got, expected = queries()[name](spark, FOLDER), c.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda names, data: sorted(str([cell(r[names.index(c)]) for c in columns]) for r in data)
    assert rows(got.columns, map(tuple, got.collect())) == rows(expected.columns, expected.fetchall())
