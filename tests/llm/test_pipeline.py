"""The pipeline's stages on a small corpus."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from terrasift.llm.queries import tokenizer_path
from tests.llm.test_operators import SCHEMA, components, leaked, made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in made(2) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    words = rows[0][1].split()
    spark.createDataFrame([(1, " ".join(words[:12]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    named = P.language(spark, docs, folder)
    assert named.columns == docs.columns
    assert {r.doc_id for r in named.collect()} == {r[0] for r in rows} - {60, 61, 62}
    one = P.near_duplicates(spark, named, folder)
    assert sorted(r.doc_id for r in one.collect()) == sorted({e[0] for e in components([tuple(r) for r in named.collect()]) if e[3]})
    clean = P.decontamination(spark, one, folder)
    item = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    gone = {d for d, *_ in leaked([(r.doc_id, r.text) for r in one.collect()], item)}
    assert gone
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - gone
    mixed = P.mixing(spark, clean, folder)
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in mixed.collect()]
    mixed.write.parquet(f"{folder}/mixed.parquet")
    mixed = spark.read.parquet(f"{folder}/mixed.parquet")
    texts = sorted((r.doc_id, r.text) for r in mixed.collect())
    out = sorted(tuple(r) for r in P.token_output(spark, mixed, folder).collect())
    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start = 0
    for (d, text), got in zip(texts, out, strict=True):
        ids = [*tk.encode(text, add_special_tokens=False).ids, 0]
        assert got[:4] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r[0] for r in sorted(out, key=lambda r: r[4])] == order


def test_run(spark, folder):
    assert P.run(spark, folder).count() > 0
    assert [name for name, _ in P.STAGES][0] == "language ID"
