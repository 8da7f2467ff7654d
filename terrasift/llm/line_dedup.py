"""Line dedup: DataFrame functions only.

Each text is split at newlines (a null or empty text is one empty line). A
line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Keys of ``min_chars`` code points or more found in ``min_docs`` documents or
more lose all their lines but those in the smallest doc_id that holds them.

The lines are exploded once and hashed (128 bits); documents are counted for
each hash by a pre-aggregated group-by, so a line found everywhere costs one
row a task. Hashes above the threshold come back to their lines by a join that
adaptive execution may split, the positions to drop are gathered by document,
and each text is rebuilt from the positions that stay.

A document is a doc_id; rows that repeat one are rebuilt each by its own text. A
null doc_id counts as one document behind all others. Extra columns are kept by
``drop_repeated_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that to an all-ASCII text, and fast."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """d (doc_id), t (a hash of the text) and the array ``gone`` of line positions to drop, where there are any."""
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = lines.select("d", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = C.materialize(keyed.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "lines")
    named = F.count_distinct("d") if min_docs > 2 else F.when(F.min("d") < F.max("d"), 2).otherwise(F.count_if(F.col("d").isNotNull()).cast("boolean").cast("int"))
    nameless = F.max(F.col("d").isNull()).cast("int")
    common = hashed.groupBy("h1", "h2").agg(F.min("d").alias("holder"), (named + nameless).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    # written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot hash
    common = C.materialize(common.select("h1", "h2", "holder"), "common")
    drop = hashed.join(common, ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("holder")))
    return drop.groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))


def _rebuilt(docs: DataFrame, **limits: int) -> DataFrame:
    """row (all columns), lines, gone (null: none) and kept (the text rebuilt)."""
    drop = dropped_positions(docs, **limits).select(F.col("d").alias("d2"), F.col("t").alias("t2"), "gone")
    # the columns travel in one struct, so that no name of theirs can clash
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))
    joined = keyed.join(drop, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    split = joined.select("row", "gone", lines_of(text).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.transform(F.array_except(every, "gone"), lambda i: F.get("lines", i))
    return split.withColumn("kept", F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stay, "\n")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the text of each row rebuilt; a null text stays null."""
    done = _rebuilt(docs, min_chars=min_chars, min_docs=min_docs)
    return done.select(F.col("row").withField("text", F.when(F.col("row.text").isNotNull(), F.col("kept"))).alias("row")).select("row.*")


def line_report(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    done = _rebuilt(docs.select("doc_id", "text"), min_chars=min_chars, min_docs=min_docs)
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
