"""Mixing sources to target weights along a time-varying curriculum: DataFrame functions only.

Sizes are word counts. Sources, ordered by code point with null last, weigh
``weights`` in turn and share ``share`` times all words; a target stops at
``most`` times its source's size, and what is over is shared again by weight
until none is above (the level at which the capped shares add up, found on the
source table by one sorted running sum).

Each source also has a schedule: its share of the mix changes over training time
t in [0, 1] as the line ``1 + ramp * (1 - 2 t)``. The schedule's integral
is the source's cumulative demand for words; its inverse tells the time
at which the source's u-th word is due. Documents of a source queue in a fixed
pseudo-random order, pass after pass, and the running word count at which a
document starts is turned into its training position. The result is range-sorted
by position. The last document of a source may be taken in part.

A running sum over a hot source never runs in one task: documents are dealt to
about sqrt(n) buckets of the source, buckets are summed first, and each bucket
adds its own running sum to that of the buckets before it.

A null text has size 0; documents of size 0 are taken 0 times. Repeated rows are
documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm import _common as C

WORD = r"[^\x20\x09-\x0D]+"


def queue_key(doc_id: Column, text: Column) -> Column:
    """The pseudo-random place of a document in its source's queue: 60 bits of its doc_id's MD5 (of its text's, where doc_id is null)."""
    name = F.coalesce(doc_id.cast("long").cast("string"), F.md5(F.encode(text, "UTF-8")), F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 15), 16, 10).cast("long")


def sources_of(slim: DataFrame, weights: tuple[float, ...], share: float, most: float, ramps: tuple[float, ...]) -> DataFrame:
    """One row per source: source, source_size, rows, target, ramp."""
    base = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod("rank", F.lit(len(values))) + 1).cast("int"))
    ranked = base.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("ramp", pick(ramps))
    capped = ranked.withColumn("cap", most * F.col("source_size"))
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "rank")
    levels = (
        capped.withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("words", share * F.sum("source_size").over(full))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("above", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("try", (F.col("words") - F.col("below")) / F.col("above"))
        .withColumn("found", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "rank", "try"))).over(full)["try"])
    )
    target = F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "rows", target.alias("target"), "ramp")


def curriculum_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    ramps: tuple[float, ...] = (0.5, -0.5, 0.0),
) -> DataFrame:
    """One row per document, range-sorted by position.

    doc_id, source, text_hash, size, source_size, target, taken, position (null
    if nothing is taken) and placements, an array of (pass, words, position).
    """
    text = F.col("text").cast("string")
    slim = C.materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("text_hash"),
            queue_key(F.col("doc_id"), text).alias("h"),
        ),
        "sizes",
    )
    sources = C.materialize(sources_of(slim, weights, share, most, ramps), "sources")
    s = sources.withColumnRenamed("source", "s")
    dealt = slim.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("bucket", F.pmod("h", F.ceil(F.sqrt("rows")).cast("long")))
    buckets = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("to", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("from", F.col("before") + F.col("to") - F.col("size"))
        .withColumn("due", F.bround("target").cast("long"))
    )
    lap = lambda p: F.col("from") + p * F.col("source_size")
    words = lambda p: F.greatest(F.lit(0), F.least(F.col("due") - lap(p), F.col("size"))).cast("long")

    def position(p):
        u = lap(p) / F.col("due")
        a = 1 + F.col("ramp")
        return 2 * u / (a + F.sqrt(F.greatest(F.lit(0.0), a * a - 4 * F.col("ramp") * u)))

    def laps():
        each = [F.when(words(p) > 0, F.struct(F.lit(p).alias("pass"), words(p).alias("words"), position(p).alias("position"))) for p in range(int(-(-most // 1)))]
        return F.array_compact(F.array(*each))

    done = placed.withColumn("placements", laps())
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda t, x: t + x["words"])
    out = done.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"),
        F.get(F.col("placements"), F.lit(0))["position"].alias("position"), "placements",
    )
    return out.orderBy("position", "doc_id", "text_hash")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the order of their training
    positions, with all their columns. A document taken in part stays whole if half its words
    or more are taken.

    Rows alike in doc_id, source and text are one document to the reader: any one of them
    stands at each place that the mix gives to one of them.
    """
    key = ["d", "s", "t"]
    mix = curriculum_mix(docs, **how).select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_hash").alias("t"), "size", "placements")
    mix = C.materialize(mix, "mix")
    places = mix.withColumn("p", F.explode("placements")).where(2 * F.col("p.words") >= F.col("size")).select(*key, F.col("p.position").alias("position"))
    again = C.materialize(mix.groupBy(*key).count().where("count > 1").select(*key), "again")
    # the columns travel in one struct, so that no name of theirs can clash
    names = [F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), F.xxhash64(F.col("text").cast("string")).alias("t")]
    whole = docs.select(F.struct("*").alias("row"), *names)

    def same(other: DataFrame) -> Column:
        return F.col("d").eqNullSafe(other["d2"]) & F.col("s").eqNullSafe(other["s2"]) & (F.col("t") == other["t2"])

    second = {c: f"{c}2" for c in key}
    again, places = again.withColumnsRenamed(second), places.withColumnsRenamed(second)
    marked = whole.join(again, same(again), "left")
    single, twice = marked.where("t2 is null"), marked.where("t2 is not null").dropDuplicates(key)
    held = single.select("row", *key).unionAll(twice.select("row", *key))
    return held.join(places, same(places)).orderBy("position", "d", "t").select("row.*")
