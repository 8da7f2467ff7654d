"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased; shingles are five words (an item of fewer words is one shingle as
long as itself). An item leaks into a document if at least ``threshold`` of the
item's distinct shingles are in the document.

A short item's overlap with a long document is tiny next to the document, so a
signature of the whole document says nothing. Items are partitioned by size
(powers of two of their shingle count q); for each partition the document is cut
into blocks of that partition's upper size, and each block has a MinHash value
for each of 64 functions. An item is a candidate if any of its 64 values
equals one of a block's (bands of one row). However the shared shingles lie, a
contained item expects at least 64 * 0.75 q / (block + q) >= 16 such matches,
so it is missed with a probability of about 1e-7. Blocks of larger partitions
are made from those of smaller ones by minima of pairs.

Candidates are verified in the same pass: the share of the item's shingles that
the whole document holds. Documents are only mapped over, never shuffled.
The benchmark is read in blocks of at most ``block_mb`` MB of text, each sent to
the tasks with the function.

Null or empty texts and items match nothing. A repeated item_id is one row for
each of its texts; repeated documents are reported as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

SHINGLE, FUNCTIONS, THRESHOLD = 5, 64, 0.75

_MULTIPLY = C._splitmix(401, FUNCTIONS) | np.uint64(1)
_ADD = C._splitmix(503, FUNCTIONS)


class Items:
    """The distinct shingles and MinHash values of one block of the benchmark."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = C.texts_of(pa.array(texts, pa.string()))
        hashes, first = C.words(data, offsets, C.ALNUM)
        n_words = np.diff(first)
        self.groups: list[tuple] = []  # (words in a shingle, [(level, table, [sorted values, items of them] of each function)])
        self.ids, self.sets = [], []
        for n in range(1, SHINGLE + 1):
            here = np.flatnonzero(n_words >= SHINGLE if n == SHINGLE else n_words == n)
            if not len(here):
                continue
            values, begin = C.distinct_sets(*C.shingles(hashes, first, n))
            levels: dict[int, list[int]] = {}
            for k in here:
                own = values[begin[k] : begin[k + 1]]
                levels.setdefault(len(own).bit_length(), []).append(len(self.ids))
                self.ids.append(ids[k])
                self.sets.append(own)
            partitions = []
            for level in sorted(levels):
                member = np.array(levels[level])
                lows = np.array([[(self.sets[i] * _MULTIPLY[f] + _ADD[f]).min() for f in range(FUNCTIONS)] for i in member], np.uint64)
                order = np.argsort(lows, axis=0)
                partitions.append((level, [(np.take_along_axis(lows, order, 0)[:, f].copy(), member[order[:, f]], _table(lows[:, f])) for f in range(FUNCTIONS)]))
            self.groups.append((n, partitions))


def _table(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, dtype=bool)
    table[(values >> np.uint64(48)).astype(np.int64)] = True
    return table


def _halve(lows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of neighbouring blocks of the same text."""
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    within = np.arange(len(lows)) - np.repeat(begin, counts)
    return np.minimum.reduceat(lows, np.flatnonzero(within % 2 == 0)), (counts + 1) // 2


def find(items: Items, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) for the leaks into a batch of texts."""
    hashes, first = C.words(data, offsets, C.ALNUM)
    n_words = np.diff(first)
    for n, partitions in items.groups:
        values, begin = C.shingles(hashes, first, n)
        if n > 1 and (n_words < n).any():  # a shorter text has no shingle of n words
            short = np.repeat(n_words < n, np.diff(begin))
            counts = np.where(n_words < n, 0, np.diff(begin))
            values, begin = values[~short], np.concatenate([[0], np.cumsum(counts)])
        counts = np.diff(begin)
        if not len(values):
            continue
        size = 1 << partitions[0][0]
        blocks = -(-counts // size)
        owner_begin = np.concatenate([[0], np.cumsum(blocks)])
        within = np.arange(owner_begin[-1]) - np.repeat(owner_begin[:-1], blocks)
        cut = np.repeat(begin[:-1], blocks) + within * size
        pairs: set[tuple[int, int]] = set()
        for f in range(FUNCTIONS):
            lows, left, level = np.minimum.reduceat(values * _MULTIPLY[f] + _ADD[f], cut), blocks, partitions[0][0]
            for at, functions in partitions:
                while level < at:
                    lows, left = _halve(lows, left)
                    level += 1
                known, who, table = functions[f]
                hits = np.flatnonzero(table[(lows >> np.uint64(48)).astype(np.int64)])
                if len(hits):
                    a, b = np.searchsorted(known, lows[hits], "left"), np.searchsorted(known, lows[hits], "right")
                    text = np.repeat(np.arange(len(left)), left)[hits[b > a]]
                    for t, x, y in zip(text, a[b > a], b[b > a], strict=True):
                        pairs.update((int(t), int(i)) for i in who[x:y])
        held = -1
        for t, i in sorted(pairs):
            if t != held:
                mine, held = np.unique(values[begin[t] : begin[t + 1]]), t
            own = items.sets[i]
            at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
            shared = int((mine[at] == own).sum())
            if shared >= threshold * len(own):
                yield t, i, shared


def item_blocks(benchmark: DataFrame, block_mb: float = 32) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(-(-size // (block_mb * 1e6))))
    for i in range(n):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("item_id", "text").collect() if size else []
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows])


def _leaks(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.texts_of(batch.column("text"))
            ids, out = batch.column("doc_id"), []
            for lo, hi in C.pieces(offsets, 1 << 19):
                part = offsets[lo : hi + 1]
                out += [(lo + t, i, s) for t, i, s in find(items, data[part[0] : part[-1]], part - part[0], threshold)]
            n_item = np.array([len(items.sets[i]) for _, i, _ in out], np.int64)
            shared = np.array([s for *_, s in out], np.int64)
            columns = [ids.take(pa.array([t for t, *_ in out], pa.int64())), pa.array([items.ids[i] for _, i, _ in out], pa.int64()), pa.array(shared), pa.array(n_item), pa.array(shared / np.maximum(n_item, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shared", "n_item", "containment"])
        C.release()

    return run


_PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_mb: float = 32) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each item found in a document."""
    spark = docs.sparkSession
    C.ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, block_mb):
        found = slim.mapInArrow(_leaks(items, threshold), _PAIRS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _PAIRS) if out is None else out


def _clean(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.texts_of(batch.column("text"))
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in C.pieces(offsets, 1 << 19):
                part = offsets[lo : hi + 1]
                for t, *_ in find(items, data[part[0] : part[-1]], part - part[0], threshold):
                    keep[lo + t] = False
            yield batch.filter(pa.array(keep))
        C.release()

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_mb: float = 32) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    C.ship(docs.sparkSession)
    for items in item_blocks(benchmark, block_mb):
        docs = docs.mapInArrow(_clean(items, threshold), docs.schema)
    return docs
