"""Shared plumbing of the training-data operators.

* ``scratch_dir`` / ``materialize``: cut lineage with a Parquet table in the
  folder that the cluster shares (``spark.checkpoint.dir``).
* ``ship``: make this package importable in Python workers.
* ``components``: distributed connected components over an edge table; ``folded``: the same over arrays.
* NumPy kernels that split and hash the words of a whole Arrow batch of texts.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrasift.functions.session import ship  # noqa: F401
from terrasift.operators import graph
from terrasift.operators.graph import folded  # noqa: F401

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where it is unset (local tests), one in the warehouse, which they share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the process ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Shuffle files go when the statement that wrote them ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute, so a lost executor costs nothing,
    and each later use reads only the columns it needs. The shuffle files of the
    write are deleted after it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --------------------------------------------------------------------------
# connected components


def components(edges: DataFrame) -> DataFrame:
    """``graph.components`` with its rounds as tables in the shared folder."""
    return graph.components(edges, lambda df: materialize(df, "cc"))


# --------------------------------------------------------------------------
# text kernels

_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit constants from a seed."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _splitmix(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_BYTES = _BYTES[_LOWER]
_SHINGLE = _splitmix(29, 64) | np.uint64(1)
_SHORT = _splitmix(53, 64)

#: Word bytes: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: ASCII letters and digits and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array, and their n + 1 offsets. Nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system at a task's end: workers outlive tasks, and idle ones count in an executor's memory."""
    if len(_powers[0]) > 2 * SEGMENT:  # after a word longer than a segment
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of whole texts of about ``most`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Bytes hashed at once: longer runs of texts are cut ahead of a byte that is in no word.
SEGMENT = 1 << 20


def _word_ends(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one segment, in which texts begin at ``edges``."""
    n = len(data)
    w = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1] | edge[1:n]
    end[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWERED_BYTES[data] * power[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and, per text, the first word's index (n + 1 long)."""
    n, lo = len(data), 0
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while lo < n:
        hi = min(n, lo + SEGMENT)
        while hi < n and inside[data[hi]]:
            gap = np.flatnonzero(~inside[data[hi : hi + SEGMENT]])
            hi = min(n, hi + (int(gap[0]) if len(gap) else SEGMENT))
        a, b = np.searchsorted(offsets, [lo, hi])
        h, s = _word_ends(data[lo:hi], offsets[a:b] - lo, inside)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and, per text, the index of its first one.

    A text of fewer than n words (but any) has its whole sequence as one.
    """
    counts = np.diff(first)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    if len(hashes) >= n:
        every = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            every += hashes[j : len(hashes) - n + 1 + j] * _SHINGLE[j]
        long = counts >= n
        place = np.repeat(first[:-1][long] - begin[:-1][long], out_counts[long])
        spots = np.flatnonzero(np.repeat(long, out_counts))
        out[spots] = mix64(every[spots + place])
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        c = int(counts[k])
        out[begin[k]] = mix64(np.sum(hashes[first[k] : first[k + 1]] * _SHINGLE[:c], dtype=np.uint64, keepdims=True) + _SHORT[c])[0]
    return out, begin


def distinct_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and distinct, with the new offsets."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values = values[keep]
    return values, np.searchsorted(owner[keep], np.arange(len(begin)))
