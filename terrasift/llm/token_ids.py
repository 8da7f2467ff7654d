"""Token-id output: id blocks with Elias-Fano coded document boundaries.

Texts are encoded with a byte-level BPE of the ``tokenizers`` library, and the
end id follows each document. Ids are written in ascending doc_id order (null
doc_ids first; rows that share one by their ids) in block files:

    magic "TSID" | u8 version | u8 id width (2 or 4) | u8 low bits l | u8 0
    | u64 documents n | u64 ids m | low parts, n * l bits | high parts, unary,
    n + (m >> l) + 1 bits | ids, little-endian

The n end offsets of the documents over the block's id array are Elias-Fano
coded in n * (2 + log2(m / n)) bits, with no table of 64-bit offsets:
``select(i)`` is the place of the i-th one in the high part, found by a popcount
directory built on reading, less i, joined with the i-th low part.

A block is one row of a Parquet table (shard, block, its doc_ids, its bytes),
so Spark's committer makes writing safe when executors are lost, on any store.
Shards are ranges of doc_id, from quantiles of the doc_id column alone. A
document's global start is its shard's start (sums of whole shards, a bounded
table) plus its block's start in the shard plus its offset in the block. Reading a
whole block takes all its offsets at once with ``decode``, which expands them into an
array of 64-bit offsets for that block; ``select`` is for single documents.

Encoding works by pieces: a byte-level BPE of this kind never joins across a
white space that stands between other characters, so texts are cut there, and
each distinct piece is encoded once per worker and then looked up. A text that
holds an added token of the tokenizer (``<|endoftext|>``) is encoded whole, with
that token as its own id, as the library does by default.

A block also holds the positions of its documents, where the caller gives any
(``row_order``: the training order in which a mix was written).

Null and empty texts are the end id alone. Repeated rows are written each. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

MAGIC = b"TSID"
#: Bytes of ids in a block, unless one document has more.
BLOCK_BYTES = 8 << 20
#: Distinct words that a worker remembers: those of the current generation and as many of the last.
MEMORY = 600_000
#: Characters of the longest word that is remembered beyond its batch.
LONGEST = 48
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# ------------------------------------------------------------- Elias-Fano


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Each value's ``width`` low bits, least first."""
    if width == 0 or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class EliasFano:
    """A non-descending sequence with select in near-minimal space."""

    SAMPLE = 64  # bytes of the high part under one directory entry

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        ones = np.bitwise_count(np.frombuffer(high, np.uint8)).astype(np.int64)
        self.directory = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.SAMPLE)))]) if len(ones) else np.zeros(1, np.int64)

    @staticmethod
    def width(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @staticmethod
    def sizes(n: int, universe: int, low_bits: int) -> tuple[int, int]:
        return (n * low_bits + 7) // 8, (n + (universe >> low_bits) + 1 + 7) // 8

    @classmethod
    def encode(cls, ends: np.ndarray, universe: int) -> EliasFano:
        n, width = len(ends), cls.width(len(ends), universe)
        ends = ends.astype(np.uint64)
        high = np.zeros(cls.sizes(n, universe, width)[1] * 8, np.uint8)
        high[(ends >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, universe, width, pack_bits(ends, width), np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, reading one stretch of the high part."""
        at = int(np.searchsorted(self.directory, i, "right")) - 1
        stretch = np.unpackbits(np.frombuffer(self.high, np.uint8, offset=at * self.SAMPLE, count=min(self.SAMPLE, len(self.high) - at * self.SAMPLE)), bitorder="little")
        place = at * self.SAMPLE * 8 + int(np.flatnonzero(stretch)[i - int(self.directory[at])])
        low, first = 0, i * self.low_bits
        if self.low_bits:
            part = self.low[first // 8 : (first + self.low_bits + 7) // 8]
            low = (int.from_bytes(part, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return ((place - i) << self.low_bits) | low

    def decode(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return (((high - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | unpack_bits(self.low, self.low_bits, self.n)).astype(np.int64)


def write_block(documents: list[bytes], width: int) -> bytes:
    """A block file of documents given as little-endian ids of ``width`` bytes."""
    ends = np.cumsum([len(d) // width for d in documents], dtype=np.int64)
    m = int(ends[-1]) if len(ends) else 0
    ef = EliasFano.encode(ends, m)
    return b"".join([MAGIC, struct.pack("<BBBBQQ", 1, width, ef.low_bits, 0, ef.n, m), ef.low, ef.high, *documents])


def read_block(data: bytes) -> tuple[EliasFano, np.ndarray]:
    """The boundaries and the ids of a block file."""
    if data[:4] != MAGIC:
        raise ValueError("not an id block")
    version, width, low_bits, _, n, m = struct.unpack_from("<BBBBQQ", data, 4)
    if version != 1:
        raise ValueError(f"version {version}")
    low, high = EliasFano.sizes(n, m, low_bits)
    at = 4 + struct.calcsize("<BBBBQQ")
    ef = EliasFano(n, m, low_bits, data[at : at + low], data[at + low : at + low + high])
    return ef, np.frombuffer(data, f"<u{width}", count=m, offset=at + low + high)


# --------------------------------------------------------------- encoding

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, each distinct piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes out of a text before it cuts; a text with one goes to it whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # byte-level: one character for each byte
        self.known: dict[str, bytes] = {}  # pre-tokens that no space starts, and first words
        self.after: dict[str, bytes | bool] = {}  # by what follows a space; False: not a piece of its own
        self.older: dict[str, bytes | bool] = {}  # the generation before
        self.passing: list[tuple[dict, str]] = []  # long words, forgotten after their batch
        # where the byte-level pre-tokenizer cuts
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    @staticmethod
    def _alone(x: str) -> bool:
        """Whether a space and ``x`` are cut from what is around them."""
        return bool(x) and not (x[0].isspace() or x[-1].isspace() or x[0] in _SPACES or x[-1] in _SPACES)

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """Encode pre-tokens that start with a space and end otherwise, many in one text, cut again by byte lengths."""
        out, kind, width = [], f"<u{self.width}", self.width
        runs = [parts[lo : lo + 512] for lo in range(0, len(parts), 512)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            sizes = [len(p) if p.isascii() else len(p.encode()) for p in run]
            stops = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * width
            data, at = ids.tobytes(), 0
            for stop in stops.tolist():
                out.append(data[at:stop])
                at = stop
        return out

    def _one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Put the parts, and the words that they are made of, into ``after``."""
        after, known = self.after, self.known
        # a word, or one before a stop or comma, with the space before it: cut without the pattern
        plain, tailed, odd = [], [], []
        for x in parts:
            if x.isalpha():
                plain.append(x)
            elif x[-1:] in (".", ",") and x[:-1].isalpha():
                tailed.append(x)
            else:
                odd.append(x)
        led = set(plain)
        led.update([w for w in [x[:-1] for x in tailed] if w not in after])
        cuts = {x: self.cut(" " + x) if self._alone(x) else [] for x in odd}
        tokens = {t for c in cuts.values() for t in c}
        own = {t for t in tokens if t[0] == " " and self._alone(t[1:])}
        led.update([t[1:] for t in own if t[1:] not in after])
        rest = [t for t in {*tokens.difference(own), ".", ","} if t not in known]
        words = list(led)
        after.update(zip(words, self._side_by_side([" " + x for x in words]), strict=True))
        known.update(zip(rest, self._one_by_one(rest), strict=True))
        ends = {c: known[c] for c in ".,"}
        after.update([(x, after[x[:-1]] + ends[x[-1]]) for x in tailed])
        for x, c in cuts.items():
            if len(c) != 1 or c[0] not in own:
                after[x] = b"".join([after[t[1:]] if t in own else known[t] for t in c]) if c else False
        self.passing += [(after, x) for x in words if len(x) > LONGEST] + [(known, t) for t in rest if len(t) > LONGEST]
        self.passing += [(after, x) for x in parts if len(x) > LONGEST]

    def _whole(self, text: str) -> bytes:
        """Without cutting at spaces."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}").tobytes()

    def _odd(self, parts: list[str], here: dict) -> bytes:
        """A text some of whose spaces stand beside other white space: cut at the rest."""
        out, held = [], parts[0]
        for a, b in zip(parts, parts[1:], strict=False):
            if self._alone(a) and self._alone(b):
                out.append(held)
                held = " " + b
            else:
                held += " " + b
        return b"".join(here[h[1:]] if h[:1] == " " and here.get(h[1:]) else self._whole(h) for h in [*out, held])

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each whole text and the end id, little-endian."""
        stop = int(end).to_bytes(self.width, "little")
        out = []
        for lo in range(0, len(texts), 512):
            some = texts[lo : lo + 512]
            split = [None if not t or any(a in t for a in self.added) else t.split(" ") for t in some]
            has, missing = self.after.__contains__, set()
            for x in split:
                if x:
                    missing.update(filterfalse(has, x))
            if missing and len(self.after) + len(missing) > MEMORY:
                self.older, self.after = self.after, {}
                missing = set().union(*filter(None, split))
            if missing:
                old = {x: ids for x in missing if (ids := self.older.get(x)) is not None}
                self.after.update(old)
                if len(old) < len(missing):
                    self._learn([x for x in missing if x not in old])
            here = self.after
            if len(self.known) > MEMORY:
                self.known.clear()
            get = here.__getitem__
            # first parts have no space before them
            heads = list({x[0] for x in split if x and x[0] not in self.known})
            self.known.update(zip(heads, self._one_by_one(heads), strict=True))
            self.passing += [(self.known, h) for h in heads if len(h) > LONGEST]
            for text, parts in zip(some, split, strict=True):
                if parts is None:
                    out.append(self._whole(text) + stop if text else stop)
                    continue
                if len(parts) > 1 and not self._alone(parts[0]):
                    out.append(self._odd(parts, here) + stop)
                    continue
                try:
                    rest = b"".join(map(get, parts[1:]))
                except TypeError:  # a False among them
                    out.append(self._odd(parts, here) + stop)
                else:
                    out.append(self.known[parts[0]] + rest + stop)
            for held, word in self.passing:
                held.pop(word, None)
            self.passing.clear()
        return out


def _tokenize(path: str, end: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, edges = Encoder.of(path), np.array(bounds, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                doc, place = part.column("doc_id"), part.column("position")
                shard = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, doc.fill_null(0).to_numpy(), "left"))
                ids = pa.array(encoder.encode(part.column("text").to_pylist(), end), pa.binary())
                yield pa.RecordBatch.from_arrays([doc, place, pa.array(shard, pa.int32()), ids], names=["doc_id", "position", "shard", "ids"])
        C.release()

    return run


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places, held, size, at, block, shard = [], [], [], 0, 0, 0, None

        def flush():
            nonlocal names, places, held, size, at, block
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.int64()), pa.array([size // width], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.int64())), pa.array([write_block(held, width)], pa.binary())],
                names=["shard", "block", "start", "n_ids", "doc_ids", "positions", "data"],
            )
            at, block = at + size // width, block + 1
            names, places, held, size = [], [], [], 0
            return row

        for batch in batches:
            shards = batch.column("shard").to_pylist()
            for s, d, place, ids in zip(shards, batch.column("doc_id").to_pylist(), batch.column("position").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                if held and (s != shard or size + len(ids) > BLOCK_BYTES):
                    yield flush()
                if s != shard:
                    shard, at, block = s, 0, 0
                names.append(d)
                places.append(place)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()
        C.release()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 0, shards: int | None = None, position: Column | None = None) -> None:
    """Encode ``docs`` and write the id blocks as a table at ``path``; ``position`` (long) goes with each document."""
    spark = docs.sparkSession
    C.ship(spark)
    shards = shards or C.shuffle_partitions(spark)
    place = F.lit(None).cast("long") if position is None else position
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("position"), F.col("text").cast("string").alias("text"))
    cuts = [F.lit(i / shards) for i in range(1, shards)]
    bounds = slim.agg(F.percentile_approx("doc_id", F.array(*cuts), 100 * shards)).first()[0] if cuts else None
    width = Encoder.of(tokenizer).width
    bounds = sorted(set(bounds or []))
    coded = slim.mapInArrow(_tokenize(tokenizer, end, bounds), "doc_id long, position long, shard int, ids binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids", "position")
    blocks = ordered.mapInArrow(_blocks(width), "shard int, block int, start long, n_ids long, doc_ids array<long>, positions array<long>, data binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _documents(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, names, places, data in zip(*[batch.column(c) for c in ("shard", "start", "doc_ids", "positions", "data")], strict=True):
                boundaries, ids = read_block(data.as_py())
                ends = boundaries.decode()
                begin = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].data) for a, b in zip(begin, ends, strict=True)]
                first = base[shard.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays(
                    [names.values.cast(pa.int64()), pa.array(begin + first, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64()), places.values.cast(pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "position"],
                )
        C.release()

    return run


def read_documents(docs_path: str, spark) -> DataFrame:
    """Per document of the block table at ``docs_path``: doc_id, start, n_tokens, ids_crc32, position."""
    C.ship(spark)
    blocks = spark.read.parquet(docs_path)
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, so_far = {}, 0
    for shard, n in totals:
        base[shard], so_far = so_far, so_far + n
    return blocks.select("shard", "start", "doc_ids", "positions", "data").mapInArrow(
        _documents(base), "doc_id long, start long, n_tokens long, ids_crc32 long, position long"
    )


def row_order(docs: DataFrame) -> Column:
    """A long that ascends with the rows of a Parquet table as it was written (null for any other frame): part number, then row.

    The mixing stage range-sorts its rows, so in the pipeline this is the order in which the mix wants to train.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    made = F.shiftleft(part, 40) + F.col("_metadata.row_index")
    try:
        docs.select(made)
    except AnalysisException:  # not the scan of a file
        return F.lit(None).cast("long")
    return made


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 0, position: Column | None = None) -> DataFrame:
    """Write the id blocks and report them as read back."""
    path = path or C.new_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path, end, position=position)
    read = read_documents(path, docs.sparkSession)
    return read.drop("position") if position is None else read
