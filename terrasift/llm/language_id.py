"""Language ID by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes holds the counts
of a bounded training sample, then frozen. PPM with escape method C and full
exclusion: in a context with n symbols, d of them distinct, a seen byte has
probability count / (n + d); the escape d / (n + d) falls to the next shorter
context, in which the bytes already excluded lose their share. Below order 0
all bytes not seen are alike. Every context's probabilities add up to 1, so a
text's score is its exact code length in bits under each language's tree, and
the shortest wins.

The trees of all languages share one automaton whose states are the union of
their contexts. A state only depends on the last ``order`` bytes, so a long text
is cut into stretches that start ``order`` bytes early, and all stretches of a
batch are walked side by side in NumPy.

Training sample (its bounds are parameters): of the documents given, of every
language, the first ``per_language`` distinct texts. Texts of at most ``max_bytes``
bytes come first, by a hash of the text, and longer ones after them, the shortest
first; the sample ends before the text at which it has ``per_language`` times
``max_bytes`` bytes. So each text learnt from is whole, and a language with
long texts only is learnt from the shortest of those.

Predictions read the text alone. A null text, or one without a letter, is
``und`` with score 0 and no code length. Ties fall to the first language by code
point; without any training document every text is ``und``. Repeated rows are
predicted each. Extra columns are ignored (``identified`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm import _common as C

ORDER, STRETCH = 3, 512
PER_LANGUAGE, MAX_BYTES = 64, 16_384
#: Shares that the rows of a language are ranked in before they are ranked together.
SHARES = 32
#: A text that costs more bits a byte than this (raw bytes cost 8) in every language is in none of them.
REJECT_BITS = 12.0


def training_rows(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of the bounded sample; only hashes and sizes of other rows move."""
    text = F.col("text").cast("string")
    known = docs.where(train & text.isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text.alias("text"))
    known = known.where(F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    marked = known.select("lang", F.greatest(size, F.lit(max_bytes)).alias("over"), F.xxhash64("text").alias("h"), size.alias("size")).distinct()
    # a language may hold a third of all rows: the first of each of its shares, then the first of those
    share = Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy("over", "h")
    marked = marked.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= per_language)
    first = Window.partitionBy("lang").orderBy("over", "h")
    ranked = marked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
    so_far = F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, -1))
    taken = ranked.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < per_language * max_bytes)
    cut = taken.groupBy("lang").agg(F.max(F.struct("over", "h")).alias("last"))
    # the cut of each language is one row; all languages learnt are in the model anyway
    last = F.broadcast(cut.select(F.col("lang").alias("l"), "last"))
    upto = F.struct(F.greatest(size, F.lit(max_bytes)).alias("over"), F.xxhash64("text").alias("h")) <= F.col("last")
    rows = known.join(last, F.col("lang") == F.col("l")).where(upto).select("lang", "text").dropDuplicates(["lang", "text"]).collect()
    return sorted((r[0], r[1]) for r in rows)


class Model:
    """The frozen trees of all languages as one automaton with a code length per language, state and symbol."""

    def __init__(self, rows: list[tuple[str, str]], order: int = ORDER):
        self.order = order
        self.languages = sorted({lang for lang, _ in rows})
        counts = [self._counts([t.encode() for lang, t in rows if lang == name]) for name in self.languages]
        seen = sorted({s for c in counts for s in c[b""]} if counts else [])
        # bytes that no language has seen cost the same everywhere: one symbol stands for them
        self.symbol = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.int64)
        for i, b in enumerate(seen):
            self.symbol[b] = i
        n = len(seen) + 1
        states = sorted({ctx for c in counts for ctx in c}, key=lambda x: (len(x), x)) or [b""]
        place = {ctx: i for i, ctx in enumerate(states)}
        self.n_symbols = n
        self.next = np.zeros((len(states), n), np.int32)
        self.bits = np.zeros((len(states), n, max(1, len(self.languages))), np.float32)
        suffix = [place[ctx[1:]] if ctx else -1 for ctx in states]
        for i, ctx in enumerate(states):
            shorter = self.next[suffix[i]] if ctx else None
            for s, b in enumerate(seen):
                longer = ctx + bytes([b])
                self.next[i, s] = place[longer] if len(ctx) < order and longer in place else (shorter[s] if ctx else 0)
        for k, c in enumerate(counts):
            p = np.zeros((len(states), n))
            for i, ctx in enumerate(states):
                at = c.get(ctx)
                if at is None:
                    p[i] = p[suffix[i]]
                    continue
                where = self.symbol[list(at)].astype(np.int64)
                total, kinds = sum(at.values()), len(at)
                if ctx:
                    lower = p[suffix[i]].copy()
                    # mass of all 256 bytes that is left below, unseen bytes counted each
                    left = 1.0 - lower[where].sum()
                    lower[where] = 0.0
                    if kinds == 256:  # nothing to escape to
                        p[i, where] = np.array(list(at.values())) / total
                        continue
                    p[i] = lower * (kinds / (total + kinds) / left)
                else:
                    p[i] = kinds / (total + kinds) / max(1, 256 - kinds)
                p[i, where] = np.array(list(at.values())) / (total + kinds)
            # zero only where all 256 bytes are seen, at the slot of those that no language has
            self.bits[:, :, k] = -np.log2(np.where(p > 0, p, 1.0))
        self._flat_next = self.next.reshape(-1)
        self._flat_bits = self.bits.reshape(-1, self.bits.shape[2])

    def _counts(self, texts: list[bytes]) -> dict[bytes, dict[int, int]]:
        out: dict[bytes, dict[int, int]] = {b"": {}}
        for k in range(self.order + 1):
            keys: list[np.ndarray] = []
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.uint64)
                x = np.zeros(max(0, len(b) - k), np.uint64)
                for j in range(k + 1):
                    x = (x << np.uint64(8)) | b[j : len(b) - k + j]
                keys.append(x)
            values, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
            for v, m in zip(values.tolist(), n.tolist(), strict=True):
                out.setdefault((v >> 8).to_bytes(k, "big"), {})[v & 255] = m
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) bits of each whole text."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        parts = -(-size // STRETCH)
        owner = np.repeat(np.arange(n), parts)
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][owner] + within * STRETCH
        stop = np.minimum(begin + STRETCH, offsets[1:][owner])
        warm = np.where(within > 0, self.order, 0)
        order = np.argsort(-(stop - begin), kind="stable")
        owner, begin, stop, warm = owner[order], begin[order], stop[order], warm[order]
        symbols = self.symbol[data].astype(np.int64)
        state = np.zeros(len(owner), np.int64)
        for back in range(self.order, 0, -1):
            some = np.flatnonzero(warm >= back)
            if len(some):
                state[some] = self._flat_next[state[some] * self.n_symbols + symbols[begin[some] - back]]
        length = stop - begin
        bits = np.zeros((len(owner), self.bits.shape[2]), np.float64)
        ends = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for t, m in enumerate(ends.tolist()):
            at = state[:m] * self.n_symbols + symbols[begin[:m] + t]
            bits[:m] += self._flat_bits[at]
            state[:m] = self._flat_next[at]
        out = np.zeros((n, self.bits.shape[2]))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, weights=bits[:, k], minlength=n)
        return out


def fit(docs: DataFrame, train: Column, order: int = ORDER, **bounds) -> Model:
    return Model(training_rows(docs, train, **bounds), order)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            data, offsets = C.texts_of(batch.column("text"))
            letter = batch.column("letter").fill_null(False).to_numpy(zero_copy_only=False)
            best, score, rate = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi in C.pieces(offsets, 1 << 20) if model.languages else ():
                part = offsets[lo : hi + 1]
                bits = model.code_lengths(data[part[0] : part[-1]], part - part[0])
                known = np.flatnonzero(letter[lo:hi])
                low = bits[known].min(axis=1)
                best[lo + known] = bits[known].argmin(axis=1)
                score[lo + known] = 1 / np.exp2(np.maximum(low[:, None] - bits[known], -1000)).sum(axis=1)
                rate[lo + known] = low / np.diff(part)[known]
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "letter")]
            mask = ~letter | (best == len(names) - 1)
            made = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rate, mask=mask)]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
        C.release()

    return run


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior under even priors), bits_per_byte."""
    spark = docs.sparkSession
    C.ship(spark)
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return slim.mapInArrow(
        _predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
    )


def _accept(shared, reject_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            data, offsets = C.texts_of(batch.column("row").field("text"))
            keep = batch.column("letter").fill_null(False).to_numpy(zero_copy_only=False).copy()
            for lo, hi in C.pieces(offsets, 1 << 20) if model.languages else ():
                part = offsets[lo : hi + 1]
                bits = model.code_lengths(data[part[0] : part[-1]], part - part[0])
                keep[lo:hi] &= bits.min(axis=1) <= reject_bits * np.maximum(1, np.diff(part))
            yield batch.select(["row"]).filter(pa.array(keep))
        C.release()

    return run


def identified(docs: DataFrame, model: Model, reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, with all their columns.

    Rejected: ``und``, and texts that cost more than ``reject_bits`` bits a byte in
    every language.
    """
    spark = docs.sparkSession
    C.ship(spark)
    # the columns travel in one struct, so that no name of theirs can clash
    marked = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").rlike(r"\p{L}").alias("letter"))
    kept = marked.mapInArrow(_accept(spark.sparkContext.broadcast(model), reject_bits), marked.select("row").schema)
    return kept.select("row.*")
