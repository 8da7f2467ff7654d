"""Count-only Viterbi: how many unigram pieces the best segmentation of a text has.

The vocabulary is a list of (piece, log probability). A text is cut at white
space marks as a Metaspace pre-tokenizer cuts it: each space becomes a mark that
starts a word, and a text that does not start with one gets one. Within a word
an Aho-Corasick automaton over UTF-8 bytes enumerates, at each place, all pieces
that end there, longest first; dynamic programming carries the best score, the
number of pieces, and whether the last one is unknown.

Tie rules of the exact tokenizer: an earlier start (a longer piece) wins unless a
later one is strictly better; a character that is no piece itself may be an
unknown piece scoring 10 below the worst piece, tried last; unknown pieces
side by side count as one.

Words are distinct per batch, remembered by each worker, and all words of a
batch are walked side by side in NumPy, longest first.

Null and empty texts have 0 pieces. Repeated rows are counted each. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers, and the characters of the longest of them.
MEMORY, LONGEST = 600_000, 48


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with Zipf's log probability by their order; its unknown piece comes first.

    Control and byte pieces stay out: a unigram model cannot emit them from text.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return [("<unk>", 0.0), *((p, -math.log(r + 1) - total) for r, p in enumerate(names))]


class Counter:
    """Piece counts of words under a unigram vocabulary whose first entry is unknown."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        children: list[dict[int, int]] = [{}]
        length, score = [0], [0.0]
        self.longest = 1
        for piece, s in vocabulary:  # the unknown piece's own name is a piece too, as in the tokenizer
            at, raw = 0, piece.encode()
            for b in raw:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    length.append(0)
                    score.append(0.0)
                at = children[at][b]
            length[at], score[at] = len(raw), s
            self.longest = max(self.longest, len(raw))
        n = len(children)
        used = sorted({b for c in children for b in c})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.go = np.zeros((n, self.width), np.int32)
        self.next_end = np.zeros(n, np.int32)  # the longest proper suffix that is a piece
        fail, queue = [0] * n, deque()
        for b, to in children[0].items():
            self.go[0, self.symbol[b]] = to
            queue.append(to)
        while queue:
            at = queue.popleft()
            f = fail[at]
            self.next_end[at] = f if length[f] else self.next_end[f]
            self.go[at] = self.go[f]
            for b, to in children[at].items():
                fail[to] = int(self.go[f, self.symbol[b]])
                self.go[at, self.symbol[b]] = to
                queue.append(to)
        self.length, self.score = np.array(length, np.int64), np.array(score)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.first_end = np.where(self.length > 0, np.arange(n), self.next_end)
        self._go = self.go.reshape(-1)
        self.known: dict[str, int] = {}

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; the dynamic program runs over all words at once."""
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes, top = sizes[order], int(sizes.max())
        n = len(words)
        # a ring of the last `longest` places is all that a piece can reach back to
        ring = self.longest + 1
        best, pieces, tail = np.full((n, ring), -np.inf), np.zeros((n, ring), np.int64), np.zeros((n, ring), bool)
        best[:, 0] = 0.0
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        start = (ends - np.array([len(w) for w in words]))[order]
        state, out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        since = np.zeros(n, np.int64)  # bytes of the current character so far
        alive = np.searchsorted(-sizes, -np.arange(1, top + 1), "right")
        for i in range(1, top + 1):
            m = int(alive[i - 1])
            byte = data[start[:m] + i - 1]
            state[:m] = self._go[state[:m] * self.width + self.symbol[byte]]
            lead = (byte & 0xC0) != 0x80
            since[:m] = np.where(lead, 1, since[:m] + 1)
            need = np.where(byte < 0x80, 1, 0)
            if m and (byte >= 0x80).any():
                at = start[:m] + i
                last = np.ones(m, bool)
                inside = i < sizes[:m]
                last[inside] = (data[at[inside]] & 0xC0) != 0x80
                need = np.where(last, since[:m], 0)
            slot = i % ring
            score, count, unk = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, bool)
            single = np.zeros(m, bool)
            rows, at = np.arange(m), self.first_end[state[:m]]
            while True:
                on = np.flatnonzero(at)
                if not len(on):
                    break
                rows, at = rows[on], at[on]
                size = self.length[at]
                back = (i - size) % ring
                candidate = best[rows, back] + self.score[at]
                better = candidate > score[rows]
                win = rows[better]
                score[win], count[win], unk[win] = candidate[better], pieces[win, back[better]] + 1, False
                single[rows[size == need[rows]]] = True
                at = self.next_end[at]
            lone = np.flatnonzero((need > 0) & ~single)
            if len(lone):
                back = (i - need[lone]) % ring
                candidate = best[lone, back] + self.unknown
                better = candidate > score[lone]
                win, back = lone[better], back[better]
                score[win], unk[win] = candidate[better], True
                count[win] = pieces[win, back] + np.where(tail[win, back], 0, 1)
            best[:m, slot], pieces[:m, slot], tail[:m, slot] = score, count, unk
            done = int(np.searchsorted(-sizes, -i, "left")), int(np.searchsorted(-sizes, -i, "right"))
            out[done[0] : done[1]] = count[done[0] : done[1]]
        result = np.zeros(n, np.int64)
        result[order] = out
        return result

    def count_words(self, words: list[str]) -> dict[str, int]:
        """Pieces of each word; long words are not remembered, so memory is bounded in bytes."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = words
        short = sorted((w for w in fresh if len(w) <= 256), key=len)
        made: dict[str, int] = {}
        for lo in range(0, len(short), 65_536):
            some = short[lo : lo + 65_536]
            made.update(zip(some, self.count([(MARK + w).encode() for w in some]).tolist(), strict=True))
        made.update((w, self.count_long((MARK + w).encode())) for w in fresh if len(w) > 256)
        self.known.update((w, n) for w, n in made.items() if len(w) <= LONGEST)
        known = self.known
        return {w: made[w] if w in made else known[w] for w in words}

    def count_long(self, word: bytes) -> int:
        """One word, place by place: the same program without a batch to fill."""
        go, symbol, width = self._go, self.symbol.tolist(), self.width
        first, further, length, score = self._lists()
        ring = self.longest + 1
        best, pieces, tail = [-math.inf] * ring, [0] * ring, [False] * ring
        best[0] = 0.0
        state, since, n = 0, 0, len(word)
        for i in range(1, n + 1):
            b = word[i - 1]
            state = int(go[state * width + symbol[b]])
            since = since + 1 if b & 0xC0 == 0x80 else 1
            need = since if i == n or word[i] & 0xC0 != 0x80 else 0
            top, count, unk, single, at = -math.inf, 0, False, False, first[state]
            while at:
                size = length[at]
                back = (i - size) % ring
                candidate = best[back] + score[at]
                if candidate > top:
                    top, count, unk = candidate, pieces[back] + 1, False
                single = single or size == need
                at = further[at]
            if need and not single:
                back = (i - need) % ring
                if best[back] + self.unknown > top:
                    top, unk, count = best[back] + self.unknown, True, pieces[back] + (not tail[back])
            slot = i % ring
            best[slot], pieces[slot], tail[slot] = top, count, unk
        return pieces[n % ring] if n else 0

    def _lists(self):
        if not hasattr(self, "_plain"):
            self._plain = tuple(x.tolist() for x in (self.first_end, self.next_end, self.length, self.score))
        return self._plain


_counters: dict[str, Counter] = {}


def counter_of(model_path: str) -> Counter:
    if model_path not in _counters:
        _counters[model_path] = Counter(unigram_vocabulary(model_path))
    return _counters[model_path]


def words_of(text: str) -> list[str]:
    """Words after their marks: a space (or a mark in the text) starts one."""
    text = text.replace(MARK, " ")
    return (text[1:] if text[0] == " " else text).split(" ")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                split = [words_of(t) if t else [] for t in part.column("text").to_pylist()]
                every = list(set().union(*split))
                known = counter.count_words(every)
                here = dict(zip(every, map(known.__getitem__, every), strict=True)).__getitem__
                n = [sum(map(here, w)) for w in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words", "n_pieces"]
                )
        C.release()

    return run


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words (marks), n_pieces of every whole text."""
    C.ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_count(model_path), "doc_id long, n_words long, n_pieces long")
