"""MinHash near-dedup by a multi-index Hamming join.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
document's set holds its distinct 5-word shingles (a document of one to four
words has its whole sequence as one; one without words has none and is linked
with nothing). Two documents are linked if ``100 * |A & B| >= 75 * |A | B|``.

1. ``signatures``: 48 MinHash values of 16 bits for each document.
2. Documents with equal sets are one class from here on (its node is the 64-bit
   hash of the set), so a huge group of copies costs one row.
3. ``chunk_keys``: the signature is cut into 12 chunks of 4 values. By the
   pigeonhole principle two signatures at Hamming distance <= 23 (positions
   that differ) have a chunk with at most one error, so each chunk emits one
   key for each position that may be wrong: 48 keys a document. At Jaccard
   0.75 a position differs with probability 1/4; a pair shares no key only if all 12
   chunks hold two errors or more: 0.262 ** 12 = 1.03e-7, and less above 0.75.
4. Stars: each class is held against the least class of each key that it shares,
   and against the nearest of those by full shingle sets. Links found so far make
   components; a group of near copies, however large, mostly becomes one here, in
   linear time.
5. ``meetings``: what is left are pairs of different components that share a key.
   Keys whose classes are one component are done, and of keys with the same
   members one is enough. The members of the rest are compared by signature, all
   pairs of a key, and a class that has a partner within ``ADMITTED`` positions
   stays. Components that meet so are grouped by their own connected components.
   At Jaccard 0.75 more than 30 of 48 positions differ with probability 8.4e-9, so
   the whole path misses a pair with probability 1.1e-7, and less above 0.75.
6. ``confirmed``: inside such a group, pairs of different components are held
   against each other by full shingle sets.

Steps 5 and 6 run in blocks of bounded size: members of a key or group beyond
``block`` are dealt to parts, and each pair of parts is one group of rows, so none
is dropped and no task holds all. They write at most one row for each member and
block, never all pairs. At worst (many documents alike, but none within 0.75 of
another) the comparisons are quadratic in the documents of one key.

Nulls: a null text has the empty set. A row with a null doc_id takes part; it
never is the smallest of its component unless all its ids are null. Repeated
rows are equal sets. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

SHINGLE = 5
CHUNKS, WIDTH = 12, 4
POSITIONS = CHUNKS * WIDTH
#: Signatures at this distance or less share a key.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Signatures farther apart than this are not held against each other; a pair may share a key beyond MAX_DISTANCE.
ADMITTED = 30
#: Members of one part; a group of rows has at most about two.
BLOCK = 1024
#: Shingles of one part (8 bytes each).
LOAD = 1_000_000
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Shingles that are looked up in one set at once.
STEP = 1 << 18
#: Bytes of whole texts that are cut into shingles at once, unless one text has more.
PIECE = 1 << 19

_MULTIPLY = C._splitmix(101, POSITIONS) | np.uint64(1)
_ADD = C._splitmix(211, POSITIONS)
_SET = C._splitmix(307, 1)[0]


def minhash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, positions) signature of 16-bit values; rows of empty texts are 0."""
    out = np.zeros((len(begin) - 1, POSITIONS), np.uint16)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        at = begin[:-1][full]
        for k in range(POSITIONS):
            x = values * _MULTIPLY[k] + _ADD[k]
            low = C.mix64(np.minimum.reduceat(x, at))
            out[full, k] = (low >> np.uint64(48)).astype(np.uint16)
    return out


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = C.texts_of(texts)
    for lo, hi in C.pieces(offsets, PIECE):
        part = offsets[lo : hi + 1]
        hashes, first = C.words(data[part[0] : part[-1]], part - part[0], C.NOT_SPACE)
        yield lo, hi, *C.distinct_sets(*C.shingles(hashes, first, SHINGLE))


def _node(values: np.ndarray) -> int:
    total = np.sum(C.mix64(values ^ _SET), dtype=np.uint64, keepdims=True) + np.uint64(len(values))
    return int(C.mix64(total).view(np.int64)[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, values, begin in _sets(batch.column("text")):
            n = np.diff(begin)
            signature = minhash(values, begin)
            node = np.zeros(hi - lo, np.uint64)
            full = np.flatnonzero(n > 0)
            if len(full):
                node[full] = C.mix64(np.add.reduceat(C.mix64(values ^ _SET), begin[:-1][full]) + n[full].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("text_hash")[lo:hi], pa.array(n, pa.int64()), pa.array(node.view(np.int64), mask=n == 0), pa.array([r.tobytes() for r in signature], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "node", "signature"],
            )
    C.release()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (null: no text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, node (null: empty set), signature (96 bytes)."""
    C.ship(docs.sparkSession)
    return _texts(docs).mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, node long, signature binary")


def chunk_values(signature: np.ndarray) -> np.ndarray:
    """(documents, 48) keys: chunk, the position that may be wrong, and the other three values."""
    n = len(signature)
    chunks = signature.reshape(n, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((n, CHUNKS, WIDTH), np.uint64)
    for wrong in range(WIDTH):
        x = np.zeros((n, CHUNKS), np.uint64)
        for p in range(WIDTH):
            if p != wrong:
                x = (x << np.uint64(16)) | chunks[:, :, p]
        out[:, :, wrong] = x | ((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(wrong)) << np.uint64(48))
    return C.mix64(out.reshape(n, POSITIONS)).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = chunk_values(signature)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), POSITIONS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["key", "node"])
    C.release()


def chunk_keys(classes: DataFrame) -> DataFrame:
    return classes.select("node", "signature").mapInArrow(_keys, "key long, node long")


def _bytes(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _close(n: np.ndarray, signature: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) their sizes and signatures allow."""
    ok = 100 * np.minimum(n[x], n[y]) >= 75 * np.maximum(n[x], n[y])
    some = np.flatnonzero(ok)
    ok[some] = (signature[x[some]] != signature[y[some]]).sum(axis=1) <= ADMITTED
    return ok


def _common(mine: np.ndarray, other: np.ndarray) -> int:
    """Values in both of two sorted sets."""
    if len(mine) > len(other):
        mine, other = other, mine
    return int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())


# ------------------------------------------------------------ 4: stars


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of the pairs that sizes and signatures allow."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.num_rows
        signature = np.concatenate([_bytes(batch.column(c), np.uint16).reshape(-1, POSITIONS) for c in ("signature", "other")])
        n = np.concatenate([batch.column(c).to_numpy() for c in ("n_shingles", "n_other")])
        at = np.arange(m)
        ok = pa.array(_close(n, signature, at, at + m))
        distance = (signature[:m] != signature[m:]).sum(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(distance).filter(ok)], names=["a", "b", "distance"])
    C.release()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets x and y are linked."""
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = _common(x, y)
            ok[i] = 100 * both >= 75 * (len(x) + len(y) - both)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    C.release()


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, values, begin in _sets(batch.column("text")):
            # rows that repeat a doc_id and a text hash may hold a text of another class
            expected = batch.column("node")[lo:hi].to_numpy(zero_copy_only=False)
            own = [k for k in range(hi - lo) if begin[k] < begin[k + 1] and _node(values[begin[k] : begin[k + 1]]) == expected[k]]
            made = [values[begin[k] : begin[k + 1]].tobytes() for k in own]
            yield pa.RecordBatch.from_arrays([batch.column("node")[lo:hi].take(pa.array(own, pa.int64())), pa.array(made, pa.binary())], names=["node", "shingles"])
    C.release()


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the classes in ``nodes``, each from one of its documents."""
    carriers = classes.join(nodes, "node").select("node", F.col("carrier.h").alias("h"), F.col("carrier.d").alias("d"))
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))
    brought = _texts(docs).join(carriers, same).select("node", "text")
    return brought.mapInArrow(_sets_of, "node long, shingles binary").dropDuplicates(["node"])


def stars(docs: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (a, b) between each class and the nearest of the least classes of its keys."""
    facts = classes.select("node", "n_shingles", "signature")
    other = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_other"), F.col("signature").alias("other"))
    pairs = shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    both = pairs.join(facts.withColumnRenamed("node", "a"), "a").join(other, "b")
    near = both.mapInArrow(_near_stars, "a long, b long, distance int")
    best = C.materialize(near.groupBy("a").agg(F.min(F.struct("distance", "b"))["b"].alias("b")), "stars")
    sets = C.materialize(_full_sets(docs, classes, best.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return best.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


# ---------------------------------------------- 5 and 6: pairs in blocks


def _dealt(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of ``members(group, ...)`` by group and pair of parts (p, q), with their own part ``mine``."""
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("load") / LOAD)).cast("long")
    dealt = (
        members.join(sizes, "group")
        .withColumn("parts", parts)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("p", F.least("mine", "with"))
        .withColumn("q", F.greatest("mine", "with"))
    )
    return dealt.drop("parts", "members", "load", "with").repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, with the place where each row's group ends."""
    held: list[pa.RecordBatch] = []

    def ends(table):
        keys = [table.column(c).to_numpy() for c in ("group", "p", "q")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        return np.concatenate([new, [table.num_rows]]).astype(np.int64)

    def made(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        stop = ends(table)
        return table, np.repeat(stop, np.diff(stop, prepend=0))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = ("group", "p", "q")
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys):
            yield made(held)
            held = []
        stop = ends(batch)
        if len(stop) > 1:
            last = int(stop[-2])
            yield made([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield made(held)


def _pairs(stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, some at a time."""
    follow = stop - np.arange(len(stop)) - 1
    total = np.concatenate([[0], np.cumsum(follow)])
    for lo, hi in C.pieces(total, PAIRS):
        x = np.repeat(np.arange(lo, hi), follow[lo:hi])
        yield x, x + 1 + np.arange(len(x)) - np.repeat(total[lo:hi] - total[lo], follow[lo:hi])


def _candidates(table: pa.Table, stop: np.ndarray, comp: np.ndarray, n: np.ndarray, signature: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components and of the two parts of their group that sizes and signatures allow."""
    p, q, mine = (table.column(c).to_numpy() for c in ("p", "q", "mine"))
    one = p == q
    for x, y in _pairs(stop):
        some = np.flatnonzero((comp[x] != comp[y]) & (one[x] | (mine[x] != mine[y])))
        x, y = x[some], y[some]
        ok = _close(n, signature, x, y)
        yield x[ok], y[ok]


def _arrays(table: pa.Table):
    return (table.column("comp").to_numpy(), table.column("n_shingles").to_numpy(), _bytes(table.column("signature"), np.uint16).reshape(-1, POSITIONS))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): components that meet, folded within a table; (a, null): classes that meet one of another component."""
    for table, stop in _whole_groups(batches):
        comp, n, signature = _arrays(table)
        node = table.column("node").to_numpy()
        a, b, active = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(node), bool)
        for x, y in _candidates(table, stop, comp, n, signature):
            active[x] = active[y] = True
            met, least = C.folded(comp[x], comp[y])
            a.append(met[met != least])
            b.append(least[met != least])
        there = np.unique(node[active])
        met, least = C.folded(np.concatenate(a), np.concatenate(b))
        columns = [np.concatenate([met[met != least], there]), np.concatenate([least[met != least], there])]
        rest = np.arange(len(columns[0])) >= len(columns[0]) - len(there)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=rest)], names=["a", "b"])
    C.release()


def meetings(classes: DataFrame, shared: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """What ``_meet`` finds among the classes of each key that are not one component yet."""
    of = comps.select("node", F.col("label").alias("comp"))
    rows = C.materialize(shared.select("key", "node").join(of, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "members")
    mixed = rows.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("g"),
    ).where("low < high")
    once = C.materialize(mixed.groupBy("members", "f", "g").agg(F.min("key").alias("group")).select("group", "members", F.lit(0).alias("load")), "mixed")
    facts = classes.select("node", "n_shingles", "signature")
    members = rows.withColumnRenamed("key", "group").join(once.select("group"), "group").join(facts, "node")
    return C.materialize(_dealt(members, once, block).mapInArrow(_meet, "a long, b long"), "meetings")


def _group_links(comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], pairs) -> list[tuple[int, int]]:
    """Links between the components of one group of rows: a forest, every pair not yet joined tried."""
    size = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = [ids[begin[k] : begin[k + 1]] for k in range(len(sets))]
    mine, label, out = np.zeros(int(ids.max()) + 1, bool), comp.copy(), []
    for xs, ys in pairs:
        cut = np.concatenate([[0], np.flatnonzero(xs[1:] != xs[:-1]) + 1, [len(xs)]]) if len(xs) else [0]
        for lo, hi in zip(cut, cut[1:], strict=False):
            x, others = int(xs[lo]), ys[lo:hi]
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            mine[own[x]] = True
            for i, j in C.pieces(np.concatenate([[0], np.cumsum(size[others])]), STEP):
                some = others[i:j]
                held = mine[np.concatenate([own[y] for y in some])]
                common = np.add.reduceat(held, np.cumsum(size[some]) - size[some], dtype=np.int64)
                for y in some[100 * common >= 75 * (n[x] + n[some] - common)].tolist():
                    if label[x] != label[y]:
                        out.append((int(comp[x]), int(comp[y])))
                        label[label == label[y]] = label[x]
            mine[own[x]] = False
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components."""
    for table, stop in _whole_groups(batches):
        comp, n, signature = _arrays(table)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
        links, lo = [], 0
        while lo < len(stop):
            hi = int(stop[lo])
            pairs = _candidates(table.slice(lo, hi - lo), stop[lo:hi] - lo, comp[lo:hi], n[lo:hi], signature[lo:hi])
            links += _group_links(comp[lo:hi], n[lo:hi], sets[lo:hi], pairs)
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
    C.release()


def confirmed(docs: DataFrame, classes: DataFrame, comps: DataFrame, met: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between components, by full sets, among the classes that meet another component."""
    groups = C.components(met.where("b is not null")).select(F.col("node").alias("comp"), F.col("label").alias("group"))
    active = met.where("b is null").select(F.col("a").alias("node")).distinct()
    of = comps.select("node", F.col("label").alias("comp"))
    own = active.join(of, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(groups, "comp")
    facts = C.materialize(own.join(classes.select("node", "n_shingles", "signature"), "node").select("group", "node", "comp", "n_shingles", "signature"), "active")
    sizes = facts.groupBy("group").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("load"))
    members = facts.join(_full_sets(docs, classes, facts.select("node")), "node")
    return _dealt(members, sizes, block).mapInArrow(_confirm, "a long, b long")


def classified(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, label (of its component; null: empty set), component_id."""
    signed = C.materialize(signatures(docs), "signed")
    carrier = F.min(F.struct(F.col("text_hash").alias("h"), F.col("doc_id").alias("d"))).alias("carrier")
    classes = C.materialize(
        signed.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), carrier, F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles")
        ),
        "classes",
    )
    keys = chunk_keys(classes)
    low = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    shared = C.materialize(keys.join(low, "key"), "shared")
    first = C.materialize(C.components(stars(docs, classes, shared)), "first")
    second = C.components(confirmed(docs, classes, first, meetings(classes, shared, first, block), block))
    one = first.select("node", F.col("label").alias("comp"))
    two = second.select(F.col("node").alias("c"), F.col("label").alias("over"))
    labelled = classes.select("node", "least").join(one, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = C.materialize(labelled.join(two, F.col("comp") == F.col("c"), "left").select("node", "least", F.coalesce("over", "comp").alias("label")), "labels")
    # the smallest doc_id of each component
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    many = labelled.join(smallest, "label").select(F.col("node").alias("n"), "label", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.join(many, F.col("node") == F.col("n"), "left").select("doc_id", "text_hash", "n_shingles", "label", own.alias("component_id"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return classified(docs, block).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row of each component, of those with its smallest doc_id; rows with an
    empty set all stay. Where rows repeat that doc_id, the text that comes first by hash stays,
    and of rows that repeat the text too, any one.
    """
    rows = C.materialize(classified(docs).where("label is not null").select("doc_id", "text_hash", "label"), "found")
    times = rows.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    stay = times.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "times")).alias("s"))
    stay = stay.select("label", F.col("s.doc_id").alias("d"), F.col("s.text_hash").alias("h"), F.col("s.times").alias("times"))
    mine = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    gone = rows.join(stay, "label").where(~mine).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    again = C.materialize(stay.where("times > 1").select("d", "h"), "again")
    # extra columns travel in one struct, so that no name of theirs can clash
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").isNull().alias("no_text"))
    own = mine & ~F.col("no_text")
    single = whole.join(gone.unionAll(again), own, "left_anti").select("row")
    if again.isEmpty():  # no row repeats another: whole rows are dealt once
        return single.select("row.*")
    return single.unionAll(whole.join(again, own).dropDuplicates(["doc_id", "text_hash"]).select("row")).select("row.*")
