"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors become integers, ``floor(scale * x)`` for each component. Candidates are
dealt to shards and queries to blocks (both of bounded size); each pair of a
shard and a block is one task. In a shard every dimension has a list sorted by
value, read from both ends, since a query wants high values where it is
positive and low ones where it is negative. In each round all lists are read to
a common depth; whoever shows up on any list for the first time is scored
exactly, and a query is done when its k-th score is above the threshold, the
best score that the values at the current depth allow to anyone not yet seen.
Ties at the threshold read on, so they fall to the smaller vec_id. The best k of
all shards are merged by a window whose group limit runs before the shuffle.

Vectors that are null or hold null, NaN or infinite components, and rows with a
null vec_id, take no part. Rows with the query's vec_id are its own, and repeated
query rows count once. Vectors of another length than the query's are not scored.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm import _common as C

SHARD, BLOCK = 16_384, 4_096
#: Scores that are held at once.
_CELLS = 4_000_000


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
    )


def _best(ids: np.ndarray, scores: list[np.ndarray], names: list[np.ndarray], rows: list[np.ndarray], k: int, n: int):
    """The k best of each row, by score and then the smaller name; the k-th score of each row (-inf: fewer)."""
    row, score, name = np.concatenate(rows), np.concatenate(scores), np.concatenate(names)
    order = np.lexsort((name, -score, row))
    row, score, name = row[order], score[order], name[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    keep = at < k
    kth = np.full(n, -np.inf)
    last = at == k - 1
    kth[row[last]] = score[last]
    return row[keep], score[keep], name[keep], kth


def threshold_topk(names: np.ndarray, values: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, first: int = 64):
    """The k best candidates of each query: (row of the query, name, score)."""
    n, dims = values.shape
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty((n, dims), np.int32)
    for d in range(dims):
        rank[order[:, d], d] = np.arange(n, dtype=np.int32)
    seen_at = np.minimum(rank, n - 1 - rank).min(axis=1) if dims else np.zeros(n, np.int32)
    by_depth = np.argsort(seen_at, kind="stable")
    depths = seen_at[by_depth]
    low = np.take_along_axis(values, order, axis=0)
    active, depth, begin = np.arange(len(queries)), min(first, n), 0
    row, score, name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    while True:
        end = int(np.searchsorted(depths, depth, "left"))
        new = by_depth[begin:end]
        begin = end
        gained = [(row, score, name)]
        kth = np.full(len(queries), -np.inf)
        at = np.arange(len(row)) - np.searchsorted(row, row)
        kth[row[at == k - 1]] = score[at == k - 1]
        step = max(1, _CELLS // max(1, len(new)))
        for lo in range(0, len(active) if len(new) else 0, step):
            some = active[lo : lo + step]
            s = queries[some] @ values[new].T
            s[ids[some][:, None] == names[new][None, :]] = -np.inf
            bound = kth[some]
            if len(new) >= k:
                bound = np.maximum(bound, np.partition(s, len(new) - k, axis=1)[:, len(new) - k])
            i, j = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
            gained.append((some[i], s[i, j], names[new[j]]))
        row, score, name, kth = _best(ids, [g[1] for g in gained], [g[2] for g in gained], [g[0] for g in gained], k, len(queries))
        if end >= n:
            return row, name, score
        top, bottom = low[n - 1 - depth], low[depth]
        q = queries[active]
        threshold = np.maximum(q * top, q * bottom).sum(axis=1)
        active = active[kth[active] <= threshold]
        if not len(active):
            return row, name, score
        depth = min(n, depth * 4)


def _search(k: int):
    def search(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        table = table.combine_chunks()
        width = pa.compute.list_value_length(table["v"]).to_numpy()
        role, ids = table["is_query"].to_numpy(), table["vec_id"].to_numpy()
        for dims in np.unique(width):
            mine = pa.array(width == dims)
            part = table["v"].filter(mine).combine_chunks()
            flat = part.flatten().to_numpy(zero_copy_only=False)
            exact = float(np.abs(flat).max(initial=0)) ** 2 * max(1, int(dims)) < 2**53
            flat = flat.astype(np.float64) if exact else flat.astype(object)
            v, r, i = flat.reshape(int((width == dims).sum()), int(dims)), role[width == dims], ids[width == dims]
            if r.any() and not r.all():
                q, once = np.unique(i[r], return_index=True)
                row, name, score = threshold_topk(i[~r], v[~r], q, v[r][once], k)
                out.append((q[row], name, score))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row."""
    C.ship(vectors.sparkSession)
    v = C.materialize(integer_vectors(vectors, scale).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    n, asks = v.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asks // block))
    home = F.xxhash64("vec_id")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    stored = v.select("vec_id", "v", F.lit(False).alias("is_query"), F.pmod(home, F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = v.where("asks").select("vec_id", "v", F.lit(True).alias("is_query"), every(shards).alias("shard"), F.pmod(home, F.lit(blocks)).cast("int").alias("block"))
    local = stored.unionByName(asked).groupBy("shard", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
