"""Connected components of an edge table."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.session import checkpointed


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Label every node of an edge table with the smallest node it reaches.

    ``edges(a, b)`` of long. Returns ``(node, label)`` for nodes on an edge.
    Each round picks for each node a representative, the first of itself and its
    neighbours in an order that changes from round to round (a pre-aggregated
    group-by, so a hub with many neighbours is not gathered anywhere), follows the
    representative's own once, and replaces the edges by those between
    representatives: loops and repeats go, so the table shrinks by a constant
    factor and the rounds are logarithmic, for a chain too. The first order is
    the natural one, which folds the stars around smallest nodes at once.
    Labels are read back through the rounds, whose tables shrink alike. ``keep``
    cuts the lineage of each; one emptiness test a round reaches the driver.
    """
    rest = keep(edges.select("a", "b").where("a <> b").distinct())
    rounds: list[DataFrame] = []
    order = random.Random(5)
    while not rest.isEmpty():
        flip = F.lit(order.getrandbits(63) if rounds else 0).cast("long")
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.col("b").bitwiseXOR(flip)), F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip)
        near = both.withColumnRenamed("a", "node").groupBy("node").agg(first.alias("near"))
        over = near.select(F.col("node").alias("n"), F.col("near").alias("label"))
        step = keep(near.join(over, near.near == over.n).select("node", "label"))
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        rest = keep(rest.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = rounds.pop()
    while rounds:
        later = label.select(F.col("node").alias("n"), F.col("label").alias("final"))
        label = rounds.pop().join(later, F.col("label") == F.col("n"), "left").select("node", F.coalesce("final", "label").alias("label"))
    label = keep(label)
    least = label.groupBy(F.col("label").alias("l")).agg(F.min("node").alias("least"))
    return label.join(least, F.col("label") == F.col("l")).select("node", F.col("least").alias("label"))


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        some = np.flatnonzero(p != q)
        if not len(some):
            return nodes, nodes[label]
        x, y, p, q = x[some], y[some], p[some], q[some]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label[label], label):
            label = label[label]
