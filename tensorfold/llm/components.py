"""Connected components of a link table, by alternating large-star and small-star contractions.

Every edge ends at the smaller of its nodes. A large star hangs a node's larger neighbours on its least
neighbour, a small star its smaller ones; both shrink the forest until each component is one star. Each round
writes its edges to the shared folder, so lineage stays short and a lost executor costs one round's task.

Before the rounds, every partition contracts the edges it holds to a spanning forest, in bounded batches.
Rows that a hub makes many of only pass through joins that adaptive execution can split and through sums made
before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def local_forest(edges: DataFrame) -> DataFrame:
    """Each Arrow batch of (a, b) edges contracted to a spanning forest: never more edges than came."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            u, v = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
            a, b = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node ``a``. Dealt anew: adaptive execution splits a hub's rows in a join only
    if both its sides were shuffled for it."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).repartition(edges.sparkSession.sparkContext.defaultParallelism)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the ``(a, b)`` edges, component being its least node.

    Nodes without a link to another don't appear; null ends are dropped; no edges give an empty result.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null")
    edges = staged(local_forest(edges), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both.unionByName(both.select("a", F.col("a").alias("b")))), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), "large")
        small = large.join(_least(large), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        edges = staged(small.distinct(), "small")
        # Stars: no node hangs on two others, and what others hang on doesn't hang itself.
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        if twice.isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
