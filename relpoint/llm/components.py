"""Connected components: distributed contraction, then union-find on what is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpoint.llm.common import store

#: Edges that one task joins by union-find; more are contracted first.
TASK_EDGES = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        x, y = root[left], root[right]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return nodes, nodes[root]


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if table:
        nodes, root = union_find(*(np.concatenate(c) for c in zip(*table)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node of the edges ``a``, ``b`` (long).

    While there are more than ``task_edges`` edges, each node moves to the neighbour with the smallest
    hash, itself included, and edges are rewritten to the new nodes; a constant share of the nodes goes
    with each round. What is left is joined by union-find in one task, of bounded size. Loops are
    allowed; rows with a null are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    edges, moves = store(edges, "edges"), []
    while edges.count() > task_edges:
        seed = F.lit(len(moves) + 1)
        both = edges.union(edges.select("b", "a"))
        best = (
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("n"))).alias("best"))
            .withColumn("own", F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("n")))
            .select("node", F.least("best", "own")["n"].alias("next"))
        )
        best = store(best, "moves")
        moves.append(best)
        at_a = edges.join(best.toDF("a", "x"), "a").select("x", "b")
        at_b = at_a.join(best.toDF("b", "y"), "b").where("x <> y")
        edges = store(at_b.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    ends = edges.coalesce(1).mapInArrow(_solve, "node long, root long")
    for move in reversed(moves):
        ends = store(ends, "roots")
        on = move.join(ends.toDF("next", "root"), "next", "left")
        ends = on.select("node", F.coalesce("root", "next").alias("root"))
    if moves:
        ends = store(ends, "roots")
        least = store(ends.groupBy("root").agg(F.min("node").alias("component")), "least")
        return ends.join(least, "root").select("node", "component")
    return ends.withColumnRenamed("root", "component")
