"""Connected components of an edge list, by distributed union-find.

Every task joins its own edges in a union-find and passes on one edge a node at
most, so a hub leaves one edge a task. Rounds then bring a node's edges together,
join its parents, and hang it on its parent's parent, until every component is a
star around its smallest node. Every round is a written table in the shared
folder, of as many tasks as the edges ask for: the more nodes meet in a task, the
fewer rounds there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch

#: Edges a task holds at once in its local union-find.
HELD = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node but the roots, where the root is its component's smallest node."""
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = where[: len(a)], where[len(a) :]
    while True:
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        node, root = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= HELD:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b) of longs: each node in a component of two or more, its smallest node as root.

    Repeated edges and self-loops are allowed; no edges give an empty result.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    most = scratch.tasks(edges.sparkSession, edges.count())
    while True:
        # all edges from a node down to smaller ones meet in a task, which leaves each node there one edge, to the smallest
        dealt = down.mapInArrow(_local, "a long, b long").repartition("a").coalesce(most)
        parents = scratch.keep(dealt.mapInArrow(_local, "a long, b long"), "parents")
        # a node that others hang on may stand in several tasks, with equal or different parents
        least = scratch.keep(parents.groupBy("a").agg(F.min("b").alias("up"), F.max("b").alias("high")), "least", most=most)
        jumped = parents.join(least.select(F.col("a").alias("b"), "up"), "b", "left")
        jumped = scratch.keep(jumped.select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")), "jumped", most=most)
        if jumped.where("moved").isEmpty() and least.where("up <> high").isEmpty():
            break
        down = jumped.select("a", "b")
    found = least.select(F.col("a").alias("node"), F.col("up").alias("root"))
    return found.union(found.select("root").distinct().select(F.col("root").alias("node"), "root"))
