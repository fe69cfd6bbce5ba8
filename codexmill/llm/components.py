"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, on_hot

#: Edges that a task of a round takes in, about; there are no more tasks than the shuffle's width.
TASK_EDGES = 50_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all() and (root[a] == root[b]).all():
            break
        root = new
    return root


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) by blocks of TASK_EDGES, about, each as stars around the smallest nodes of what the block ties."""
    held: list[pa.RecordBatch] = []

    def told() -> pa.RecordBatch:
        ends = [np.concatenate([np.array(b[c].to_pylist(), dtype=object) for b in held]) for c in ("u", "v")]
        names, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = forest(len(names), *np.split(at, 2))
        u = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[x], pa.string()) for x in (u, root[u])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_EDGES:
            yield told()
            held = []
    if held:
        yield told()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge (u, v); root is the smallest node of its component.

    Alternates the large-star and the small-star step, which keep components and end
    with every node tied to its smallest. Each step is a minimum with map-side
    combining and a join that settles hot centres by a bounded broadcast; each step is
    written out, so that its plan stays small, and the loop ends when only stars are left.
    Before each round tasks tie up what they hold by themselves. Nodes are strings; loops
    and repeated edges do no harm.
    """
    now = tied(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")))
    for _ in range(rounds):
        total, settled = state(now)
        if settled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # Few edges take few tasks, however wide the shuffle is.
        tasks = max(1, math.ceil(total / TASK_EDGES))
        now = cut(large_star(now.coalesce(tasks), total).coalesce(tasks))
        now = tied(small_star(now, total))
    raise RuntimeError("components did not settle")


def tied(edges: DataFrame) -> DataFrame:
    """The same components, from as few tasks as the edges ask for, each with stars of its own."""
    found = cut(edges)
    return cut(found.coalesce(max(1, math.ceil(found.count() / TASK_EDGES))).mapInArrow(stars, "u string, v string"))


def state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: each u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = per_node.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1), 1))).first()
    return int(row[0]), row[1] == 0


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Ties each node's larger neighbours to the smallest of the node and its neighbours; total: edges, about."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("_n")).select(F.col("x").alias("_x"), F.least("x", "m").alias("m"), "_n")
    return on_hot(both.filter(F.col("y") > F.col("x")), "x", least, "_x", "_n", 2 * total).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select(F.col("u").alias("_u"), "m", "_n")
    moved = on_hot(edges, "u", least, "_u", "_n", total).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter(F.col("_n") > 0)  # the same columns as in the join, so that Spark sums them up once
    return moved.unionByName(own.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
