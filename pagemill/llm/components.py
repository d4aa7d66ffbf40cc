"""Connected components by alternating large-star and small-star rounds.

Edges are first contracted within tasks by a union-find, which leaves at most one a vertex
and task.  If no more than LOCAL are left, one task finishes; it holds 16 bytes an edge.
Beyond that rounds go on: each is two shuffles keyed by vertex; a vertex's neighbours are reduced by ``min``
with map-side aggregation, so a hub of any degree is never gathered in one task.  Rounds
are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import narrow, written

EDGES = "a long, b long"
LOCAL = 2_000_000  # edges that one task may hold


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) for every vertex that is not the least."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(names))
    left, right = index[: len(a)], index[len(a) :]
    while True:  # hook larger roots to smaller ones, then jump pointers to the roots
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        live = low != high
        if not live.any():
            break
        np.minimum.at(parent, high[live], low[live])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    moved = np.flatnonzero(parent != np.arange(len(names)))
    return names[moved], names[parent[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right, held = [], [], 0

    def out() -> pa.RecordBatch:
        child, root = forest(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(child)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            left.append(batch.column(0).to_numpy())
            right.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > LOCAL:
                done = out()
                left, right, held = [done.column(0).to_numpy()], [done.column(1).to_numpy()], done.num_rows
                if held > LOCAL // 2:  # as many vertices: pass them on, later rounds go on
                    yield done
                    left, right, held = [], [], 0
    if held:
        yield out()


def contract(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, EDGES)


def components(edges: DataFrame, limit: int = 60, local: int = LOCAL) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is the least vertex.

    ``edges`` has long columns ``a`` and ``b``.  Null ends and self-loops are ignored,
    direction and repeats don't matter; an empty table gives an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = written(narrow(contract(edges)), "edges")
    if now.count() <= local:
        return _stars(written(contract(now.coalesce(1)), "stars"))
    for _ in range(limit):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        after = written(contract(small), "edges")
        hubs = after.select("a").distinct().join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        multiple = after.groupBy("b").agg(F.countDistinct("a").alias("n")).where("n > 1")
        now = after
        if hubs.limit(1).count() == 0 and multiple.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return _stars(now.distinct())


def _stars(stars: DataFrame) -> DataFrame:
    """Edges (root, vertex) as rows (vertex, component), the roots' own included."""
    return stars.select(F.col("b").alias("vertex"), F.col("a").alias("component")).union(stars.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
