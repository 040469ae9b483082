"""Connected components of a graph that no machine can hold.

Edges are contracted inside each partition by a union-find (a path of any length
inside one becomes a star).  Then, round by round, each vertex takes the smallest of
its neighbours and itself as its parent, edges move to the parents, and those inside
one parent go; the graph shrinks until no edge is left, and the parents of all rounds
give the labels.  Vertices compete by a one-to-one hash, so the order of ids (chains
of rising ids, say) cannot slow this down.  Only a flag reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import cut, discard, ship


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex reachable) for the graph of edges a-b; roots are left out."""
    names, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges of a partition, folded in as they come."""
    a, b, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        a = np.concatenate((a, batch.column(0).to_numpy(zero_copy_only=False)))
        b = np.concatenate((b, batch.column(1).to_numpy(zero_copy_only=False)))
        fresh += batch.num_rows
        if fresh > 1 << 20:
            (a, b), fresh = stars(a, b), 0
    a, b = stars(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, partial: bool = False) -> DataFrame:
    """edges: two long columns.  Returns (vertex, component) for every vertex with an edge to another; component is a vertex of it.

    Nulls and self-edges are ignored; an empty input gives an empty result.  Raises
    RuntimeError if most_rounds is not enough, never a partial result, unless partial:
    then one round is made, and equal labels mean one component, but not the reverse.
    """
    ship(edges.sparkSession)
    x, y = edges.columns[:2]
    scrambled = [F.xxhash64(F.col(c).cast("long")).alias(n) for c, n in ((x, "u"), (y, "v"))]
    e = edges.where(F.col(x) != F.col(y)).select(*scrambled, F.col(x).cast("long").alias("p"), F.col(y).cast("long").alias("q"))
    names = e.select(F.col("u").alias("h"), F.col("p").alias("vertex")).union(e.select(F.col("v").alias("h"), F.col("q").alias("vertex"))).distinct()
    e = cut(e.select("u", "v").mapInArrow(_contract, "u long, v long"), "edges")
    label, old = None, []
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "parents")
        up = parent.withColumnRenamed("u", "c")
        if label is None:
            label = parent.select(F.col("u").alias("h"), F.col("m").alias("c"))
        else:  # written each round, so that plans stay small
            label, old = cut(label.join(up, "c", "left").select("h", F.coalesce("m", "c").alias("c")), "labels"), [*old, label, parent]
        if partial:
            break
        moved = e.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("x")).join(parent, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v")
        e, before = cut(moved.mapInArrow(_contract, "u long, v long"), "edges"), e
        discard(before, *(t for t in old if hasattr(t, "_cut_path")))
        old = []
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    named = names.join(label, "h").select("vertex", "c")
    return named.join(names.select(F.col("h").alias("c"), F.col("vertex").alias("component")), "c").select("vertex", "component")


def smallest(labelled: DataFrame) -> DataFrame:
    """(vertex, component) with the smallest vertex of each component as its label."""
    low = labelled.groupBy("component").agg(F.min("vertex").alias("low"))
    return labelled.join(low, "component").select("vertex", F.col("low").alias("component"))
