"""Connected components of an edge table: in one task where there are few edges, by alternating stars where there are many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import checkpointed, join_groups

#: Edges that one task takes, some tens of MB; the labels are the same either way.
FEW_EDGES = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the numbers 0 to n - 1 that each is linked with, by links a - b; a round takes the least of all neighbours, and of their labels' labels."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = np.minimum(label, label[label])
        if (label == before).all() and (label[a] == label[b]).all():
            break
        on = label[a] != label[b]
        a, b = a[on], b[on]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def _labelled(table: pa.Table) -> pa.Table:
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(at[: len(a)], at[len(a) :], len(node))
    return pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(node[label], pa.int64())})


def _nearest(links: DataFrame, most: int) -> DataFrame:
    """(u, v) -> each u's smallest neighbour or itself, beside all its neighbours; there are up to ``most`` links.

    Minima are summed before the shuffle, and those of the few largest nodes are
    broadcast.
    """
    least = links.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("degree")).select("u", F.least("v", "u").alias("m"), "degree")
    return join_groups(links, least, "u", "degree", most, "v").drop("degree")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component; nodes are longs.

    Up to ``few`` edges are one task's.  Otherwise large-star and small-star steps take turns until the edges are the star of each
    component.  No step gathers a node's neighbours, and a node with very many of them
    is spread over the join that tells them the smallest.  Edges of a node to itself make it a
    component of its own; an empty table gives no rows.
    """
    if edges.limit(few + 1).count() <= few:
        return edges.select("a", "b", F.col("a").bitwiseAND(F.lit(0)).alias("task")).groupBy("task").applyInArrow(_labelled, "node long, label long")
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _nearest(large, 2 * now[0])
        e = checkpointed(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct())
    return alone.join(e.select(F.col("u").alias("node"), F.col("v").alias("label")).hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
