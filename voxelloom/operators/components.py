"""Connected components of a mask, labelled over bricks: each brick by itself, then what meets over their faces.

A brick is labelled with one voxel more on its upper sides, so that of two voxels that
touch over a face, an edge or a corner one brick has both.  A voxel that several bricks
have says which of their components are one.  Those links are few beside the voxels:
they are contracted in rounds (each component goes over to its least neighbour) until
one task can hold what is left.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.bricks import SIDE, Brick, in_bricks
from voxelloom.operators.lattice import AXES
from voxelloom.operators.roi import in_raster_order
from voxelloom.plans.saving import saved

#: Links that one task may merge; beyond, they are contracted first.
FEW_LINKS = 500_000
#: Bits of a component's number that tell its brick along each axis; the rest tell it within the brick.
_BRICK_BITS, _INNER_BITS = 15, 17
_PARTS = [("n_voxels", T.LongType()), *[(f"{f}_{a}", T.LongType()) for a in AXES for f in ("min", "max")], ("first", T.LongType())]


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' sets, where items a and b of each pair are in one set."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _offsets(neighbours: int) -> list[tuple[int, int, int]]:
    """One of each two opposite directions to a voxel's 6, 18 or 26 neighbours."""
    if neighbours not in (6, 18, 26):
        raise ValueError("a voxel has 6, 18 or 26 neighbours")
    most = {6: 1, 18: 2, 26: 3}[neighbours]
    return [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0) and sum(map(abs, d)) <= most]


def local_components(mask: np.ndarray, neighbours: int = 26) -> np.ndarray:
    """For each place the flat place of its component's first one; -1 where the mask isn't set."""
    places = np.arange(mask.size).reshape(mask.shape)
    a, b = [], []
    for d in _offsets(neighbours):
        here = tuple(slice(max(-k, 0), n - max(k, 0)) for k, n in zip(d, mask.shape, strict=True))
        there = tuple(slice(max(k, 0), n + min(k, 0)) for k, n in zip(d, mask.shape, strict=True))
        on = mask[here] & mask[there]
        a.append(places[here][on])
        b.append(places[there][on])
    found = union(mask.size, np.concatenate(a), np.concatenate(b)).reshape(mask.shape)
    return np.where(mask, found, -1)


def _node(brick: Brick, label: np.ndarray) -> np.ndarray:
    """Numbers of a brick's components that no other brick has."""
    number = 0
    for c in ("_bx", "_by", "_bz"):
        number = (number << _BRICK_BITS) + int(brick.table.column(c)[0].as_py()) + 1  # a halo alone may be before the first brick
    return (number << _INNER_BITS) + label


def _placed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A voxel's place as one number, in raster order."""
    return (z << 42) + (y << 21) + x


def _found(mask: str, side: int, neighbours: int):
    """Rows of a brick: its components' own voxels, box and first place, and the voxels that other bricks have too."""

    def run(brick: Brick) -> pa.Table:
        volume = brick.table.column("volume_id")[0].as_py()
        label = local_components(brick.grid(mask) != 0, neighbours)[brick.at]
        there = label >= 0
        x, y, z = (p.astype(np.int64)[there] for p in brick.place)
        own = np.zeros(len(label), bool)
        own[brick.own] = True
        own, node = own[there], _node(brick, label[there])
        first = _placed(x, y, z)
        rows = []
        mine = node[own]
        order = np.argsort(mine, kind="stable")
        begin = np.flatnonzero(np.append(True, mine[order][1:] != mine[order][:-1])) if len(order) else order
        if len(begin):
            sums = [np.diff(np.append(begin, len(order)))]
            for p in (x, y, z):
                sums += [np.minimum.reduceat(p[own][order], begin), np.maximum.reduceat(p[own][order], begin)]
            sums.append(np.minimum.reduceat(first[own][order], begin))
            rows.append((mine[order][begin], np.full(len(begin), -1), sums))
        # A voxel of the lower faces is in the halo of a brick below; one of the halo is another brick's own.
        shared = ~own | (x % side == 0) | (y % side == 0) | (z % side == 0)
        if shared.any():
            rows.append((node[shared], first[shared], [np.zeros(int(shared.sum()), np.int64)] * len(_PARTS)))
        if not rows:
            return pa.Table.from_pylist([], _ARROW)
        cols = [np.concatenate([r[i] for r in rows]) for i in (0, 1)] + [np.concatenate([r[2][k] for r in rows]) for k in range(len(_PARTS))]
        return pa.Table.from_arrays([pa.array([volume] * len(cols[0]), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], schema=_ARROW)

    return run


_SCHEMA = T.StructType([T.StructField("volume_id", T.StringType()), T.StructField("node", T.LongType()), T.StructField("place", T.LongType()), *[T.StructField(n, k) for n, k in _PARTS]])
_ARROW = pa.schema([("volume_id", pa.string()), *[(n, pa.int64()) for n in ("node", "place", *[p[0] for p in _PARTS])]])


def least_members(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(volume_id, node, root) of the nodes that links (volume_id, a, b) name: the least node of each one's component.

    While there are more than ``few`` links, each node goes over to its least neighbour if
    that is less, chains of such steps are cut short by doubling, and links are renamed; at
    least half of all nodes that have links are gone after a round.  What is left is merged
    in one task.
    """
    links = saved(links)
    steps = []
    keys = ["volume_id", "node"]
    while (n := links.count()) > few:
        both = links.unionByName(links.select("volume_id", F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("volume_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            on = up.select("volume_id", F.col("node").alias("root"), F.col("root").alias("further"))
            further = saved(up.join(on, ["volume_id", "root"]).select(*keys, F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
            up, more = further.drop("moved"), not further.filter("moved").isEmpty()
            if not more:
                break
        steps.append(up)
        renamed = links
        for c in ("a", "b"):
            renamed = renamed.join(up.select("volume_id", F.col("node").alias(c), F.col("root").alias(f"_{c}")), ["volume_id", c])
        links = saved(renamed.select("volume_id", F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct())
    roots = _merged(links) if n else links.select("volume_id", F.col("a").alias("node"), F.col("b").alias("root"))
    for up in reversed(steps):
        last = roots.select("volume_id", F.col("node").alias("root"), F.col("root").alias("_root"))
        roots = up.join(last, ["volume_id", "root"], "left").select(*keys, F.coalesce("_root", "root").alias("root"))
    return roots


def _merged(links: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in "ab")
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[union(len(nodes), at[: len(a)], at[len(a) :])]
        return pa.Table.from_arrays([pa.array([table.column("volume_id")[0].as_py()] * len(nodes), pa.string()), pa.array(nodes), pa.array(root)], names=["volume_id", "node", "root"])

    return links.groupBy("volume_id").applyInArrow(run, "volume_id string, node long, root long")


def _components(voxels: DataFrame, mask: str, neighbours: int, side: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Parts of components in bricks, and the root of each part that has links."""
    rows = voxels.filter(F.col(mask) != 0).select(F.col("volume_id").cast("string").alias("volume_id"), *AXES, F.lit(1).alias(mask))
    found = saved(in_bricks(rows, (1, 1, 1), _found(mask, side, neighbours), _SCHEMA, side=side, below=(0, 0, 0), halo_alone=True))
    met = found.filter("place >= 0").groupBy("volume_id", "place").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    links = met.select("volume_id", F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b").distinct()
    return found.filter("place < 0"), least_members(links, few)


def component_objects(voxels: DataFrame, mask: str = "m", neighbours: int = 26, side: int = SIDE, few: int = FEW_LINKS) -> DataFrame:
    """(volume_id, label, n_voxels, min_x, max_x, .. max_z) of the connected components of each volume's mask.

    Voxels touch over faces (6 ``neighbours``), edges too (18), or corners too (26).
    Components are numbered from 1 in the raster order of their first voxels.  Voxels that
    aren't there count as outside of the mask; a volume without any in it has no rows.
    Places are from 0 to about a million.
    """
    parts, roots = _components(voxels, mask, neighbours, side, few)
    return _objects(parts, roots).select("volume_id", "label", *[n for n, _ in _PARTS if n != "first"])


def _objects(parts: DataFrame, roots: DataFrame) -> DataFrame:
    sums = {"n_voxels": F.sum, "first": F.min} | {f"{f}_{a}": getattr(F, f) for a in AXES for f in ("min", "max")}
    whole = parts.join(roots, ["volume_id", "node"], "left").groupBy("volume_id", F.coalesce("root", "node").alias("root")).agg(*[f(n).alias(n) for n, f in sums.items()])
    low = (1 << 21) - 1
    placed = whole.withColumns({"z": F.shiftright("first", 42), "y": F.shiftright("first", 21).bitwiseAND(low), "x": F.col("first").bitwiseAND(low)})
    return in_raster_order(placed, "_rank").withColumn("label", F.col("_rank") + 1)


def labelled_components(voxels: DataFrame, mask: str = "m", neighbours: int = 26, name: str = "label", side: int = SIDE, few: int = FEW_LINKS) -> DataFrame:
    """Every voxel with the number of its component, 0 outside of the mask; numbers are those of ``component_objects``."""
    parts, roots = _components(voxels, mask, neighbours, side, few)
    label = _objects(parts, roots).select("volume_id", "root", F.col("label").alias(name))
    by_node = parts.select("volume_id", "node").distinct().join(roots, ["volume_id", "node"], "left").select("volume_id", "node", F.coalesce("root", "node").alias("root")).join(label, ["volume_id", "root"]).select("volume_id", "node", name)
    schema = T.StructType([T.StructField("volume_id", T.StringType()), *[T.StructField(a, T.LongType()) for a in AXES], T.StructField("node", T.LongType())])

    def run(brick: Brick) -> pa.Table:
        label = local_components(brick.grid(mask) != 0, neighbours)[brick.at]
        own = brick.own
        cols = [brick.table.column("volume_id").take(pa.array(own)), *[pa.array(p[own].astype(np.int64)) for p in brick.place], pa.array(_node(brick, label[own]))]
        return pa.Table.from_arrays(cols, names=["volume_id", *AXES, "node"])

    rows = voxels.filter(F.col(mask) != 0).select(F.col("volume_id").cast("string").alias("volume_id"), *AXES, F.lit(1).alias(mask))
    nodes = in_bricks(rows, (1, 1, 1), run, schema, side=side, below=(0, 0, 0))
    found = nodes.join(by_node, ["volume_id", "node"]).drop("node")
    return voxels.join(found, ["volume_id", *AXES], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
