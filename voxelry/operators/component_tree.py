"""The tree of a field's regions above rising thresholds, built in blocks and joined at their borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DIMS, Grid
from ..ship import ship, tidied
from ..storage import Scratch
from .graph import components, union

#: Steps in y and x that one block spans; with all levels of a time step it is a group of a task.
BLOCK = 64
_SCHEMA = "kind int, t long, z long, y long, x long, v double, nodes array<long>, node long, up long, n long"
VOXEL, NODE, BORDER = range(3)


def _rows(kind: int, rows: int, **columns) -> pa.Table:
    kinds = {"v": pa.float64(), "nodes": pa.list_(pa.int64())}
    names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
    of = lambda c: columns[c] if c in columns else pa.nulls(rows, kinds.get(c, pa.int64()))
    return pa.table([pa.array(np.full(rows, kind, np.int32)), *(of(c) if isinstance(of(c), pa.Array) else pa.array(of(c), kinds.get(c, pa.int64())) for c in names[1:])], names=names)


def levels(rank: np.ndarray, u: np.ndarray, v: np.ndarray, top: int) -> list[np.ndarray]:
    """For each level from 0: the smallest voxel that each reaches over voxels of that rank or more; itself where its own is less.

    u, v: neighbours. An edge joins from the lower of its ends' ranks downwards, and is looked at once, at that level.
    """
    level, label, out = np.minimum(rank[u], rank[v]), np.arange(len(rank)), []
    for k in range(top - 1, -1, -1):
        own = level == k
        if own.any():
            nodes, low = union(label[u[own]], label[v[own]])
            to = np.arange(len(rank))
            to[nodes] = low
            label = to[label]
        out.append(label)
    return out[::-1]


def tree(field: DataFrame, value: str, thresholds: list[float], grid: Grid, scratch: Scratch, periodic: tuple[str, ...] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(voxels, nodes) of the regions of neighbours (by faces) at or above each threshold, in one pass for all thresholds.

    voxels: t, z, y, x, v and nodes, the part of its block's tree that holds it at each level from 0. nodes: node, level, region (a number that all parts of
    a region share), up (the region one level below, null at level 0) and n, its voxels. The field has each voxel once; values that are null or
    below all thresholds and rows without a place are left out. No rows: none.

    Voxels move once, to their block, with a copy of those at a border for the block before it. There every edge is looked at
    once, at the highest level that it joins. What a border voxel belongs to on both sides is one region: these ties, of all levels together, are joined by one run of components().
    """
    ship(field.sparkSession)
    marks = sorted(float(x) for x in thresholds)
    count = len(marks)
    rank = sum((F.when(F.col("v") >= m, 1).otherwise(0) for m in marks), F.lit(0)) - 1
    rows = field.select(*(F.col(d).cast("long").alias(d) for d in DIMS), F.col(value).cast("double").alias("v")).dropna().where(F.col("v") >= marks[0])
    rows = rows.withColumn("rank", rank.cast("int")).withColumn("id", grid.id())
    places = [F.struct(F.lit(False).alias("copy"), F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"), *(F.col(d).alias(f"p{d}") for d in ("z", "y", "x")))]
    for d in ("z", "y", "x"):
        wraps, n = d in periodic, grid.size(d)
        first = F.col(d) == 0 if d == "z" else F.col(d) % block == 0
        before = F.when(F.col(d) == 0, F.lit(n - 1)).otherwise(F.col(d) - 1)
        at = {"by": F.col("y"), "bx": F.col("x")} | ({f"b{d}": before} if d != "z" else {})
        to = {f"p{e}": F.col(e) for e in ("z", "y", "x")} | {f"p{d}": before + 1}
        there = F.struct(F.lit(True).alias("copy"), *(F.floor(c / block).alias(b) for b, c in at.items()), *(c.alias(p) for p, c in to.items()))
        asks = first if wraps else first & (F.col(d) > 0) if d != "z" else F.lit(False)
        places.append(F.when(asks, there))
    lies = rows.withColumn("border", F.exists(F.array(*places[1:]), lambda p: p.isNotNull())).withColumn("p", F.explode(F.array_compact(F.array(*places)))).select(*DIMS, "v", "rank", "id", "border", "p.*")

    def run(key, t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("copy", "ascending")])
        ids, ranks, copy = (t[c].to_numpy() for c in ("id", "rank", "copy"))
        p = [t[f"p{d}"].to_numpy() for d in ("z", "y", "x")]
        low = [c.min() for c in p]
        size = [int(c.max() - m) + 2 for c, m in zip(p, low, strict=True)]
        z, y, x = (c - m for c, m in zip(p, low, strict=True))
        place = (z * size[1] + y) * size[2] + x
        order = np.argsort(place)
        u, v = [], []
        for step in (size[1] * size[2], size[2], 1):
            at = np.minimum(np.searchsorted(place[order], place + step), len(place) - 1)
            hit = np.flatnonzero(place[order][at] == place + step)
            u.append(hit)
            v.append(order[at[hit]])
        labels = levels(ranks, np.concatenate(u), np.concatenate(v), count)
        reached = np.stack(labels, axis=1)  # voxel by level
        held = np.arange(count) <= ranks[:, None]
        numbers = ids[reached] * count + np.arange(count)
        own = ~copy
        bounds = np.concatenate([[0], np.cumsum(ranks[own] + 1)])
        voxels = _rows(VOXEL, int(own.sum()), **{d: t[d].to_numpy()[own] for d in DIMS}, v=t["v"].to_numpy()[own], nodes=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbers[own][held[own]])))
        row, level = np.nonzero(held)
        node, first, back = np.unique(numbers[held], return_index=True, return_inverse=True)
        r, k = row[first], level[first]
        up = np.where(k > 0, numbers[r, np.maximum(k - 1, 0)], -1)
        parts = _rows(NODE, len(node), node=node, up=pa.array(up, mask=k == 0), n=np.bincount(back, own[row], len(node)).astype(np.int64))
        edge = t["border"].to_numpy()[row]
        ties = np.unique(np.stack([numbers[held][edge], ids[row[edge]] * count + level[edge]]), axis=1) if edge.any() else np.zeros((2, 0), np.int64)
        ties = ties[:, ties[0] != ties[1]]
        return pa.concat_tables([voxels, parts, _rows(BORDER, ties.shape[1], node=ties[0], up=ties[1])])

    told = scratch.save(lies.groupBy("t", "by", "bx").applyInArrow(tidied(run), _SCHEMA))
    ties = told.where(F.col("kind") == BORDER).select(F.col("node").alias("src"), F.col("up").alias("dst"))
    found = scratch.save(components(ties, scratch))
    nodes = told.where(F.col("kind") == NODE).select("node", "up", "n")
    # a part is only half known in a block that has just its border: the number of a part is that of its smallest voxel, which may lie in another block
    named = nodes.join(found, "node", "left").withColumn("region", F.coalesce("component", "node")).drop("component")
    above = found.select(F.col("node").alias("up"), F.col("component").alias("over"))
    named = named.join(above, "up", "left").withColumn("up", F.coalesce("over", "up"))
    nodes = named.select("node", (F.col("node") % count).cast("int").alias("level"), "region", "up", "n")
    return told.where(F.col("kind") == VOXEL).select(*(F.col(d).cast(field.schema[d].dataType).alias(d) for d in DIMS), "v", "nodes"), scratch.save(nodes)


def leaves(voxels: DataFrame, nodes: DataFrame, thresholds: list[float], min_size: int) -> DataFrame:
    """t, z, y, x, v, rank, region and threshold of the voxels of regions that have min_size voxels or more and hold no such region of a higher threshold."""
    marks = sorted(float(x) for x in thresholds)
    regions = nodes.groupBy("region", "level").agg(F.sum("n").alias("size"), F.max("up").alias("up")).where(F.col("size") >= min_size)
    own = regions.join(regions.select(F.col("up").alias("region")).where("region IS NOT NULL").distinct(), "region", "left_anti").select("region", "level")
    parts = nodes.join(own, ["region", "level"]).select("node", "region", "level").distinct()
    met = voxels.withColumn("node", F.explode("nodes")).drop("nodes").join(parts, "node")
    return met.select(*DIMS, "v", F.col("level").alias("rank"), "region", F.element_at(F.array(*map(F.lit, marks)), F.col("level") + 1).alias("threshold"))
