"""Connected objects of voxels, and operations on their labels."""

from __future__ import annotations

import uuid
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DIMS, Grid
from ..ship import ship, tidied
from ..storage import Scratch, shuffled
from .graph import components, consecutive, union

#: Steps along x by which runs of neighbouring rows find each other.
STRETCH = 64
#: Steps of t, z and y that one block of rows spans; the runs of a block, with copies of those that border on it, are a group of a task.
BLOCK = {"t": 32, "z": 8, "y": 32}


def offsets(dims: tuple[str, ...], full: bool = False) -> list[dict[str, int]]:
    """Half of the steps to neighbours: faces only, or corners and edges too (full)."""
    steps = [dict(zip(dims, s, strict=True)) for s in product((-1, 0, 1), repeat=len(dims)) if any(s)]
    positive = [s for s in steps if next(v for v in s.values() if v) > 0]
    return positive if full else [s for s in positive if sum(map(abs, s.values())) == 1]


def neighbours(voxels: DataFrame, grid: Grid, dims: tuple[str, ...] = DIMS, full: bool = False, periodic: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst): ids of voxels next to each other, each pair once; one equi-join on ids after an explode.

    A dimension in `periodic` wraps at the grid's size.
    """
    here = voxels.select(*DIMS).withColumn("src", grid.id())
    shifted = []
    for step in offsets(dims, full):
        place, inside = {}, F.lit(True)
        for d in DIMS:
            to = F.col(d) + step.get(d, 0)
            if d in periodic and step.get(d):
                to = F.pmod(to, F.lit(grid.size(d)))
            elif step.get(d):
                inside = inside & (to >= 0)
                if d in ("z", "y", "x"):
                    inside = inside & (to < grid.size(d))
            place[d] = to.cast("long")
        where = ((place["t"] * grid.z + place["z"]) * grid.y + place["y"]) * grid.x + place["x"]
        shifted.append(F.when(inside, where))
    asked = here.select("src", F.explode(F.array_compact(F.array(*shifted))).alias("dst"))
    return asked.join(here.select(F.col("src").alias("dst")), "dst").select("src", "dst")


def runs(voxels: DataFrame, grid: Grid, first: str = "first") -> DataFrame:
    """The voxels with `first`: the id of the first voxel of their run, an unbroken stretch along x in one row of the grid.

    A row of the grid is sorted by itself; no row is longer than the grid. Voxels that repeat lie in the same run.
    """
    row = ["t", "z", "y"]
    stretch = F.col("x") - F.dense_rank().over(Window.partitionBy(*row).orderBy("x"))
    return voxels.withColumn(first, stretch).withColumn(first, grid.id() - F.col("x") + F.min("x").over(Window.partitionBy(*row, first)))


def run_ends(placed: DataFrame, first: str, names: tuple[str, str]) -> DataFrame:
    """The voxels of runs() with two more columns, set on one voxel of each run and null on the others: the run's last x and its number of voxels.

    So the runs can be read off the voxels without another shuffle.
    """
    run = Window.partitionBy("t", "z", "y", first)
    leads = F.row_number().over(run.orderBy("x")) == 1
    return placed.select("*", *(F.when(leads, c.over(run)).alias(n) for n, c in zip(names, (F.max("x"), F.count(F.lit(1))), strict=True)))


def run_neighbours(rows: DataFrame, grid: Grid, dims: tuple[str, ...] = DIMS, full: bool = False, periodic: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst): runs (t, z, y, lo, hi, first) that touch, in neighbouring rows of the grid or over a periodic end of x; each pair once or twice.

    A run asks the rows before and after it in half of the directions. It meets the runs there by stretches of STRETCH steps, in the first stretch that both have.
    """
    steps = [s for s in offsets(tuple(d for d in dims if d != "x"), full)] if len(dims) > 1 else []
    reach = 1 if full else 0
    span = lambda low, high: F.struct(low, high).cast("struct<from:bigint,to:bigint>")
    spans = [span(F.col("lo") - reach, F.col("hi") + reach)]
    if full and "x" in periodic:  # corners over the end of the row
        spans += [F.when(F.col(c) == here, span(F.lit(there), F.lit(there))) for c, here, there in (("lo", 0, grid.x - 1), ("hi", grid.x - 1, 0))]
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in ("t", "z", "y", "lo", "hi", "first")))
    there = rows.select("t", "z", "y", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("first").alias("dst"), F.explode(F.sequence(F.floor(F.col("lo") / STRETCH), F.floor(F.col("hi") / STRETCH))).alias("stretch"))
    places = []
    for step in steps:
        place, inside = {}, F.lit(True)
        for d in ("t", "z", "y"):
            to = F.col(d) + step.get(d, 0)
            if d in periodic and step.get(d):
                to = F.pmod(to, F.lit(grid.size(d)))
            elif step.get(d):
                inside = inside & (to >= 0) & ((to < grid.size(d)) if d != "t" else F.lit(True))
            place[d] = to.cast("long")
        places.append(F.when(inside, F.struct(*place.values()).cast("struct<t:bigint,z:bigint,y:bigint>")))
    out = []
    if places:
        asked = rows.select(F.col("first").alias("src"), F.explode(F.array_compact(F.array(*spans))).alias("s"), F.array_compact(F.array(*places)).alias("p")).select("src", "s.*", F.explode("p").alias("p")).select("src", "from", "to", "p.*")
        asked = asked.withColumn("stretch", F.explode(F.sequence(F.floor(F.greatest("from", F.lit(0)) / STRETCH), F.floor(F.col("to") / STRETCH))))
        met = asked.join(there, ["t", "z", "y", "stretch"]).where("from <= hi2 AND to >= lo2")
        once = F.col("stretch") == F.floor(F.greatest("from", "lo2", F.lit(0)) / STRETCH)
        out.append(met.where(once).select("src", "dst"))
    if "x" in periodic:
        ends = rows.where(F.col("hi") == grid.x - 1).select("t", "z", "y", F.col("first").alias("src"))
        out.append(ends.join(rows.where("lo = 0").select("t", "z", "y", F.col("first").alias("dst")), ["t", "z", "y"]).select("src", "dst"))
    if not out:
        return rows.where("false").select(F.col("first").alias("src"), F.col("first").alias("dst"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _touching(row: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, grid: Grid, steps: list[dict[str, int]], full: bool, periodic: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs that touch, of runs in the order of their rows (t, z, y) and of lo."""
    key = lambda r: (r[0] * grid.z + r[1]) * grid.y + r[2]
    keys, at = np.unique(key(row), return_inverse=True)
    base, reach, every = int(lo.min()) - 2, int(full), np.ones(len(lo), bool)
    width = int(hi.max()) - base + 4
    firsts, lasts, out = at * width + (lo - base), at * width + (hi - base), []
    west, east, far = lo == 0, hi == grid.x - 1, np.full(len(lo), grid.x - 1)
    spans = [(every, lo - reach, hi + reach)]
    if full and "x" in periodic:
        spans += [(west, far, far), (east, far - far, far - far)]
    asks = [(step, spans) for step in steps]
    if "x" in periodic:
        asks.append(({}, [(east, far - far, far - far)]))
    for step, asked in asks:
        to, inside = [], every
        for d, r in zip(("t", "z", "y"), row, strict=True):
            r = r + step.get(d, 0)
            if d in periodic and step.get(d):
                r = r % grid.size(d)
            elif step.get(d):
                inside = inside & (r >= 0) & ((r < grid.size(d)) | (d == "t"))
            to.append(r)
        where = np.minimum(np.searchsorted(keys, key(to)), len(keys) - 1)
        inside = inside & (keys[where] == key(to))
        for mask, low, high in asked:
            own = np.flatnonzero(inside & mask)
            a = np.searchsorted(lasts, where[own] * width + np.clip(low[own] - base, 0, width - 1))
            b = np.searchsorted(firsts, where[own] * width + np.clip(high[own] - base, 0, width - 1), "right")
            n = np.maximum(b - a, 0)
            out.append((np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (at[:0], at[:0])


def block_parts(rows: DataFrame, grid: Grid, dims: tuple[str, ...] = DIMS, full: bool = False, periodic: tuple[str, ...] = ()) -> DataFrame:
    """Of runs (t, z, y, lo, hi, first, n): each with its part (tie false: node, part, n), and ties of nodes to parts (tie true: node, part).

    A run is dealt to its block of rows, and as a copy to each block that its neighbours in half of the directions lie in. There all pairs that touch are found
    and joined. A run without a copy has as its part the smallest run that it reaches in its block; one with copies is its own part, and its ties say what it reaches in each of
    its blocks. So only runs at borders are left to be joined.
    """
    ship(rows.sparkSession)
    steps = offsets(tuple(d for d in dims if d != "x"), full) if len(dims) > 1 else []
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in ("t", "z", "y", "lo", "hi", "first", "n")))
    blocks = []
    for step in ({}, *steps):
        place, inside = [], F.lit(True)
        for d in ("t", "z", "y"):
            to = F.col(d) + step.get(d, 0)
            if d in periodic and step.get(d):
                to = F.pmod(to, F.lit(grid.size(d)))
            elif step.get(d):
                inside = inside & (to >= 0) & ((to < grid.size(d)) if d != "t" else F.lit(True))
            place.append(F.floor(to / BLOCK[d]))
        blocks.append(F.when(inside, F.xxhash64(*place)))  # blocks of the same hash are one group
    dealt = rows.withColumn("blocks", F.array_distinct(F.array_compact(F.array(*blocks)))).withColumn("copied", F.size("blocks") > 1)
    dealt = dealt.select("t", "z", "y", "lo", "hi", "first", "n", "copied", F.posexplode("blocks").alias("copy", "block"))

    def parts(table: pa.Table) -> pa.Table:
        c = {k: table[k].to_numpy() for k in ("t", "z", "y", "lo", "hi", "first", "n", "copied", "copy")}
        order = np.lexsort([c[k] for k in ("lo", "y", "z", "t")])
        c = {k: v[order] for k, v in c.items()}
        i, j = _touching([c["t"], c["z"], c["y"]], c["lo"], c["hi"], grid, steps, full, periodic)
        part = c["first"].copy()
        nodes, low = union(part[i], part[j])
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, part), len(nodes) - 1)
            part = np.where(nodes[at] == part, low[at], part)
        own, tied = c["copy"] == 0, c["copied"] & (part != c["first"])
        column = lambda a, b: pa.array(np.concatenate([a, b]))
        return pa.table([
            column(np.zeros(own.sum(), bool), np.ones(tied.sum(), bool)), column(c["first"][own], c["first"][tied]),
            column(np.where(c["copied"], c["first"], part)[own], part[tied]), column(c["n"][own], np.zeros(tied.sum(), np.int64)),
        ], names=["tie", "node", "part", "n"])

    return dealt.groupBy("block").applyInArrow(tidied(parts), "tie boolean, node long, part long, n long")


def label(voxels: DataFrame, grid: Grid, scratch: Scratch, dims: tuple[str, ...] = DIMS, full: bool = False, periodic: tuple[str, ...] = (), min_size: int = 1, column: str = "label") -> DataFrame:
    """The voxels with the number of their object: neighbours over `dims`, among them x, belong together.

    Dimensions left out are labelled slice by slice, with numbers that never collide. Numbers run
    from 1 in the order of each object's first voxel. Objects below min_size are left out. Voxels that repeat
    keep their rows and count as often; rows with a null place have no object and are left out. Other columns stay, but for one of the
    name `column`, which is replaced. No rows: none.

    Runs along x stand for their voxels; they are joined in blocks of rows, and over the borders of blocks by what touches those. Each voxel moves twice, to its
    row and to its run's number.
    """
    first, own, last, size = (f"_{uuid.uuid4().hex}" for _ in range(4))  # no column of the voxels
    kept = [c for c in voxels.columns if c != column]
    placed = shuffled(scratch.save(run_ends(runs(voxels.select(*(voxels[f"`{c}`"] for c in kept)).dropna(subset=list(DIMS)), grid, first), first, (last, size))))
    rows = placed.where(F.col(size).isNotNull()).select("t", "z", "y", F.col("x").alias("lo"), F.col(last).alias("hi"), F.col(first).alias("first"), F.col(size).alias("n"))
    known = shuffled(scratch.save(block_parts(rows, grid, dims, full, periodic)))
    found = components(known.where("tie").select(F.col("node").alias("src"), F.col("part").alias("dst")), scratch).withColumnRenamed("node", "part")
    parts = known.where("NOT tie").groupBy("part").agg(F.sum("n").alias("n")).join(found, "part", "left").select("part", "n", F.coalesce("component", "part").alias("root"))
    parts = shuffled(scratch.save(parts))
    if min_size > 1:
        parts = parts.join(parts.groupBy("root").agg(F.sum("n").alias("all")).where(F.col("all") >= min_size).select("root"), "root")
    numbers = parts.join(consecutive(parts, "root", scratch, "number"), "root").select("part", "number")
    numbers = known.where("NOT tie").join(numbers, "part").select(F.col("node").alias(own), F.col("number").alias(column))
    return placed.join(numbers, F.col(first) == F.col(own)).drop(first, own, last, size)


#: Ways to connect voxels by name: whether corners and edges join too.
METHODS = {"faces": False, "corners": True}


def connect(voxels: DataFrame, grid: Grid, scratch: Scratch, method: str = "faces", **how) -> DataFrame:
    """label() by the name of a method; ValueError for an unknown one."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    return label(voxels, grid, scratch, full=METHODS[method], **how)


def union_masks(masks: list[DataFrame], column: str = "label") -> DataFrame:
    """Voxelwise greatest label of several masks."""
    every = masks[0].select(*DIMS, column)
    for m in masks[1:]:
        every = every.unionByName(m.select(*DIMS, column))
    return every.groupBy(*DIMS).agg(F.max(column).alias(column))


def force_consecutive(mask: DataFrame, scratch: Scratch, column: str = "label") -> DataFrame:
    """Labels renumbered from 1 without gaps, in their order."""
    ranks = consecutive(mask, column, scratch, "_new")
    return mask.join(ranks, column).drop(column).withColumnRenamed("_new", column)


def apply_mapping(mask: DataFrame, mapping: DataFrame, column: str = "label", to: str | None = None, keep_zero: bool = False) -> DataFrame:
    """Labels replaced through (old, new); unmapped ones become 0, which is background."""
    out = mask.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    out = out.withColumn("_new", F.coalesce("_new", F.lit(0).cast("long")))
    out = out if keep_zero else out.where("_new <> 0")
    return out.drop(column).withColumnRenamed("_new", to or column)


def overlapping(parent: DataFrame, child: DataFrame, per_time: bool = False, column: str = "label") -> DataFrame:
    """Voxels of children that share a voxel with any parent: ever, or (per_time) in that time step."""
    touched = child.join(parent.select(*DIMS), list(DIMS), "left_semi")
    keys = ["t", column] if per_time else [column]
    return child.join(touched.select(*keys).distinct(), keys, "left_semi")


def binary_erode(voxels: DataFrame, times: int = 1, keys: tuple[str, ...] = ("t", "z")) -> DataFrame:
    """Voxels whose eight neighbours in the (y, x) slice are there, `times` times over; the grid's edge erodes."""
    place = [*keys, "y", "x"]
    now = voxels.select(*place).distinct()
    for _ in range(times):
        square = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
        seen = now.select(*keys, square.alias("p")).select(*keys, "p.y", "p.x").groupBy(*place).agg(F.count("*").alias("k"))
        now = now.join(seen.where("k = 9").select(*place), place, "left_semi")
    return now
