"""Features by nested thresholds, watershed segmentation, and linking of features in time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DIMS, Grid
from ..ship import ship, tidied
from ..storage import Scratch, partitions
from .assign import least_total
from .component_tree import leaves, tree
from .graph import components, consecutive
from .labelling import binary_erode, label, neighbours

SPACE = ("z", "y", "x")
#: Pairs of features that one task links one by one, at most.
PART = 1 << 16
#: Voxels whose rows of the grid one group of a task smooths, about.
LINES = 1 << 17


@dataclass(frozen=True)
class Subnet:
    """How many features of a step may compete for each other, and how the radius adapts to more: by which factor, and down to which share of it."""

    most: int = 30
    step: float = 0.95
    stop: float = 0.2


def smooth(field: DataFrame, value: str, sigma: float, grid: Grid, dims: tuple[str, ...] = SPACE, truncate: float = 4.0) -> DataFrame:
    """t, z, y, x and the value under a Gaussian of `sigma` grid steps, axis by axis; missing voxels count as 0, and the grid's edges mirror.

    Each voxel tells the ones in reach what it adds to them, so only voxels near others come into being. Rows of the grid lie whole in a group, many
    together, so only voxels are shuffled, once for each axis. Voxels that repeat add up; null values and rows without a place are left out. No rows: none.
    """
    ship(field.sparkSession)
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    out = field.select(*DIMS, F.col(value).cast("double").alias(value)).dropna()
    parts = max(partitions(field.sparkSession), -(-out.count() // LINES))
    for d in dims:
        rest = [c for c in DIMS if c != d]
        dealt = out.withColumn("part", F.pmod(F.xxhash64(*rest), F.lit(parts)).cast("int"))
        out = dealt.groupBy("part").applyInArrow(tidied(_along(rest, d, value, grid.size(d), reach, weights)), out.schema)
    return out


def _along(rest: list[str], d: str, value: str, n: int, reach: int, weights: list[float]):
    def run(key, t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (*rest, d, value)])
        keys, here, v = [t[c].to_numpy() for c in rest], t[d].to_numpy().astype(np.int64), t[value].to_numpy()
        fresh = np.ones(len(v), bool)
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        line, head = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        to, add = [], []
        for k, w in zip(range(-reach, reach + 1), weights, strict=True):
            for turn in range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2):  # itself and its images, which repeat every 2 n steps
                for place in (here - k, -here - 1 - k):
                    at = place + 2 * n * turn
                    hit = (at >= 0) & (at < n)
                    if hit.any():
                        to.append(line[hit] * n + at[hit])
                        add.append(v[hit] * w)
        cells, back = np.unique(np.concatenate(to), return_inverse=True)
        which, place = head[cells // n], cells % n
        columns = {c: pa.array(k[which]) for c, k in zip(rest, keys, strict=True)} | {d: pa.array(place.astype(t[d].to_numpy().dtype)), value: pa.array(np.bincount(back, np.concatenate(add), len(cells)))}
        return pa.table([columns[c] for c in (*DIMS, value)], names=[*DIMS, value])

    return run


def _centre(d: str, grid: Grid, periodic: tuple[str, ...]) -> Column:
    """Mean place along an axis, weighted by `over` where there is any; along a periodic one on the circle."""

    def mean(c: Column) -> Column:
        return F.when(F.sum("over") > 0, F.sum(c * F.col("over")) / F.sum("over")).otherwise(F.avg(c))

    if d not in periodic:
        return mean(F.col(d)).alias(f"{d}c")
    turn = 2 * math.pi / grid.size(d)
    angle = F.atan2(mean(F.sin(F.col(d) * turn)), mean(F.cos(F.col(d) * turn)))
    return F.pmod(angle / turn, F.lit(float(grid.size(d)))).alias(f"{d}c")


def _eroded(field: DataFrame, value: str, thresholds: list[float], min_size: int, grid: Grid, scratch: Scratch, erode: int, periodic: tuple[str, ...]) -> DataFrame:
    """What leaves() gives, if regions lose their rim first, so that they needn't nest: each threshold is labelled by itself."""
    parts = []
    for k, level in enumerate(sorted(thresholds)):
        above = field.where(F.col(value) >= level)
        above = above.join(binary_erode(above, erode), list(DIMS), "left_semi")
        found = label(above, grid, scratch, dims=SPACE, min_size=min_size, column="region", periodic=periodic)
        parts.append(found.select(*DIMS, F.col(value).alias("v"), "region", F.lit(float(level)).alias("threshold"), F.lit(k).alias("rank")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = scratch.save(every)
    top = every.groupBy(*DIMS).agg(F.max("rank").alias("top"))
    outer = every.join(top, list(DIMS)).where("top > rank").select("rank", "region").distinct()
    return every.join(outer, ["rank", "region"], "left_anti")


def detect_features(field: DataFrame, value: str, thresholds: list[float], min_size: int, grid: Grid, scratch: Scratch, min_distance: float = 0.0, sigma: float = 0.0, erode: int = 0, periodic: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, their voxels): regions at or above each threshold, of at least min_size voxels, per time step.

    With sigma the field is smoothed first; with erode the voxels above a threshold lose their rim
    (in y and x) so often before they are joined; periodic axes wrap.

    A region that holds a region of a higher threshold is replaced by it. Positions are means
    weighted by what exceeds the threshold (plain means where nothing does). With min_distance, a
    feature goes if a stronger one (threshold, size, then smaller id) lies nearer in its step.
    Feature numbers run from 1 by threshold, then first voxel.
    """
    if sigma:
        field = scratch.save(smooth(field, value, sigma, grid))
    own = (_eroded(field, value, thresholds, min_size, grid, scratch, erode, periodic) if erode else leaves(*tree(field, value, thresholds, grid, scratch, periodic), thresholds, min_size)).withColumn("over", F.col("v") - F.col("threshold"))
    features = own.groupBy("t", "threshold", "rank", "region").agg(F.count("*").alias("size"), F.max("v").alias("peak"), *(_centre(d, grid, periodic) for d in SPACE), F.min(grid.id()).alias("first"))
    if min_distance > 0:
        features = _apart(features, min_distance)
    features = scratch.save(features.withColumn("_key", F.struct("rank", "first")))
    ranks = consecutive(features, "_key", scratch, "feature")
    features = features.join(ranks, "_key").drop("_key")
    members = own.join(features.select("rank", "region", "feature"), ["rank", "region"]).select(*DIMS, "feature")
    return features.select("feature", "t", "threshold", "size", "peak", "zc", "yc", "xc"), members


def _apart(features: DataFrame, distance: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    f = features.withColumn("_cy", cell("yc")).withColumn("_cx", cell("xc"))
    ask = f.select("t", "rank", "region", "size", "first", "zc", "yc", "xc", "_cy", "_cx").withColumn("_a", around).withColumn("_b", around).withColumn("_cy", F.col("_cy") + F.col("_a")).withColumn("_cx", F.col("_cx") + F.col("_b"))
    o = f.select("t", "_cy", "_cx", *(F.col(c).alias(f"o_{c}") for c in ("rank", "size", "first", "zc", "yc", "xc")))
    met = ask.join(o, ["t", "_cy", "_cx"])
    d = F.sqrt(F.pow(F.col("zc") - F.col("o_zc"), 2) + F.pow(F.col("yc") - F.col("o_yc"), 2) + F.pow(F.col("xc") - F.col("o_xc"), 2))
    stronger = F.struct("o_rank", "o_size", -F.col("o_first")) > F.struct("rank", "size", -F.col("first"))
    return features.join(met.where((d < distance) & stronger).select("rank", "region").distinct(), ["rank", "region"], "left_anti")


def box_seeds(features: DataFrame, size: int, grid: Grid) -> DataFrame:
    """t, z, y, x, feature: the voxels of a box of `size` steps around each feature's rounded place; where boxes meet, of the nearer feature (then the smaller number)."""
    half = F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size // 2)))
    out = features.select("feature", "t", "zc", "yc", "xc")
    for d in SPACE:
        out = out.withColumn(f"_{d}", half).withColumn(d, (F.round(f"{d}c") + F.col(f"_{d}")).cast("int")).where((F.col(d) >= 0) & (F.col(d) < grid.size(d)))
    far = sum((F.pow(F.col(d) - F.col(f"{d}c"), 2) for d in SPACE), F.lit(0.0))
    return out.groupBy(*DIMS).agg(F.min_by("feature", F.struct(F.round(far, 9).alias("d"), "feature")).alias("feature"))


def watershed(field: DataFrame, value: str, seeds: DataFrame, threshold: float, grid: Grid, scratch: Scratch, most_rounds: int = 60, full: bool = False, periodic: tuple[str, ...] = ()) -> DataFrame:
    """Voxels above the threshold under the seed (t, z, y, x, feature) whose basin floods them, high values first.

    The basins are the spanning forest with the greatest least values along its paths, rooted at
    the seeds: in each round every part without a seed joins its neighbour over its best edge
    (value of the edge's lower end, then the smaller ids), so rounds grow with the logarithm of a
    basin. Voxels that no seed reaches are left out. Neighbours are faces, or with `full` corners
    and edges too; periodic axes wrap. After a round only the best edge between two parts stays, so edges fall with the parts, and voxels
    are told their part once, at the end. Rounds at least halve the parts without a seed that can still
    join, so most_rounds is never met; if it were, it raises.
    """
    nodes = scratch.save(field.where(F.col(value) > threshold).withColumn("id", grid.id()).select(*DIMS, "id", F.col(value).alias("v")))
    pairs = neighbours(nodes, grid, SPACE, full, periodic)
    height = nodes.select("id", "v")
    edges = pairs.join(height.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(height.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    edges = scratch.save(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.least("a", "b").alias("w")).distinct())
    rooted = seeds.withColumn("id", grid.id()).groupBy("id").agg(F.min("feature").cast("long").alias("feature"))
    # part: a seeded part is named -feature, any other by its smallest voxel
    part = scratch.save(nodes.join(rooted, "id", "left").select("id", F.coalesce(-F.col("feature"), F.col("id")).alias("part")))
    ends = edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("pa")), "src").join(part.select(F.col("id").alias("dst"), F.col("part").alias("pb")), "dst")
    open_, joined = scratch.save(_contracted(ends)), []
    for _ in range(most_rounds):
        one = open_.select(F.col("pa").alias("own"), F.col("pb").alias("other"), "best").unionByName(open_.select(F.col("pb").alias("own"), F.col("pa").alias("other"), "best")).where("own >= 0")
        best = scratch.save(one.groupBy("own").agg(F.min_by("other", "best").alias("other")))
        if best.isEmpty():
            break
        joined.append(scratch.save(components(best.select(F.col("own").alias("src"), F.col("other").alias("dst")), scratch)))
        now = lambda e, c: e.join(joined[-1].select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")  # noqa: B023, E731
        before, open_ = open_, scratch.save(_contracted(now(now(open_, "pa"), "pb").select("pa", "pb", "best.*").withColumn("w", -F.col("h"))))
        scratch.drop(before)
    else:
        raise RuntimeError(f"the watershed didn't settle in {most_rounds} rounds")
    final = None
    for step in reversed(joined):  # where each part went in the end: as many rows as parts, which at least halve from round to round
        if final is None:
            final = step
            continue
        over = step.select("node", F.col("component").alias("via")).join(final.select(F.col("node").alias("via"), "component"), "via", "left").select("node", F.coalesce("component", "via").alias("component"))
        final = scratch.save(over.unionByName(final.join(step.select("node"), "node", "left_anti")))
    if final is not None:
        part = part.join(final, F.col("part") == F.col("node"), "left").select("id", F.coalesce("component", "part").alias("part"))
    return nodes.join(part.where("part < 0"), "id").select(*DIMS, (-F.col("part")).alias("feature"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(pa, pb, best): of the edges between two parts only the best, if they may still join."""
    some = edges.where("pa <> pb AND (pa >= 0 OR pb >= 0)").select(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb"), F.struct((-F.col("w")).alias("h"), "src", "dst").alias("best"))
    return some.groupBy("pa", "pb").agg(F.min("best").alias("best"))


def _finished(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the pairs (a, b, d) taken in their order, each end once, in all connected parts of up to PART pairs; and the pairs of larger parts."""
    # a feature is a first end in one step's pairs and a second in another's: even and odd numbers
    found = components(pairs.select((F.col("a") * 2).alias("src"), (F.col("b") * 2 + 1).alias("dst")), scratch)
    named = scratch.save(pairs.join(found.where("node % 2 = 0").select(F.expr("node div 2").alias("a"), F.col("component").alias("part")), "a"))
    large = scratch.save(named.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("part"))

    def run(key, table):
        table = table.sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
        first, second, out = set(), set(), []
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            if a not in first and b not in second:
                first.add(a)
                second.add(b)
                out.append((a, b))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    small = named.join(large, "part", "left_anti").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "d", "part")
    return scratch.save(small.groupBy("part").applyInArrow(tidied(run), "a long, b long")), scratch.save(named.join(large, "part").select("a", "b", "d"))


def _cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / radius).cast("long")


def _around(df: DataFrame) -> DataFrame:
    """Each row once for its own cell and each of the eight around it."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    return df.withColumn("_p", near).withColumn("_q", near).withColumn("_cy", F.col("_cy") + F.col("_p")).withColumn("_cx", F.col("_cx") + F.col("_q")).drop("_p", "_q")


def _square(*pairs: tuple[str, str]) -> Column:
    return F.round(sum((F.pow(F.col(a) - F.col(b), 2) for a, b in pairs), F.lit(0.0)), 9)


def _candidates(features: DataFrame, radius: float) -> DataFrame:
    """(a, b, d): features of one step and the next whose places, the first moved by (vz, vy, vx), lie within the radius, and their squared distance."""
    moved = features.select((F.col("t") + 1).alias("t"), F.col("feature").alias("a"), *((F.col(f"{d}c") + F.col(f"v{d}")).alias(f"{d}a") for d in SPACE))
    a = _around(moved.withColumn("_cy", _cell("ya", radius)).withColumn("_cx", _cell("xa", radius)))
    b = features.select("t", F.col("feature").alias("b"), *(F.col(f"{d}c").alias(f"{d}b") for d in SPACE)).withColumn("_cy", _cell("yb", radius)).withColumn("_cx", _cell("xb", radius))
    return a.join(b, ["t", "_cy", "_cx"]).withColumn("d", _square(("za", "zb"), ("ya", "yb"), ("xa", "xb"))).where(F.col("d") <= radius * radius).select("a", "b", "d").distinct()


def _one_to_one(features: DataFrame, radius: float, scratch: Scratch, most_rounds: int) -> DataFrame:
    """(a, b): candidate pairs, nearest first, each feature once."""
    open_ = scratch.save(_candidates(features, radius))
    taken = open_.select("a", "b").where("false")
    while True:
        for _ in range(most_rounds):
            by = lambda k: F.row_number().over(Window.partitionBy(k).orderBy("d", "a", "b"))
            mutual = scratch.save(open_.withColumn("ra", by("a")).withColumn("rb", by("b")).where("ra = 1 AND rb = 1").select("a", "b"))
            if mutual.isEmpty():
                return taken
            taken = taken.unionByName(mutual)
            open_ = scratch.save(open_.join(mutual.select("a"), "a", "left_anti").join(mutual.select("b"), "b", "left_anti"))
        done, open_ = _finished(open_, scratch)
        taken, most_rounds = taken.unionByName(done), max(1, most_rounds)
        if open_.isEmpty():
            return taken


def _velocities(features: DataFrame, links: DataFrame, radius: float) -> DataFrame:
    """The features with (vz, vy, vx): the way from the one before, else that of the nearest feature of the same step within the radius that has one, else what they had."""
    old = features.select(F.col("feature").alias("a"), *(F.col(f"{d}c").alias(f"{d}a") for d in SPACE))
    own = links.join(old, "a").select(F.col("b").alias("feature"), *(f"{d}a" for d in SPACE))
    known = features.join(own, "feature").select("feature", "t", "yc", "xc", "zc", *((F.col(f"{d}c") - F.col(f"{d}a")).alias(f"n{d}") for d in SPACE))
    there = known.select("t", *(F.col(f"{d}c").alias(f"{d}o") for d in SPACE), F.col("feature").alias("other"), *(f"n{d}" for d in SPACE)).withColumn("_cy", _cell("yo", radius)).withColumn("_cx", _cell("xo", radius))
    asked = _around(features.withColumn("_cy", _cell("yc", radius)).withColumn("_cx", _cell("xc", radius)))
    met = asked.join(there, ["t", "_cy", "_cx"]).withColumn("_d", _square(("zc", "zo"), ("yc", "yo"), ("xc", "xo"))).where(F.col("_d") <= radius * radius)
    near = met.groupBy("feature").agg(F.min_by(F.struct(*(f"n{d}" for d in SPACE)), F.struct("_d", "other")).alias("n"))  # itself, if it has one, at distance 0
    return features.join(near, "feature", "left").select("feature", "t", *(f"{d}c" for d in SPACE), *(F.coalesce(F.col(f"n.n{d}"), F.col(f"v{d}")).alias(f"v{d}") for d in SPACE))


def link_features(features: DataFrame, radius: float, scratch: Scratch, drift: tuple[float, float] = (0.0, 0.0), min_steps: int = 1, most_rounds: int = 30, predict: int = 0, subnet: Subnet | None = None) -> DataFrame:
    """Features with `cell` and `time_cell`: nearest pairs of consecutive steps within the radius, one to one.

    With `subnet` the pairs are those of the least total distance, each subnet of candidates for itself and within a radius that adapts to its size
    (see assign.least_total()). Without, in the order of their distance:

    Places are moved by the drift (y, x a step) before they are compared; predict: so often, all are
    linked again with places moved by the velocities that the links before give them. Among all pairs the nearest
    is taken first (then the smaller numbers), as mutual nearest ones round by round. Pairs that are
    open after most_rounds (chains of ties settle one a round) are finished one by one in connected parts of up to PART pairs;
    larger parts go on by rounds. Cells are chains of pairs, numbered from 1 by their first feature; chains shorter than min_steps get 0.
    """
    placed = features.select("feature", "t", *(f"{d}c" for d in SPACE), F.lit(0.0).alias("vz"), F.lit(float(drift[0])).alias("vy"), F.lit(float(drift[1])).alias("vx"))

    def pairs(moved: DataFrame) -> DataFrame:
        if subnet is None:
            return _one_to_one(moved, radius, scratch, most_rounds)
        return least_total(_candidates(moved, radius), radius, scratch, subnet.most, subnet.step, subnet.stop)

    edges = pairs(placed)
    for _ in range(predict):
        edges = pairs(scratch.save(_velocities(placed, edges, radius)))
    found = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    out = scratch.save(features.join(found, F.col("feature") == F.col("node"), "left").withColumn("root", F.coalesce("component", "feature")).drop("node", "component"))
    steps = out.groupBy("root").agg(F.count("*").alias("steps"), F.min("t").alias("t0"))
    ranks = consecutive(steps.where(F.col("steps") >= min_steps), "root", scratch, "cell")
    return out.join(steps, "root").join(ranks, "root", "left").withColumn("cell", F.coalesce("cell", F.lit(0).cast("long"))).withColumn("time_cell", F.col("t") - F.col("t0")).drop("root", "steps", "t0")
