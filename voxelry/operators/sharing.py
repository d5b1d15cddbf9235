"""Labels shared between object classes, merged into systems, and linked over chunk borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DIMS, Grid
from ..storage import Scratch, shuffled
from .graph import components, consecutive
from .labelling import neighbours


def _meet(current: DataFrame, update: DataFrame) -> DataFrame:
    return current.select(*DIMS, F.col("label").alias("cur")).join(update.select(*DIMS, F.col("label").alias("upd")), list(DIMS)).select("t", "cur", "upd")


def per_time(current: DataFrame, update: DataFrame) -> DataFrame:
    """(t, label, shared): the smallest update label under each current label at each time; 0 without one."""
    least = _meet(current, update).groupBy("t", "cur").agg(F.min("upd").alias("m"))
    return current.select("t", F.col("label").alias("cur")).distinct().join(least, ["t", "cur"], "left").select("t", F.col("cur").alias("label"), F.coalesce("m", F.lit(0).cast("long")).alias("shared"))


def _smallest(shared: DataFrame) -> DataFrame:
    return shared.groupBy(F.col("label").alias("old")).agg(F.coalesce(F.min(F.when(F.col("shared") > 0, F.col("shared"))), F.lit(0).cast("long")).alias("new"))


def share_map(current: DataFrame, update: DataFrame) -> DataFrame:
    """(old, new): the smallest update label each current label ever meets; 0 without one."""
    return _smallest(per_time(current, update))


def extra_map(current: DataFrame, update: DataFrame, scratch: Scratch) -> DataFrame:
    """(old, new): each update label that is some time's smallest, to the smallest map of the current labels it serves."""
    shared = scratch.save(per_time(current, update))  # the voxels are joined once
    served = _smallest(shared).select(F.col("old").alias("label"), "new")
    return shared.where("shared > 0").join(served, "label").groupBy(F.col("shared").alias("old")).agg(F.min("new").alias("new"))


def share_labels(current: DataFrame, update: DataFrame) -> DataFrame:
    """The current mask under its shared labels; what meets none drops out."""
    m = share_map(current, update).where("new > 0").withColumnRenamed("old", "label")
    return current.select(*DIMS, "label").join(m, "label").select(*DIMS, F.col("new").alias("label"))


def _bridges(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Of links (cur, upd) between labels of `a` and `b`: node (even ones labels of a, odd ones of b) and `new`, the smallest label of a that it reaches."""
    found = shuffled(scratch.save(components(links.select((F.col("cur") * 2).alias("src"), (F.col("upd") * 2 + 1).alias("dst")), scratch)))
    name = found.where("node % 2 = 0").groupBy("component").agg(F.expr("min(node) DIV 2").alias("new"))
    return found.join(name, "component").select("node", "new")


def bridged(a: DataFrame, b: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Maps (old, new) of both classes' labels to the smallest label of `a` that overlaps lead to.

    Labels of `a` that one label of `b` bridges get one number; labels of `a` alone keep theirs;
    labels of `b` that meet none map to nothing.
    """
    named = _bridges(_meet(a, b).select("cur", "upd").distinct(), scratch)
    map_a = a.select(F.col("label").alias("old")).distinct().join(named.where("node % 2 = 0").select(F.expr("node DIV 2").alias("old"), "new"), "old", "left").select("old", F.coalesce("new", "old").alias("new"))
    map_b = named.where("node % 2 = 1").select(F.expr("node DIV 2").alias("old"), "new")
    return map_a, map_b


def multivariate_systems(a: DataFrame, b: DataFrame, scratch: Scratch, b_column: str = "u_tracks") -> DataFrame:
    """t, z, y, x, system and b's label: both classes merged where they overlap, numbered from 1.

    The masks hold a voxel once, so they meet once, in a written table of voxels with the labels that either class has there. What is found of labels comes
    back to labels alone, as a table of the different pairs with their systems, and to the voxels in one join.
    """
    sides = [m.select(*DIMS, F.col("label").alias(n)) for m, n in ((a, "cur"), (b, "upd"))]
    both = shuffled(scratch.save(sides[0].join(sides[1], list(DIMS), "full")))
    pairs = shuffled(scratch.save(both.select("cur", "upd").distinct()))
    named = shuffled(scratch.save(_bridges(pairs.where("cur IS NOT NULL AND upd IS NOT NULL"), scratch)))
    in_a, in_b = (named.where(f"node % 2 = {k}").select(F.expr("node DIV 2").alias(side), F.col("new").alias(f"_{side}")) for k, side in enumerate(("cur", "upd")))
    # of labels that meet, both map to one number; those of a alone keep theirs, those of b alone have none
    moved = pairs.join(in_a, "cur", "left").join(in_b, "upd", "left").select("cur", "upd", F.when(F.col("cur").isNotNull(), F.coalesce("_cur", "cur")).otherwise(F.col("_upd")).alias("label"))
    moved = shuffled(scratch.save(moved.where("label IS NOT NULL")))
    numbered = moved.join(consecutive(moved, "label", scratch, "system"), "label").select(F.col("cur").alias("_cur"), F.col("upd").alias("_upd"), "system")
    met = both.join(numbered, F.col("cur").eqNullSafe(F.col("_cur")) & F.col("upd").eqNullSafe(F.col("_upd")))
    return met.select(*DIMS, "system", F.col("upd").alias(b_column))


def boundary_links(first: DataFrame, second: DataFrame, t_first: int, t_second: int, grid: Grid) -> DataFrame:
    """(a, b): labels of two chunks whose voxels touch over the border between two time steps."""
    last = first.where(F.col("t") == t_first).select("z", "y", "x", F.col("label").alias("a"))
    head = second.where(F.col("t") == t_second).select("z", "y", "x", F.col("label").alias("b"))
    return last.join(head, ["z", "y", "x"]).select("a", "b").distinct()


def link_chunks(chunks: list[DataFrame], borders: list[int], grid: Grid, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All chunks' voxels under labels that run on over the borders, and the map (chunk, old, new).

    Labels of later chunks are shifted behind those of earlier ones, labels that touch across a
    border (time step borders[i] - 1 and borders[i]) are joined, and each group takes its smallest;
    then numbers run from 1. Labels that touch nothing keep a number of their own.
    """
    chunks = [shuffled(scratch.save(c.select(*DIMS, "label"))) for c in chunks]  # read several times
    shifted, shift = [], 0
    for c in chunks:
        shifted.append(c.select(*DIMS, (F.col("label") + shift).alias("label"), F.lit(len(shifted)).alias("chunk"), F.col("label").alias("old")))
        shift += c.agg(F.max("label")).first()[0] or 0
    links = None
    for i, border in enumerate(borders):
        pair = boundary_links(shifted[i], shifted[i + 1], border - 1, border, grid)
        links = pair if links is None else links.unionByName(pair)
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    every = shifted[0]
    for s in shifted[1:]:
        every = every.unionByName(s)
    joined = shuffled(scratch.save(every.join(shuffled(found), F.col("label") == F.col("node"), "left").withColumn("root", F.coalesce("component", "label")).drop("node", "component")))
    ranks = consecutive(joined, "root", scratch, "new")
    out = joined.join(ranks, "root")
    return out.select(*DIMS, F.col("new").alias("label")), out.select("chunk", "old", "new").distinct()


__all__ = ["bridged", "boundary_links", "extra_map", "link_chunks", "multivariate_systems", "neighbours", "per_time", "share_labels", "share_map"]
