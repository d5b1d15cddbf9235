"""Connected components and dense numbers over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship, tidied
from ..storage import Scratch, shuffled

#: Edges (after local contraction) up to which one task joins them; beyond it, star rounds do.
ONE_TASK = 1 << 20
_SCHEMA = "u long, v long"


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not ((jump := new[new]) == new).all():
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches):
    """Of a partition's edges, only one from each node to the smallest node it reaches there."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, low = union(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        own = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(low[own])], names=["u", "v"])


def _whole(key, table):
    nodes, low = union(table["u"].to_numpy(), table["v"].to_numpy())
    return pa.table([pa.array(nodes), pa.array(low)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (src, dst) reaches, itself included.

    Nodes without edges to others don't appear. Partitions first replace their edges by a forest.
    A count of what is left then decides: up to `one_task` edges are joined by one task, more by
    alternating large-star and small-star rounds, each written, whose minima are aggregated before
    they are shuffled. Both give the same result.
    """
    ship(edges.sparkSession)
    plain = edges.where("src <> dst").select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    now = scratch.save(plain.mapInArrow(tidied(_forest), _SCHEMA).distinct())
    if now.count() <= one_task:
        found = now.groupBy(F.lit(0).alias("all")).applyInArrow(tidied(_whole), _SCHEMA)
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node go to the lowest in reach
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the lowest of them
        low = lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def consecutive(values: DataFrame, column: str, scratch: Scratch, to: str = "rank") -> DataFrame:
    """(column, to): the different non-null values, numbered from 1 in ascending order.

    Values are dealt into ranges; a range's numbers begin behind those of the ranges before it, so
    no task sorts them all.
    """
    spread = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    spread = shuffled(scratch.save(spread))
    per = spread.groupBy("_range").count()
    before = per.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return spread.withColumn("_n", inside).join(F.broadcast(before), "_range").select(column, (F.col("_n") + F.col("_before")).cast("long").alias(to))
