"""Turns the star-schema tables into voxels, columns of levels, and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_SECONDS, FIRST_STEP = 43200, 39446
TYPES = ("view", "click", "signup", "purchase", "error")
MASKS = {"cloud": "value >= 5", "ice": "value >= 5 AND value < 110", "updraft": "value >= 35", "all": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str, mask: str = "cloud", coarse: int = 1) -> DataFrame:
    """t, z, y, x, vmax, n of events: 12-hour steps (or `coarse` of them) by type and user."""
    z = F.coalesce(*(F.when(F.col("event_type") == name, F.lit(i)) for i, name in enumerate(TYPES)))
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (STEP_SECONDS * 1_000_000)) - FIRST_STEP
    e = table(spark, sf_dir, "events").where(MASKS[mask])
    e = e.select(F.floor(step / coarse).cast("int").alias("t"), z.cast("int").alias("z"), F.expr("CAST(user_id DIV 15 AS INT)").alias("y"), F.expr("CAST(user_id % 15 AS INT)").alias("x"), "value")
    return e.groupBy("t", "z", "y", "x").agg(F.max("value").alias("vmax"), F.count("*").alias("n"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one to seven levels of physical fields, from order lines."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("lev")).agg(
        F.max("l_quantity").alias("a"), (F.max("l_discount") + 0.0).alias("b"), (F.max("l_tax") + 0.0).alias("c"), F.max("l_extendedprice").alias("d")
    )
    lev = F.col("lev").cast("double")
    num = lambda x: F.lit(float(x))
    return a.select(
        "col", "lev",
        (num(1500) * (lev - 1) + 100).alias("zg"), (num(100000) - 12000 * (lev - 1)).alias("pfull"), (num(300) - 9 * (lev - 1) + (F.col("a") - 25) / num(10)).alias("ta"),
        (num(0.002) + F.col("b") / num(20)).alias("hus"), (F.col("c") / num(1000)).alias("cli"), (F.col("b") / num(1000)).alias("clw"), (num(0.0001) * lev).alias("qg"), (num(0.00005) * lev).alias("qr"), (num(0.00002) * lev).alias("qs"),
        (F.col("a") - num(25)).alias("ua"), (F.col("d") / num(4000) - 12).alias("va"), (F.col("a") / num(10) - 1).alias("wa_phy"), num(1500).alias("dzghalf"),
        (((F.col("col") * 37) % 3600).cast("double") / num(10) - 180).alias("lon"), (((F.col("col") * 17) % 300).cast("double") / num(10) - 15).alias("lat"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updrafts of systems, from orders: dcc, updraft, time, lon, lat, npix."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("dcc"), (F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("updraft"), F.col("o_orderdate").alias("time"),
        (((F.col("o_orderkey") * 37) % 3600).cast("double") / F.lit(10.0) - 180).alias("lon"), (((F.col("o_orderkey") * 17) % 300).cast("double") / F.lit(10.0) - 15).alias("lat"),
        F.floor("o_totalprice").cast("long").alias("price"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("npix"), F.col("o_orderkey").alias("row"),
    )


def grid_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of columns() on a grid: 60 steps, rows of 15 columns half a degree apart, up to seven levels; with rain."""
    k = F.expr("col DIV 60")
    place = columns(spark, sf_dir).withColumn("t", (F.col("col") % 60).cast("int")).withColumn("z", (F.col("lev") - 1).cast("int")).withColumn("y", F.expr("CAST((col DIV 60) DIV 15 AS INT)")).withColumn("x", (k % 15).cast("int"))
    return place.withColumn("lon", F.col("x") * F.lit(0.5)).withColumn("lat", F.col("y") * F.lit(0.5)).withColumn("pr", F.col("cli") * F.lit(100.0))


def grid_mask(spark: SparkSession, sf_dir: str, field: DataFrame | None = None) -> DataFrame:
    """t, z, y, x, system, u_tracks: cloudy voxels of grid_field() in blocks of three by three columns, in two layers; rising ones, from a step on, in tracks of ten steps. field: that of grid_field(), where it is at hand."""
    f = (grid_field(spark, sf_dir) if field is None else field).where("clw >= 0.00002 AND (z > 3 OR (z IN (1, 2) AND wa_phy > 1.55) OR wa_phy > 3.45)")
    block = F.expr("CAST(1 + (y DIV 3) * 5 + x DIV 3 AS BIGINT)")
    return f.select("t", "z", "y", "x", block.alias("system"), F.when((F.col("wa_phy") > 1) & (F.col("t") >= 2 + block % 7), block * 10 + F.expr("t DIV 10")).alias("u_tracks"))
