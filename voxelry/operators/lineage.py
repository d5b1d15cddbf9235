"""Records of updrafts and systems through relabelling, system catalogues and lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_records(updrafts: DataFrame, clouds: DataFrame, updraft_map: DataFrame, cloud_map: DataFrame) -> DataFrame:
    """Updraft and cloud rows under their system (unmapped: 0), one below the other; cloud rows have updraft 0."""
    to = lambda df, key, m: df.join(m.select(F.col("old").alias(key), F.col("new").alias("system")), key, "left").withColumn("system", F.coalesce("system", F.lit(0).cast("long")))
    return to(updrafts, "updraft", updraft_map).unionByName(to(clouds, "cloud", cloud_map), allowMissingColumns=True).na.fill(0, ["updraft", "cloud"])


def compose_links(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(old, new): labels through both maps; where the second has no entry, the first's result."""
    return primary.join(secondary.select(F.col("old").alias("_via"), F.col("new").alias("_new")), F.col("new") == F.col("_via"), "left").select("old", F.coalesce("_new", "new").alias("new"))


def apply_linking(records: DataFrame, links: DataFrame, column: str = "system") -> DataFrame:
    """Records whose column is shifted behind the smallest linked label and then mapped; unmapped: 0."""
    shift = (links.where("old > 0").agg(F.min("old")).first()[0] or 1) - 1  # one number
    moved = records.withColumn(column, F.col(column) + shift)
    return moved.join(links.select(F.col("old").alias(column), F.col("new").alias("linked")), column, "left").withColumn("linked", F.coalesce("linked", F.lit(0).cast("long")))


def storm_centres(records: DataFrame, minutes: int = 15) -> DataFrame:
    """dcc, updraft, lon, lat and time of each system's first updraft, `minutes` before its first row.

    First is the earliest start; of equal ones the one with most rows, then the smallest id; its
    first row is the earliest, then the smallest `row`.
    """
    per = records.groupBy("dcc", "updraft").agg(F.min("time").alias("start"), F.count("*").alias("rows"), F.min_by(F.struct("lon", "lat", "time"), F.struct("time", "row")).alias("at"))
    best = per.groupBy("dcc").agg(F.min_by(F.struct("updraft", "at"), F.struct("start", (-F.col("rows")).alias("r"), "updraft")).alias("b"))
    return best.select("dcc", "b.updraft", "b.at.lon", "b.at.lat", (F.col("b.at.time") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("time"))


def catalogue(records: DataFrame, step_hours: float = 0.25) -> DataFrame:
    """One row a system: its start, lifetime in hours (last minus first, and a step), cores, pixels and updrafts' duration."""
    hours = (F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / 3.6e9
    return records.groupBy("dcc").agg(F.min("time").alias("initial_time"), (hours + step_hours).alias("lifetime"), F.countDistinct("updraft").alias("ncores"), F.max("npix").alias("npixels"), F.min_by("lon", F.struct("time", "row")).alias("initial_lon"), F.min_by("lat", F.struct("time", "row")).alias("initial_lat"), F.count("*").alias("rows"))


def select_systems(cat: DataFrame, validity: str, max_lifetime: float, max_pixels: int, start: str, max_cores: int | None = None) -> DataFrame:
    """Catalogue rows by validity flag ("invalid" means not invalid), lifetime, size, start and cores."""
    flag = ~F.col("invalid") if validity == "invalid" else F.col(validity)
    out = cat.where(flag & (F.col("lifetime") < max_lifetime) & (F.col("npixels") < max_pixels) & (F.col("initial_time") > F.lit(start).cast("timestamp_ntz")))
    return out if max_cores is None else out.where(F.col("ncores") < max_cores)


def remaining(ids: DataFrame, done: DataFrame, key: str, start: int = 0) -> DataFrame:
    """Different ids not done yet, from place `start` on in ascending order."""
    from ..sources.readers import batch_of

    return batch_of(ids.join(done, key, "left_anti"), key, start)


def lifetime_normalised(df: DataFrame, key: str, order: list[str], value: str, bins: int = 20) -> DataFrame:
    """key, bin (0..bins) and the value at that share of the object's existing times, linearly between; null for a single time."""
    w = Window.partitionBy(key).orderBy(*order)
    n, i, k = F.col("_n"), F.col("_i"), F.col("bin")
    rows = df.withColumn("_i", F.row_number().over(w).cast("long") - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("_next", F.lead(value).over(w))
    ceil = lambda a, b: F.expr(f"({a} + {b} - 1) DIV ({b})")
    low = F.when(n == 1, F.lit(0)).otherwise(ceil(f"({bins} * _i)", "greatest(_n - 1, 1)"))
    high = F.when(n == 1, F.lit(bins)).when(i == n - 1, F.lit(bins)).otherwise(ceil(f"({bins} * (_i + 1))", "greatest(_n - 1, 1)") - 1)
    out = rows.withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("bin", F.explode(F.sequence("_low", "_high")))
    part = k.cast("double") * (n - 1) / F.lit(float(bins)) - i
    v = F.when(n == 1, F.lit(None).cast("double")).when(F.col("_next").isNull(), F.col(value).cast("double")).otherwise(F.col(value) + part * (F.col("_next") - F.col(value)))
    return out.select(key, k.cast("int").alias("bin"), v.alias("value"))


def anvil_filter(system_time: DataFrame, min_hours: float, core_first: bool = True) -> DataFrame:
    """system, lifetime (hours), abh and keep, of rows (system, t, abh, cth, core): longer than min_hours, and cored before the anvil."""
    seen = F.col("abh").isNotNull()
    per = system_time.groupBy("system").agg(F.min(F.when(seen, F.col("t"))).alias("t0"), F.max(F.when(seen, F.col("t"))).alias("t1"), F.avg("abh").alias("mean_abh"))
    joined = system_time.join(per, "system")
    starts = joined.groupBy("system").agg(
        F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.first("mean_abh").alias("mean_abh"),
        F.min(F.when(F.col("cth") <= F.col("mean_abh"), F.col("t"))).alias("anvil_start"), F.min(F.when(F.col("core"), F.col("t"))).alias("core_start"),
    )
    hours = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9
    keep = F.coalesce(hours > min_hours, F.lit(False))
    if core_first:
        keep = keep & F.coalesce(F.col("core_start") <= F.col("anvil_start"), F.lit(False))
    return starts.select("system", hours.alias("lifetime"), F.col("mean_abh").alias("abh"), keep.alias("keep"))
