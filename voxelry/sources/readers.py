"""Sources, sinks, file selection and resumable stages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grids import coarsen, region_box, region_cells, regrid
from ..functions.physics import frozen
from ..operators.graph import consecutive
from ..storage import Scratch, file_at


@dataclass
class Model:
    """How one model's tables are read: names that differ, and the subdivisions of its HEALPix cells if it has no grid."""

    reader: Callable[[SparkSession], DataFrame]
    rename: dict[str, str] = field(default_factory=dict)
    zoom: int | None = None
    step: float = 0.1


@dataclass
class Sources:
    """Named tables: a name stands for a reader, with columns, a time range and a box pushed into the scan."""

    spark: SparkSession
    models: dict[str, Model] = field(default_factory=dict)

    def register(self, name: str, reader: Callable[[SparkSession], DataFrame] | str, rename: dict[str, str] | None = None, zoom: int | None = None, step: float = 0.1) -> None:
        """A reader, or the path of a Parquet table; rename: its names to ours; zoom: of the HEALPix cells (column `cell`) that it has, to be read on a grid of `step` degrees."""
        self.models[name] = Model((lambda s, p=reader: s.read.parquet(p)) if isinstance(reader, str) else reader, rename or {}, zoom, step)

    def catalogue(self, path: str) -> list[str]:
        """Registers all tables of a YAML file, name: {path, format, options, rename, zoom, step}; their names."""
        import yaml

        system, name = file_at(path)
        with system.open_input_file(name) as f:
            tree = yaml.safe_load(f.read())
        for key, how in tree.items():
            if wrong := set(how) - {"path", "format", "options", "rename", "zoom", "step"}:
                raise ValueError(f"unknown settings of {key}: {sorted(wrong)}")
            read = lambda s, h=how: s.read.format(h.get("format", "parquet")).options(**h.get("options", {})).load(h["path"])
            self.register(key, read, how.get("rename"), how.get("zoom"), how.get("step", 0.1))
        return sorted(tree)

    def load(self, name: str, variables: list[str] | None = None, start=None, end=None, region=None, time: str = "time") -> DataFrame:
        """Rows from start to before end (both optional) inside a region: its name, or (lonmin, lonmax, latmin, latmax)."""
        if name not in self.models:
            raise KeyError(f"unknown source {name!r}")
        model = self.models[name]
        df = model.reader(self.spark).withColumnsRenamed(model.rename)
        if start is not None:
            df = df.where(F.col(time) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(time) < F.lit(end))
        if model.zoom is not None:
            df = df.drop("lon", "lat") if region is None else region_cells(df.drop("lon", "lat"), region, model.zoom, model.step)
            df = regrid(df, region if region is not None else "global", model.zoom, model.step)
            df = df.withColumnsRenamed({"iy": "y", "ix": "x"})
        elif region is not None:
            df = inside(df, region_box(region))
        return with_derived(df, variables) if variables else df


def with_derived(df: DataFrame, variables: list[str]) -> DataFrame:
    """Columns by name, with cl (cloud water and ice) and qfrozen where asked for."""
    if "cl" in variables and "cl" not in df.columns:
        df = df.withColumn("cl", F.col("cli") + F.col("clw"))
    if "qfrozen" in variables and "qfrozen" not in df.columns:
        df = df.withColumn("qfrozen", frozen(F.col("qall"), F.col("ta")))
    keys = [c for c in ("t", "z", "y", "x", "time", "lat", "lon") if c in df.columns]
    return df.select(*keys, *[v for v in variables if v not in keys])


#: Named projections of a field: whether levels are kept, block size, every n-th step.
VERSIONS = {
    "2d_olr": ("olr", 1, 1), "3d_5xy_15min": ("3d", 1, 1), "2d_5xy_15min": ("2d", 1, 1), "2d_5xy_30min": ("2d", 1, 2), "2d_5xy_60min": ("2d", 1, 4),
    "2d_10xy_15min": ("2d", 2, 1), "2d_10xy_30min": ("2d", 2, 2), "2d_10xy_60min": ("2d", 2, 4),
}


def projection(df: DataFrame, version: str) -> DataFrame:
    """One of VERSIONS: iwp and wmax per pixel (2d), the frozen condensate and wind per voxel (3d), or olr."""
    kind, block, every = VERSIONS[version]
    df = df.where(F.col("t") % every == 0)
    if kind == "olr":
        return df.select("t", "y", "x", "olr")
    q = frozen(F.col("qall"), F.col("ta"))
    if kind == "3d":
        return df.select("t", "z", "y", "x", q.alias("qfrozen"), "wa")
    if block > 1:  # the fields first, then what is derived of them
        df = coarsen(df.withColumn("qfrozen", F.coalesce(q, F.lit(0.0))), ("t", "z"), ["qfrozen", "rho", "dzghalf", "wa"], block)
        q = F.col("qfrozen")
    return df.groupBy("t", "y", "x").agg(F.coalesce(F.sum(q * F.col("rho") * F.col("dzghalf")), F.lit(0.0)).alias("iwp"), F.max("wa").alias("wmax"))


def box(mask: DataFrame, margin: float = 0.1, before_minutes: int = 0) -> DataFrame:
    """One row: the times and the region of a mask, widened by margin and a look back."""
    return mask.agg((F.min("time") - F.expr(f"INTERVAL {before_minutes} MINUTES")).alias("t0"), F.max("time").alias("t1"), (F.min("lon") - margin).alias("x0"), (F.max("lon") + margin).alias("x1"), (F.min("lat") - margin).alias("y0"), (F.max("lat") + margin).alias("y1"))


def corresponding(field_: DataFrame, mask: DataFrame, margin: float = 0.1, before_minutes: int = 0) -> DataFrame:
    """Field rows inside a mask's box. The box, one row, is fetched, so that its bounds are constants that the scan prunes by."""
    b = box(mask, margin, before_minutes).first()
    return field_.limit(0) if b.t0 is None else inside(field_, (b.x0, b.x1, b.y0, b.y1), b.t0, b.t1)


def inside(df: DataFrame, region: tuple[float, float, float, float], start=None, end=None, time: str = "time") -> DataFrame:
    """Rows inside a region (lonmin, lonmax, latmin, latmax) and from start to end, ends included."""
    out = df.where(F.col("lon").between(*region[:2]) & F.col("lat").between(*region[2:]))
    out = out if start is None else out.where(F.col(time) >= F.lit(start))
    return out if end is None else out.where(F.col(time) <= F.lit(end))


def grab_system(mask: DataFrame, catalogue: DataFrame, system: int, degrees: float = 10.0, hours: float = 1.0) -> DataFrame:
    """One system's voxels, looked for near its first place and until an hour after its end; if there are none, in the whole mask.

    catalogue: dcc, initial_time, lifetime (hours), initial_lat, initial_lon. The scan is pruned by time and box.
    """
    own = mask.where(F.col("system") == system)
    at = catalogue.where(F.col("dcc") == system).first()
    if at is None:
        return own
    lon, lat = at.initial_lon, at.initial_lat
    near = inside(own, (lon - degrees, lon + degrees, lat - degrees, lat + degrees), at.initial_time, at.initial_time + timedelta(hours=at.lifetime + hours))
    return near if near.head(1) else own


def with_height(df: DataFrame, heights: list[float], z: str = "z") -> DataFrame:
    """The table with `height` of its level, from a list of heights by level; levels beyond the list are left out."""
    levels = df.sparkSession.createDataFrame(list(enumerate(map(float, heights))), f"`{z}` int, height double")
    return df.join(F.broadcast(levels), z)  # a row a level


def level_slice(df: DataFrame, low: int, high: int, z: str = "z") -> DataFrame:
    """Rows from level low to level high, both included."""
    return df.where(F.col(z).between(low, high))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def repeated(df: DataFrame, column: str = "label") -> DataFrame:
    """Values that occur more than once, and how often."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def file_contains(name: str, start: str, end: str) -> bool:
    """Whether a file named by two times holds some of the times from start to end (%Y%m%dT%H%M, both included)."""
    return any(a <= end and start <= b for _, a, b in file_spans([name]))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of CSV files with a header line; columns are found by name, and a row that doesn't fit the schema raises."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Records as CSV files with a header line, in place of earlier ones or added to them."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def save_mask(df: DataFrame, path: str, labels: tuple[str, ...] = ("label",)) -> None:
    """A mask as compressed Parquet, in place of an earlier one once it is whole: labels are integers, and missing or zero ones are background, which has no rows."""
    some = [F.col(c).isNotNull() & (F.col(c) > 0) for c in labels]
    whole = df.where(reduce(lambda a, b: a | b, some))
    whole.select(*(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) if c in labels else F.col(c) for c in df.columns)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def day_records(spark: SparkSession, root: str, days: list[str]) -> DataFrame:
    """The records of some days, one below the other: Parquet folders root/<day>; a column that a day hasn't is null there."""
    parts = [spark.read.parquet(f"{root.rstrip('/')}/{d}").withColumn("day", F.lit(d)) for d in days]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collect_parts(parts: DataFrame, part: str = "part", label: str = "label") -> DataFrame:
    """Labels of parts made unique: each part's are moved behind the greatest ones of the parts before it."""
    top = parts.groupBy(part).agg(F.max(label).alias("_top"))  # a row a part
    before = top.select(part, F.coalesce(F.sum("_top").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return parts.join(F.broadcast(before), part).withColumn(label, F.col(label) + F.col("_shift")).drop("_shift")


def file_spans(names: list[str]) -> list[tuple[str, str, str]]:
    """(name, start, end) of files named by two times %Y%m%dT%H%M; others are left out."""
    found = [(n, re.findall(r"\d{8}T\d{4}", n)) for n in names]
    return [(n, d[0], d[1]) for n, d in found if len(d) >= 2]


def version_path(root: str, version: str, region: str, start) -> str:
    """Where a run's results belong: root/version/region/yyyymmdd."""
    return "/".join([root.rstrip("/"), version, region, start.strftime("%Y%m%d")])


def chained(names: list[str]) -> list[str]:
    """Files in order, each starting where the one before ends; ValueError if they don't chain."""
    spans = sorted(file_spans(names), key=lambda s: s[1])
    for a, b in zip(spans, spans[1:], strict=False):
        if a[2] != b[1]:
            raise ValueError(f"{b[0]} doesn't start where {a[0]} ends")
    return [s[0] for s in spans]


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Half-open spans meet."""
    return (start < to) & (from_ < end)


def load_results(df: DataFrame, systems: list[int] | None = None, ignore: list[int] | None = None, batch: int = 0, size: int | None = None, apply: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Results by system: a list of ids, without some, a batch of `size` in order of id, and a callback."""
    ids = df.select("system").distinct()
    if systems is not None:
        ids = ids.where(F.col("system").isin(list(systems)))
    if ignore:
        ids = ids.where(~F.col("system").isin(list(ignore)))
    if size is not None:
        ids = batch_of(ids, "system", batch * size, size)
    out = df.join(ids, "system", "left_semi")
    return out.transform(apply) if apply else out


def batch_of(ids: DataFrame, key: str, start: int, size: int | None = None) -> DataFrame:
    """Different ids from place `start` on (counted from 0 in ascending order), `size` of them at most.

    Ids are numbered range by range, so that no task sorts or skips them all.
    """
    places = consecutive(ids, key, Scratch(ids.sparkSession), "_place").where(F.col("_place") > start)
    return (places if size is None else places.where(F.col("_place") <= start + size)).select(key)


def timedelta_seconds(text: Column) -> Column:
    """Seconds of "N days HH:MM:SS" (days optional)."""
    part = lambda p, i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, p, i), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    clock = r"(\d+):(\d+):(\d+)"
    return part(r"(\d+) days?", 1) * 86400 + part(clock, 1) * 3600 + part(clock, 2) * 60 + part(clock, 3)


def name_time(text: Column) -> Column:
    return F.to_timestamp_ntz(F.regexp_extract(text, r"(\d{8}T\d{4})", 1), F.lit("yyyyMMdd'T'HHmm"))


class Checkpoints:
    """Named stages in one folder: a stage whose table is complete isn't computed again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def reached(self, name: str) -> bool:
        at, fs = self._path(name + "/_SUCCESS")
        return fs.exists(at)

    def get(self, name: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        if not self.reached(name):
            writer = make().write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def names(self) -> list[str]:
        at, fs = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def last(self, pattern: str) -> int | None:
        """The greatest number that the pattern's group takes in stage names."""
        found = [int(m[1]) for n in self.names() if (m := re.fullmatch(pattern, n))]
        return max(found, default=None)

    def remove_old(self, keep: list[str]) -> None:
        for n in self.names():
            if n not in keep:
                at, fs = self._path(n)
                fs.delete(at, True)
