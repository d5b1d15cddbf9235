"""Gridded files as a Spark data source: reads that skip what filters exclude, and a sink that publishes whole files.

    register(spark)
    spark.read.format("gridded").option("variables", "w,label").load("/data/day.nc").where("t < 96 AND y >= 10")
    save_gridded(voxels, "/data/out", grid, steps=96)

The format is classic NetCDF (sources/netcdf.py).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import DoubleType, StructType

from ..model import DIMS, Grid
from ..ship import ship
from ..storage import file_at
from .netcdf import Classic, _open

#: Bytes of values that a partition reads, about; a step of the first dimension isn't split.
SLAB = 32 << 20
#: What stands for a missing number, fixed by the format; labels have 0, the background.
FILL = 9.969209968386869e36
_TEXT, _LONG, _DOUBLE, _UNSIGNED = 2, 10, 6, 11


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gridded)


class Gridded(DataSource):
    """Options: variables, by commas; path, or files, a list as JSON, whose steps are numbered on from file to file."""

    @classmethod
    def name(cls) -> str:
        return "gridded"

    def _files(self) -> list[str]:
        return json.loads(self.options["files"]) if "files" in self.options else [self.options["path"]]

    def _variables(self) -> list[str]:
        return [v.strip() for v in self.options["variables"].split(",")]

    def schema(self) -> str:
        file, names = _open(self._files()[0]), self._variables()
        dims = file.variables[names[0]].dims
        return ", ".join([*(f"`{d}` long" for d in dims), *(f"`{d}_at` double" for d in dims if d in file.variables), *(f"`{v}` double" for v in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Slabs(self._files(), self._variables(), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Files(self.options["path"], json.loads(self.options["sizes"]), int(self.options["steps"]), [(f.name, f.dataType == DoubleType()) for f in schema.fields if f.name not in DIMS], overwrite)


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    steps: tuple[int, int]


class Slabs(DataSourceReader):
    """Bounds of places and coordinates decide which steps become partitions, and which rows of the second dimension they read."""

    def __init__(self, files: list[str], variables: list[str], names: list[str]) -> None:
        self.files, self.variables, self.names = files, variables, names
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        known = [n for n in self.names if n not in self.variables]
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in known and isinstance(f.value, int | float):
                self.bounds.append((f.attribute[0], signs[type(f)], f.value))
            yield f  # Spark looks again, which changes nothing

    def _within(self, file: Classic, dim: str, first: int) -> np.ndarray:
        """Places along a dimension that no bound excludes."""
        n = file.dims[dim]
        keep, place = np.ones(n, bool), np.arange(n) + first
        for name, sign, value in self.bounds:
            if name in (dim, f"{dim}_at"):
                v = place if name == dim else file.values(dim)
                keep &= {"==": v == value, ">": v > value, ">=": v >= value, "<": v < value, "<=": v <= value}[sign]
        return np.flatnonzero(keep)

    def partitions(self) -> list[Slab]:
        out, first, dims = [], 0, None
        for path in self.files:
            file = _open(path)
            shape, dims = file.variables[self.variables[0]].shape, dims or file.variables[self.variables[0]].dims
            if unlike := [v for v in self.variables if file.variables[v].dims != dims]:
                raise ValueError(f"these don't have the dimensions {dims}: {sorted(unlike)}")
            rest = [self._within(file, d, 0) for d in dims[1:]]
            steps = self._within(file, dims[0], first)
            if len(steps) and all(map(len, rest)):
                each = max(1, SLAB // max(1, 8 * len(self.variables) * int(np.prod(shape[1:], dtype=np.int64))))
                breaks = np.flatnonzero(np.diff(steps) > 1) + 1
                for run in np.split(steps, breaks):
                    out += [Slab(path, first, (int(run[lo]), int(run[min(lo + each, len(run)) - 1]) + 1)) for lo in range(0, len(run), each)]
            first += shape[0]
        return out or [Slab(self.files[0], 0, (0, 0))]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        file = _open(partition.path)
        dims = file.variables[self.variables[0]].dims
        inner = [self._within(file, d, 0) for d in dims[1:]]
        rows = (int(inner[0][0]), int(inner[0][-1]) + 1) if inner and len(inner[0]) else None
        shape = [len(p) for p in inner]
        pick = np.ix_(inner[0] - rows[0], *inner[1:]) if rows else None
        grid = [g.ravel() for g in np.meshgrid(*inner, indexing="ij")]
        at = {d: file.values(d) for d in dims if f"{d}_at" in self.names}
        for k in range(*partition.steps):
            values = {}
            for v in self.variables:
                part = file.values(v, k, rows)
                values[v] = part.reshape(rows[1] - rows[0], *file.variables[v].shape[2:])[pick].ravel() if rows else part
            keep = np.flatnonzero(~np.logical_and.reduce([np.isnan(x) for x in values.values()]))
            places = dict(zip(dims, [np.full(len(keep), k), *(g[keep] for g in grid)], strict=True)) if shape or not inner else {}
            columns = {d: pa.array(p + (partition.first if d == dims[0] else 0), pa.int64()) for d, p in places.items()}
            columns |= {f"{d}_at": pa.array(at[d][places[d]], from_pandas=True) for d in at}
            columns |= {v: pa.array(x[keep], from_pandas=True) for v, x in values.items()}
            yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


# --- the sink -------------------------------------------------------------------------------------


def _text(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">q", len(raw)) + raw + bytes(-len(raw) % 4)


def header(dims: dict[str, int], steps: int, variables: list[tuple[str, bool]]) -> bytes:
    """The head of a file with an open first dimension, its numbers as variable `t`, and a variable of all dimensions for each name: numbers, or unsigned labels."""
    names = ["t", *dims]
    size = int(np.prod(list(dims.values()), dtype=np.int64))
    listed = struct.pack(">iq", 10, len(names)) + b"".join(_text(n) + struct.pack(">q", dims.get(n, 0)) for n in names)
    absent = struct.pack(">iq", 0, 0)
    found = [("t", 1, absent, _LONG, 8)]
    for name, number in variables:
        fill = struct.pack(">d", FILL) if number else struct.pack(">Q", 0)
        kind = _DOUBLE if number else _UNSIGNED
        found.append((name, len(names), struct.pack(">iq", 12, 1) + _text("_FillValue") + struct.pack(">iq", kind, 1) + fill, kind, 8 * size))

    def table(begin: int) -> bytes:
        out = struct.pack(">iq", 11, len(found))
        for name, n, attributes, kind, bytes_ in found:
            out += _text(name) + struct.pack(f">q{n}q", n, *range(n)) + attributes + struct.pack(">iqq", kind, bytes_, begin)
            begin += bytes_
        return out

    start = b"CDF\x05" + struct.pack(">q", steps) + listed + absent
    return start + table(len(start) + len(table(0)))


@dataclass
class Written(WriterCommitMessage):
    pieces: list[tuple[int, str]]


class Files(DataSourceArrowWriter):
    """A file for each block of `steps` steps. A task writes its blocks, whole, beside their place; the commit only renames, so a job that fails leaves no file."""

    def __init__(self, path: str, sizes: dict[str, int], steps: int, variables: list[tuple[str, bool]], overwrite: bool) -> None:
        self.path, self.sizes, self.steps, self.variables, self.overwrite = path.rstrip("/"), sizes, steps, variables, overwrite
        self.pieces = f"{self.path}/_pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        dims = {d: self.sizes[d] for d in DIMS if d != "t"}
        told, out, now, block = [], None, None, None
        system, folder = file_at(self.pieces)
        system.create_dir(folder)

        def blank() -> list[np.ndarray]:
            return [np.full(tuple(dims.values()), FILL if number else 0, ">f8" if number else ">u8") for _, number in self.variables]

        def end_step() -> None:
            out.write(struct.pack(">q", now))
            for v in values:
                out.write(v.tobytes())

        def fill(to: int) -> None:
            """Steps before `to` that have no rows."""
            nonlocal now, values
            while now < to:
                end_step()
                now, values = now + 1, blank()

        def end_block() -> None:
            fill(last)
            out.close()

        values = blank()
        for batch in iterator:
            t = batch.column(batch.schema.get_field_index("t")).to_numpy()
            places = tuple(batch.column(batch.schema.get_field_index(d)).to_numpy(zero_copy_only=False).astype(np.int64) for d in dims)
            for lo, hi in zip(*(lambda c: (np.append(0, c), np.append(c, len(t))))(np.flatnonzero(np.diff(t)) + 1), strict=True):
                if lo == hi:
                    continue
                step = int(t[lo])
                if step // self.steps != block:
                    if out is not None:
                        end_block()
                    block = step // self.steps
                    now, values = block * self.steps, blank()
                    last = min(now + self.steps, self.sizes["t"])
                    piece = f"{self.pieces}/{block:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(file_at(piece)[1])
                    out.write(header(dims, last - now, self.variables))
                    told.append((block, piece))
                fill(step)
                for v, (name, _) in zip(values, self.variables, strict=True):
                    column = batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)
                    some = column.is_valid().to_numpy(zero_copy_only=False)
                    v[tuple(p[lo:hi][some] for p in places)] = column.drop_null().to_numpy()
        if out is not None:
            end_block()
        return Written(told)

    def _gone(self) -> None:
        system, folder = file_at(self.pieces)
        system.create_dir(folder)
        system.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        system, folder = file_at(self.path)
        if self.overwrite:
            for f in system.get_file_info(FileSelector(folder, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            for block, piece in m.pieces if m else []:
                system.move(file_at(piece)[1], f"{folder}/{block:08d}.nc")
        system.open_output_stream(f"{folder}/_SUCCESS").close()
        self._gone()

    def abort(self, messages: list[Written | None]) -> None:
        self._gone()


def save_gridded(voxels: DataFrame, path: str, grid: Grid, steps: int = 1, columns: list[str] | None = None) -> None:
    """Writes voxels (t, z, y, x and values) as files of `steps` time steps each, in place of those there.

    Doubles and floats stay numbers, integers become unsigned labels (ValueError in a task for a negative one would need a sign: give such columns as doubles).
    Null values, and places without a row, are missing (labels: 0). Of voxels that repeat the greatest values stay; rows without a place are left out.
    Rows are dealt by blocks and sorted there, so a task holds one step of the grid at a time. No rows: no file.
    """
    register(voxels.sparkSession)
    names = columns or [c for c in voxels.columns if c not in DIMS]
    kinds = dict(voxels.dtypes)
    cast = {c: F.col(c).cast("double" if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else "long").alias(c) for c in names}
    rows = voxels.select(*(F.col(d).cast("long").alias(d) for d in DIMS), *cast.values()).dropna(subset=list(DIMS))
    rows = rows.repartition(F.expr(f"t div {steps}")).sortWithinPartitions(*DIMS, *names)
    rows.write.format("gridded").mode("overwrite").option("sizes", json.dumps({d: grid.size(d) for d in DIMS})).option("steps", steps).save(path)


def read_gridded(spark: SparkSession, folder: str, variables: list[str]) -> DataFrame:
    """The files of a folder that save_gridded() wrote, in the order of their steps; `t_at` is the step's number."""
    from pyarrow.fs import FileSelector

    register(spark)
    system, at = file_at(folder)
    scheme = "file://" if folder.startswith(("file:", "/")) else folder.split("://")[0] + "://"
    files = sorted(scheme + f.path for f in system.get_file_info(FileSelector(at)) if f.path.endswith(".nc"))
    return spark.read.format("gridded").option("variables", ",".join(variables)).option("files", json.dumps(files)).load()
