"""Gridded files in the classic NetCDF formats (versions 1, 2 and 5) as rows, a file a task.

Only the header is read to plan; a task then reads a variable's values step by step along its first
dimension. Files in the HDF5-based format are to be converted first (`nccopy -k cdf5`).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship, tidied
from ..storage import file_at

#: External types by number, fixed by the format; all big-endian.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    step: int  # bytes from one step of the first dimension to the next
    attributes: dict = field(default_factory=dict)


class Classic:
    """A file's header, and its values by place."""

    def __init__(self, read, size: int) -> None:
        self.read, self.size, self.at, self.buffer = read, size, 0, b""
        magic = self._take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a file of the classic NetCDF formats")
        self.wide = magic[3] == 5
        self.long_offsets = magic[3] >= 2
        records = self._number()
        dims = self._list(_DIMENSIONS, lambda: (self._name(), self._number()))
        self.attributes = self._attributes()
        self.dims = {name: n or records for name, n in dims}
        unlimited = {name for name, n in dims if not n}
        names = [name for name, _ in dims]
        raw = self._list(_VARIABLES, lambda: self._variable(names))
        per_record = [(name, shape) for name, shape, *_ in raw if shape and shape[0] in unlimited]
        sizes = {name: int(np.prod([self.dims[d] for d in shape[1:]], dtype=np.int64)) for name, shape in per_record}
        width = {name: np.dtype(TYPES[kind]).itemsize for name, _, _, kind, _ in raw}
        bytes_ = {name: n * width[name] for name, n in sizes.items()}
        record = next(iter(bytes_.values())) if len(bytes_) == 1 else sum(-(-n // 4) * 4 for n in bytes_.values())
        self.variables = {}
        for name, shape, attributes, kind, begin in raw:
            sizes_ = tuple(self.dims[d] for d in shape)
            inner = int(np.prod(sizes_[1:], dtype=np.int64)) * width[name]
            self.variables[name] = Variable(name, shape, sizes_, TYPES[kind], begin, record if name in bytes_ else inner, attributes)

    def _take(self, n: int) -> bytes:
        while len(self.buffer) < self.at + n:
            more = self.read(len(self.buffer), max(n, 1 << 16))
            if not more:
                raise ValueError("the header is cut short")
            self.buffer += more
        self.at += n
        return self.buffer[self.at - n : self.at]

    def _int(self) -> int:
        return struct.unpack(">i", self._take(4))[0]

    def _number(self) -> int:
        return struct.unpack(">q", self._take(8))[0] if self.wide else self._int()

    def _name(self) -> str:
        n = self._number()
        return self._take(-(-n // 4) * 4)[:n].decode()

    def _list(self, tag: int, one) -> list:
        found, n = self._int(), self._number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header is damaged")
        return [one() for _ in range(n)]

    def _attributes(self) -> dict:
        def one():
            name, kind, n = self._name(), self._int(), self._number()
            dtype = np.dtype(TYPES[kind])
            data = self._take(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
            return name, data.decode(errors="replace") if kind == 2 else np.frombuffer(data, dtype)

        return dict(self._list(_ATTRIBUTES, one))

    def _variable(self, names: list[str]) -> tuple:
        name = self._name()
        dims = tuple(names[self._number()] for _ in range(self._number()))
        attributes, kind = self._attributes(), self._int()
        self._number()  # its size, which follows from the rest
        begin = struct.unpack(">q", self._take(8))[0] if self.long_offsets else self._int()
        return name, dims, attributes, kind, begin

    def values(self, name: str, step: int | None = None, rows: tuple[int, int] | None = None) -> np.ndarray:
        """A variable's values as doubles, unpacked, with NaN where they are missing: all, or one step of its first dimension, or of that some places of the second."""
        v = self.variables[name]
        steps = [0] if not v.shape else range(v.shape[0]) if step is None else [step]
        width = np.dtype(v.kind).itemsize
        n = int(np.prod(v.shape[2 if rows else 1 :], dtype=np.int64)) if v.shape else 1
        low, size = (rows[0] * n * width, (rows[1] - rows[0]) * n * width) if rows else (0, n * width)
        out = np.concatenate([np.frombuffer(self.read(v.begin + k * v.step + low, size), v.kind) for k in steps]) if len(steps) else np.zeros(0, v.kind)
        out = out.astype(np.float64)
        gone = [float(v.attributes[a][0]) for a in ("_FillValue", "missing_value") if a in v.attributes and not isinstance(v.attributes[a], str)]
        for g in gone:
            out[out == g] = np.nan
        scale, shift = (float(v.attributes[a][0]) if a in v.attributes else d for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + shift


def _open(uri: str) -> Classic:
    system, path = file_at(uri)
    f = system.open_input_file(path)
    return Classic(lambda at, n: f.read_at(n, at), f.size())


def read_netcdf(spark: SparkSession, paths: list[str], variables: list[str]) -> DataFrame:
    """Rows of variables that share their dimensions: a place (from 0) for each dimension, `<dimension>_at` where the file has its coordinate, and the values.

    Missing values are null; rows all of whose values are missing are left out, as background has no
    rows. Steps of the first dimension are numbered on from file to file, in the order of `paths`.
    """
    ship(spark)
    files = [_open(p) for p in paths]
    dims = files[0].variables[variables[0]].dims
    if unlike := [v for f in files for v in variables if f.variables[v].dims != dims]:
        raise ValueError(f"these don't have the dimensions {dims}: {sorted(set(unlike))}")
    placed = [d for d in dims if d in files[0].variables]
    schema = ", ".join([*(f"`{d}` long" for d in dims), *(f"`{d}_at` double" for d in placed), *(f"`{v}` double" for v in variables)])
    names = [*dims, *(f"{d}_at" for d in placed), *variables]
    first = np.concatenate([[0], np.cumsum([f.variables[variables[0]].shape[0] for f in files])]).tolist()
    tasks = spark.createDataFrame(list(zip(paths, first, strict=False)), "path string, first long").repartitionByRange(len(paths), "first")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = _open(path)
                shape = f.variables[variables[0]].shape
                inner = np.indices(shape[1:]).reshape(len(shape) - 1, -1) if len(shape) > 1 else np.zeros((0, 1), np.int64)
                at = {d: f.values(d) for d in placed}
                for k in range(shape[0]):
                    values = [f.values(v, k) for v in variables]
                    keep = np.flatnonzero(~np.logical_and.reduce([np.isnan(v) for v in values]))
                    places = [np.full(len(keep), k), *(i[keep] for i in inner)]
                    columns = [pa.array(places[0] + start), *(pa.array(p.astype(np.int64)) for p in places[1:])]
                    columns += [pa.array(at[d][p], from_pandas=True) for d, p in zip(dims, places, strict=True) if d in at]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v[keep], from_pandas=True) for v in values)], names=names)

    return tasks.mapInArrow(tidied(run), schema)
