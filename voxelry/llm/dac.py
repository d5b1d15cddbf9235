"""Operator 10: token ids as directly addressable codes, in binary files.

A file holds the ids of consecutive documents and is read in place, by offsets:

    magic "DAC1", levels (1 byte), 3 bytes of zeros, documents, ids (two unsigned 64-bit integers)
    document ids (signed 64-bit), a bitmap of null document ids, first id of each document and the end (unsigned 64-bit)
    for each level: entries (unsigned 64-bit), bitmap of entries that go on, rank directory, one byte an entry

Level 0 holds the low 8 bits of every id; an entry whose bit is set goes on in the next level, at
the place that counts the set bits before it. The directory holds those counts for every 512
entries (unsigned 32-bit), so any id is found without decoding others. All numbers are little-endian;
every part is padded to 8 bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import send, ship, tidied
from ..storage import Scratch, file_at, partitions
from .textops import slices
from .word_tokens import encoder

MAGIC, STEP = b"DAC1", 512
_HEAD = struct.Struct("<4sB3xQQ")
#: Bytes of text whose ids make a file, about.
SEGMENT = 16 << 20
_FILES = "segment int, n_docs long, n_tokens long, file string, size long"


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def build(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A segment of the documents' ids, which lie one behind the other."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        directory = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.uint32))]).astype("<u4") if len(more) else np.zeros(1, "<u4")
        levels.append(struct.pack("<Q", len(rest)) + _padded(bits.tobytes()) + _padded(directory.tobytes()) + _padded((rest & 255).astype(np.uint8).tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
    return _HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)) + known + _padded(nulls) + bounds + b"".join(levels)


class Segment:
    """Reads a file's parts where they are; read(offset, size) gives its bytes."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        magic, levels, self.docs, self.n = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = self._known = _HEAD.size
        at = self._null = at + 8 * self.docs
        at = self._bounds = at + _up((self.docs + 7) // 8)
        at += 8 * (self.docs + 1)
        self.levels = []  # entries, and where bitmap, directory and bytes begin
        for _ in range(levels):
            (n,) = struct.unpack("<Q", read(at, 8))
            bits = at + 8
            directory = bits + _up((n + 7) // 8)
            low = directory + _up(4 * (-(-n // STEP) + 1))
            self.levels.append((n, bits, directory, low))
            at = low + _up(n)

    @classmethod
    def of(cls, data: bytes) -> Segment:
        return cls(lambda at, size: data[at : at + size])

    @classmethod
    def open(cls, uri: str) -> Segment:
        """A written file; each access reads the few bytes that it needs."""
        system, path = file_at(uri)
        f = system.open_input_file(path)
        return cls(lambda at, size: f.read_at(size, at))

    @property
    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(np.frombuffer(self.read(self._null, (self.docs + 7) // 8), np.uint8), count=self.docs, bitorder="little").tolist()
        return [None if z else d for d, z in zip(np.frombuffer(self.read(self._known, 8 * self.docs), "<i8").tolist(), null, strict=True)]

    @property
    def bounds(self) -> np.ndarray:
        """First id of each document, and the end."""
        return np.frombuffer(self.read(self._bounds, 8 * (self.docs + 1)), "<u8").astype(np.int64)

    def _rank(self, level: tuple, i: int) -> int:
        """Set bits before place i of a level: its block's count and those of at most 64 bytes."""
        n, bits, directory, _ = level
        block = i // STEP
        (count,) = struct.unpack("<I", self.read(directory + 4 * block, 4))
        part = np.frombuffer(self.read(bits + block * STEP // 8, (i >> 3) - block * STEP // 8 + (i & 7 > 0)), np.uint8)
        return count + int(np.unpackbits(part, count=i - block * STEP, bitorder="little").sum())

    def __getitem__(self, i: int) -> int:
        """The id at place i: one byte a level, by bitmap and rank directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            _, bits, _, low = level
            value |= self.read(low + i, 1)[0] << shift
            if not self.read(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
            shift += 8
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b (without b): one run of bytes a level."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        for k, level in enumerate(self.levels):
            if a == b:
                break
            _, bits, _, low = level
            out[at] |= np.frombuffer(self.read(low + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            flags = np.unpackbits(np.frombuffer(self.read(bits + (a >> 3), (b + 7 >> 3) - (a >> 3)), np.uint8), bitorder="little")[a & 7 :][: b - a].astype(bool)
            at = at[flags]
            a = self._rank(level, a)
            b = a + len(at)
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, b = struct.unpack("<QQ", self.read(self._bounds + 8 * k, 16))
        return self.span(a, b)

    def all(self) -> np.ndarray:
        """All ids."""
        return self.span(0, self.n)


def _up(n: int) -> int:
    return n + -n % 8


def write(docs: DataFrame, path: str, end_id: int = 1, scratch: Scratch | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order as files in the shared folder; a row for each.

    Columns: segment int (their order is that of the ids), n_docs, n_tokens long, file string (its
    URI), size long (bytes). A document's ids are those of its text (null: empty), then end_id. Null
    doc_ids come first; rows with the same doc_id stay next to each other, in the order of a hash of their texts. Rows are
    sorted over all partitions by whole 64-bit ids, then by that hash, so that the rows of one id may fill several
    files; texts are encoded where they then lie. The number of files follows the counted bytes of text
    (`segment` a file), so a file and the task that writes it stay of that size, whatever the ids;
    only a single longer text makes a larger one. A file's name is of one attempt of a task: the
    rows, written last, name the files that count. No rows: no files.
    """
    spark = docs.sparkSession
    ship(spark)
    send(spark, path)
    scratch = scratch or Scratch(spark)
    size = int(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0)
    folder = scratch.folder("tokens")

    def run(batches):
        docs_, sizes, ids_, part, enc = [], [], [], None, encoder(path)
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                docs_ += batch.column(1).to_pylist()
            for _, _, buf, offsets in slices(batch.column(2)):
                ids, first = enc.encode(buf, offsets, end_id)
                ids_.append(ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids)
                sizes.append(np.diff(first))
        if part is None:
            return
        sizes = np.concatenate(sizes)
        data = build(np.concatenate(ids_), docs_, sizes)
        uri = f"{folder}/{part:08d}-{uuid.uuid4().hex}.dac"
        system, name = file_at(uri)
        system.create_dir(name.rpartition("/")[0])
        with system.open_output_stream(name) as f:
            f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, len(sizes), int(sizes.sum()), uri, len(data)), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=[c.split()[0] for c in _FILES.split(", ")])

    keys = [F.col("doc_id").asc_nulls_first(), F.col("salt").asc()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("salt")).repartitionByRange(max(1, -(-size // segment)), *keys).sortWithinPartitions(*keys)
    return scratch.save(ranged.select(F.spark_partition_id().alias("segment"), "doc_id", "text").mapInArrow(tidied(run, keeps=True), _FILES))


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in written files, from their bytes."""
    spark = segments.sparkSession
    before = F.sum("n_tokens").over(Window.orderBy("segment")) - F.col("n_tokens")  # a row a file

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, start, size, crc = [], [], [], []
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, path = file_at(uri)
            with system.open_input_file(path) as f:
                s = Segment.of(f.read())
            ids, bounds = s.all().astype("<u4").tobytes(), s.bounds
            docs += s.doc_ids
            start += (base + bounds[:-1]).tolist()
            size += np.diff(bounds).tolist()
            crc += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (docs, start, size, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = segments.select("segment", "file", before.alias("base"))
    files = files.repartitionByRange(max(1, min(files.count(), 4 * partitions(spark))), "segment").select("file", "base")
    ship(spark)

    def each(batches):  # a file at a time
        for batch in batches:
            for i in range(batch.num_rows):
                yield run(batch.slice(i, 1))

    return files.mapInArrow(tidied(each), "doc_id long, start long, n_tokens long, ids_crc32 long")
