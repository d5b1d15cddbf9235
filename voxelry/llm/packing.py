"""Operator 5: packing of token sequences by patterns of few lengths, fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import by_batch, send, ship
from ..storage import Scratch, partitions
from .textops import slices
from .word_tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each run of up to `capacity` ids of each document, end_id included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, base, row, piece, start, length, crc = encoder(path), 0, [], [], [], [], []
        for lo, _, buf, offsets in slices(batch.column(1)):
            ids, first = enc.encode(buf, offsets, end_id)
            data = ids.astype("<u4").tobytes()
            for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                for k, x in enumerate(range(a, b, capacity)):
                    y = min(x + capacity, b)
                    row.append(lo + i)
                    piece.append(k)
                    start.append(x - a)
                    length.append(y - x)
                    crc.append(zlib.crc32(data[4 * x : 4 * y]))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    send(docs.sparkSession, path)
    return by_batch(docs.select("doc_id", "text"), run, _PIECES, keeps=True)


def patterns(lengths: np.ndarray, capacity: int, most: int = 24_000) -> list[tuple[int, ...]]:
    """Ways to fill a sequence exactly with two, three or four of the lengths that occur.

    All pairs; triples and quadruples in even steps through the lengths until there are `most`.
    """
    there = set(lengths.tolist())
    out = {(capacity,)} if capacity in there else set()
    out |= {(a, capacity - a) for a in there if a >= capacity - a and capacity - a in there}
    order = sorted(there, reverse=True)
    quota = most // 2
    triples: set[tuple[int, ...]] = set()
    for step in range(1, len(order) + 1):
        if len(triples) >= quota or step > 64:
            break
        for i, a in enumerate(order):
            b = order[(i * step + i) % len(order)]
            c = capacity - a - b
            if c > 0 and c in there:
                triples.add(tuple(sorted((a, b, c), reverse=True)))
    quads: set[tuple[int, ...]] = set()
    for step in range(1, len(order) + 1):
        if len(quads) >= quota or step > 64:
            break
        for i, a in enumerate(order):
            b, c = order[(i * step + i) % len(order)], order[(i * 3 + step * 7) % len(order)]
            d = capacity - a - b - c
            if d > 0 and d in there:
                quads.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(out) + sorted(triples) + sorted(quads)


def fit(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, A's columns the patterns, by cyclic coordinate descent."""
    rest = counts.astype(np.float64).tolist()
    parts = [(tuple(Counter(c).items()), float(sum(v * v for v in Counter(c).values()))) for c in columns]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, norm) in enumerate(parts):
            step = sum(v * rest[k] for k, v in items) / norm
            new = max(0.0, x[j] + step)
            if (d := new - x[j]) != 0.0:
                x[j] = new
                for k, v in items:
                    rest[k] -= d * v
                moved = max(moved, abs(d))
        if moved < 0.05:
            break
    return np.array(x)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, so that every length is used counts[length] times.

    The fitted patterns come first, rounded and never beyond what is there; what is left is
    packed best-fit decreasing, equal lengths and equal gaps in one step. The work depends on the
    capacity, not on the number of documents.
    """
    counts = counts.copy()
    columns = patterns(np.flatnonzero(counts), capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for pattern, x in sorted(zip(columns, fit(columns, counts), strict=True), key=lambda p: (-p[0][0], p[0])) if columns else []:
        need = Counter(pattern)
        if (n := min([int(x + 0.5), *(int(counts[k]) // v for k, v in need.items())])) > 0:
            out.append((pattern, n))
            for k, v in need.items():
                counts[k] -= n * v
    gaps: list[int] = []  # sizes of gaps in open sequences, ascending, and the sequences of each
    open_: dict[int, list[list]] = {}

    def put(pattern: tuple[int, ...], n: int, gap: int) -> None:
        if gap and gap not in open_:
            insort(gaps, gap)
        open_.setdefault(gap, []).append([pattern, n])

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = capacity // length
                full, more = divmod(left, each)
                if full:
                    put((length,) * each, full, capacity - each * length)
                if more:
                    put((length,) * more, 1, capacity - more * length)
                left = 0
                break
            gap = gaps[i]
            rows = open_[gap]
            pattern, n = rows[-1]
            each = min(gap // length, max(1, left // n)) if left >= n else 1
            use = min(n, left // each)
            if use == n:
                rows.pop()
                if not rows:
                    gaps.pop(i)
                    del open_[gap]
            else:
                rows[-1][1] -= use
            put(pattern + (length,) * each, use, gap - each * length)
            left -= use * each
    return out + [(p, n) for rows in open_.values() for p, n in rows]


class Places:
    """Sequence and offset of the r-th piece of each length, from a plan."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> None:
        slots, base = [], 0
        for pattern, n in chosen:
            offset = 0
            for length in pattern:
                slots.append((length, n, base, offset))
                offset += length
            base += n
        slots.sort(key=lambda s: s[0])
        a = np.array(slots, np.int64).reshape(-1, 4)
        self.sequences, self.base, self.offset = base, a[:, 2], a[:, 3]
        self.before = np.concatenate([[0], np.cumsum(a[:, 1])])
        self.group = np.searchsorted(a[:, 0], np.arange(capacity + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # slots of all lengths lie one behind the other, so a rank becomes a place in the whole
        whole = self.before[self.group[length]] + rank
        slot = np.searchsorted(self.before, whole, "right") - 1
        return self.base[slot] + (whole - self.before[slot]), self.offset[slot]


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of documents.

    A document's ids, end_id behind them, are one piece, or if longer are cut every `capacity` ids.
    A null or empty text is the end id alone. Rows may repeat and doc_id may be null: each row is
    packed. Other columns are not read. No rows: no pieces.

    Only counts by length (at most `capacity` numbers) reach the driver, which plans by them; the
    plan's size is bounded by the capacity. Pieces of one length are numbered within salts of
    their document, so a length that a third of all pieces have is ranked by many tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch, salts = Scratch(spark), partitions(spark)
    cut = scratch.save(pieces(docs, path, capacity, end_id)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    by_salt = cut.groupBy("length", "salt").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity), capacity))
    before = by_salt.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    inside = cut.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = inside.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("before")).alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = places.value.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return by_batch(ranked, run, _PIECES + ", sequence_id long, offset long")
