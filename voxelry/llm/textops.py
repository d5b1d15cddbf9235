"""Vectorised work on the UTF-8 bytes of many texts at once.

The word pattern ``[^\\x20\\x09-\\x0D]+`` only names ASCII bytes, so words are found on bytes.
Texts of one Arrow batch lie one behind the other in a single buffer; words never cross texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes compared in one go, so that temporary arrays stay small.
BLOCK = 1 << 19
#: Bytes of text taken from an Arrow batch at a time.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values, the same on every machine and for every library version."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


#: Longest byte strings hashed by columns of eight bytes; longer ones by BLAKE2b, one by one.
SHORT = 64
_LENGTH = randoms(SHORT + 1, 1 << 20)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def segment_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end]; they depend on nothing else.

    Strings of equal length up to eight bytes never collide, as each step scrambles a value it
    can't lose; longer ones take a step for each eight bytes, none of which is linear.
    """
    size = end - start
    load = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    out = _LENGTH[np.minimum(size, SHORT)]
    live, at, left = slice(None), start, size
    for _ in range(0, SHORT, 8):
        out[live] = mix(out[live] ^ (load[at] & _LOW[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    data = memoryview(np.ascontiguousarray(buf))
    for i in live.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same(a: np.ndarray, start: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start:start + size] and b[other:other + size] are equal, of each pair."""
    out = np.ones(len(start), bool)
    for lo, hi in _runs(size):
        n = size[lo:hi]
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        differ = a[np.repeat(start[lo:hi], n) + inside] != b[np.repeat(other[lo:hi], n) + inside]
        out[lo:hi][np.repeat(np.arange(hi - lo), n)[differ]] = False
    return out


def _runs(size: np.ndarray):
    """Bounds of runs of about BLOCK in all."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
        yield lo, hi
        lo = hi


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their two parts; the order matters."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) ^ b)


def window_hash(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the sequences h[start:start + length] of word hashes: windows of powers of two, chained by the bits of length."""
    if not len(start):
        return np.zeros(0, U64)
    out, done, part, size = None, 0, h, 1
    while True:
        if length & size:
            own = part[start + done]
            out = own if out is None else _chained(out, own)
            done += size
        if 2 * size > length:
            return mix(out ^ _LENGTH[length % SHORT])
        part = _chained(part[: len(part) - size], part[size:])
        size *= 2


def texts(column) -> pa.Array:
    """The column as one string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column, "") if column.null_count else column


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    data = array.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(column, limit: int = SLICE):
    """(first row, last row + 1, bytes, offsets) of runs of about `limit` bytes of a text column."""
    buf, offsets = raw(texts(column))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of several texts: byte places, hashes, and the first word of each text (with the end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of texts buf[offsets[i]:offsets[i + 1]]; lower: A-Z become a-z first."""
    if lower:
        buf = LOWER[buf]
    inside = ~SPACE[buf]
    head, tail = inside.copy(), inside.copy()
    if len(buf):
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(buf))]
        head[edge] = inside[edge]
        tail[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets), segment_hash(buf, start, end))


def joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each text's kept words, joined by one space."""
    start, size = w.start[keep], (w.end - w.start)[keep] + 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    out = np.append(w.buf, np.uint8(32))[at]
    out[ends - 1] = 32
    kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
    bounds = np.concatenate([[0], ends])[kept]
    return out, bounds


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start:start + size] of all, one behind the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
