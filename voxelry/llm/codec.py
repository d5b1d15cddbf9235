"""Small self-describing blobs of integer and float arrays: byte planes under zstd."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<qB")


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest."""
    values = np.asarray(values).astype(np.uint64, copy=False)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(values) else b""
    return _HEAD.pack(len(values), width) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(blob)
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(memoryview(blob)[_HEAD.size :], n * width, "zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    values = np.asarray(values).astype(np.uint64, copy=False)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_signed(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.int64)
    return pack(((values << 1) ^ (values >> 63)).view(np.uint64))


def unpack_signed(blob: bytes) -> np.ndarray:
    v = unpack(blob)
    return ((v >> np.uint64(1)) ^ (~(v & np.uint64(1)) + np.uint64(1))).view(np.int64)


def pack_floats(values: np.ndarray) -> bytes:
    """Doubles with few different values: a dictionary and places in it."""
    table, at = np.unique(np.asarray(values, np.float64), return_inverse=True)
    return struct.pack("<q", len(table)) + table.tobytes() + pack(at)


def unpack_floats(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<q", blob)
    table = np.frombuffer(blob, np.float64, n, 8)
    return table[unpack(blob[8 + 8 * n :]).astype(np.int64)] if n else np.zeros(0)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(np.asarray(flags, bool)).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Places that split ascending 64-bit keys into `parts` equal ranges of the key space."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
