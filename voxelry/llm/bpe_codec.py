"""Operator 1: byte-level BPE encoding and decoding by a lazily determinised transducer."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, Transducer, Utf8Stream, read_ranks, running
from .pieces import Memory, cut, one_by_one
from ..ship import by_batch, kept, local, send
from .textops import gather, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes texts to token ids and back, for one file of ranks."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.transducer = Transducer(Merges(ranks))
        self.memory = Memory(one_by_one(self.transducer.encode))
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for token, i in ranks.items():
            by_id[i] = token
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.start = np.array(running(self.size.tolist())[:-1], np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        return self.memory.tokens(buf, *cut(buf, offsets))

    def token_bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.start[ids], self.size[ids])

    def decode(self, ids: np.ndarray, step: int = 4096):
        """Text of ids, as it comes: every part is whole characters."""
        stream = Utf8Stream()
        for lo in range(0, len(ids), step):
            yield stream.feed(self.token_bytes(ids[lo : lo + step]).tobytes())
        yield stream.feed(b"", last=True)

    @staticmethod
    def characters(data: bytes, step: int = 1 << 14):
        """Text of token bytes, as it comes: every part is whole characters."""
        stream = Utf8Stream()
        for lo in range(0, len(data), step):
            yield stream.feed(data[lo : lo + step])
        yield stream.feed(b"", last=True)


def codec(path: str) -> Codec:
    return kept(("codec", path), lambda: Codec(local(path)))


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids as binary: little-endian unsigned 32-bit) of every row; null text counts as empty."""

    send(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, out = codec(path), []
        for _, _, buf, offsets in slices(batch.column(1)):
            ids, first = c.encode(buf, offsets)
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "ids"])

    return by_batch(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary", keeps=True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents.

    path: file of ranks. A null text counts as empty (no tokens, digests of nothing); rows may
    repeat and doc_id may be null: each row gives one row. Other columns are not read.
    """

    send(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, one, two = codec(path), [], [], []
        for _, _, buf, offsets in slices(batch.column(1)):
            ids, first = c.encode(buf, offsets)
            wide, data = ids.astype("<u4").tobytes(), c.token_bytes(ids).tobytes()
            ends = np.concatenate([[0], np.cumsum(c.size[ids])])[first].tolist()
            for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
                digest = hashlib.sha256()
                for part in c.characters(data[ends[k] : ends[k + 1]]):
                    digest.update(part.encode())
                n.append(b - a)
                one.append(hashlib.sha256(wide[4 * a : 4 * b]).hexdigest())
                two.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(docs.select("doc_id", "text"), run, SCHEMA, keeps=True)
