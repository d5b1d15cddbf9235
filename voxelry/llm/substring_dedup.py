"""Operator 7: removal of repeated word sequences, found by difference-cover anchors.

Positions of a text whose residue modulo a period lies in a difference cover are anchors. For any
two places of equal windows some offset below the period makes both anchors, so hashing the short
windows at anchors alone finds every long match. Anchors that occur twice are then extended to the
whole windows that contain them, and only those are compared, by the hash of all their words. Texts
are dealt into chunks of bounded size; chunks send sorted, packed hashes to ranges of the hash space
and get one bit back for each, so that a very common passage costs one entry a chunk, wherever it
stands.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import cuts, pack, pack_bits, pack_signed, pack_sorted, unpack, unpack_bits, unpack_signed, unpack_sorted
from ..ship import ship, tidied
from ..storage import shares
from .textops import Words, joined, raw, texts, window_hash, words

_ASK = "part int, kind int, chunk long, n long, keys binary, extra binary, docs binary, starts binary"
_TELL = "part int, kind int, chunk long, n long, bits binary"
_NULL = -(1 << 63)
#: Bytes of text in a chunk, about; one task holds one at a time.
CHUNK = 4 << 20
#: Chunks whose hashes a part of the hash space holds, about. A message holds a key at least, so however many
#: chunks and parts there are, there are no more messages than anchors and windows.
CHUNKS_A_PART = 12


def _covers(period: int, residues) -> bool:
    return len({(a - b) % period for a in residues for b in residues}) == period


def _smallest(period: int, size: int) -> tuple[int, ...] | None:
    """A difference cover of that many residues, 0 and 1 among them; None if there is none or too many would have to be tried."""
    if size * (size - 1) + 1 < period or size < 2 or comb(period - 2, size - 2) > 30_000:
        return None
    return next(((0, 1, *more) for more in combinations(range(2, period), size - 2) if _covers(period, (0, 1, *more))), None)


def _greedy(period: int) -> tuple[int, ...]:
    chosen, missing = [0], set(range(1, period))
    while missing:
        x = max(range(1, period), key=lambda x: len({d for c in chosen for d in ((x - c) % period, (c - x) % period)} & missing))
        chosen.append(x)
        missing -= {d for c in chosen for d in ((x - c) % period, (c - x) % period)}
    return tuple(sorted(chosen))


@cache
def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and difference cover for windows of so many words: the cover with the fewest anchors whose short windows keep a third of the window."""
    best = (1, (0,))
    for period in range(2, max(2, window - window // 3 + 1)):
        found = next((c for size in range(2, 9) if (c := _smallest(period, size))), None) or _greedy(period)
        if len(found) * best[0] < len(best[1]) * period:
            best = (period, found)
    return best


class _Chunk:
    """Words, anchors and windows of the texts of one chunk."""

    def __init__(self, doc_ids: np.ndarray, column: pa.Array, window: int) -> None:
        buf, offsets = raw(texts(column))
        self.ids, self.window, self.offsets = doc_ids, window, offsets
        self.w: Words = words(buf, offsets)
        self.period, residues = cover(window)
        short = window - self.period + 1
        self.doc, self.room = self.w.doc(), self.w.room()
        self.place = np.arange(len(self.doc)) - self.w.first[:-1][self.doc]
        at = np.isin(self.place % self.period, residues) & (self.room >= short)
        self.anchor = np.flatnonzero(at)
        self.anchor_hash = window_hash(self.w.hash, self.anchor, short)

    def candidates(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that contain an anchor occurring twice; flags: by unique anchor hash."""
        _, back = np.unique(self.anchor_hash, return_inverse=True)
        hot = np.zeros(len(self.doc) + self.period + 1, np.int64)
        hot[self.anchor[flags[back]] + 1] = 1
        total = np.cumsum(hot)
        n = len(self.doc)
        near = (total[self.period : self.period + n] - total[:n]) > 0
        start = np.flatnonzero(near & (self.room >= self.window))
        return start, window_hash(self.w.hash, start, self.window)

    def firsts(self, start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unique keys, the first place of each by document and start, and each window's unique key."""
        ids = self.ids[self.doc[start]]
        order = np.lexsort((self.place[start], ids, keys))
        head = np.ones(len(order), bool)
        head[1:] = keys[order][1:] != keys[order][:-1]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(head) - 1
        return keys[order][head], order[head], back


def _ids(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False), np.int64)


def _ask(rows: list[tuple]) -> pa.Table:
    names = ["part", "kind", "chunk", "n", "keys", "extra", "docs", "starts"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _twice(_, table):
    """Of each asked anchor, whether it occurs twice anywhere."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    own = [unpack_bits(bits, n) for bits, n in zip(table["extra"].to_pylist(), table["n"].to_pylist(), strict=True)]
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return _tell(table, (count > 1)[back] | np.concatenate(own))


def _earliest(_, table):
    """Of each asked window, whether the asker's first place of it is the first of all; rows that repeat a document may share it."""
    keys = np.concatenate([unpack_sorted(k) for k in table["keys"].to_pylist()])
    docs = np.concatenate([unpack_signed(k) for k in table["docs"].to_pylist()])
    starts = np.concatenate([unpack(k) for k in table["starts"].to_pylist()])
    order = np.lexsort((starts, docs, keys))
    head = np.ones(len(order), bool)
    head[1:] = keys[order][1:] != keys[order][:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    bits = np.empty(len(order), bool)
    bits[order] = (docs[order] == docs[first]) & (starts[order] == starts[first])
    return _tell(table, bits)


def _tell(table, bits: np.ndarray):
    ends = np.cumsum(table["n"].to_numpy()).tolist()
    return table.select(["part", "kind", "chunk", "n"]).append_column("bits", pa.array([pack_bits(bits[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary()))


def _bits(answers: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r["part"], r["bits"], r["n"]) for r in answers.to_pylist() if r["kind"] == kind)
    return np.concatenate([unpack_bits(bits, n) for _, bits, n in rows]) if rows else np.zeros(0, bool)


def _plan(docs: DataFrame, window: int, finish, schema: str, extra: list[str], chunks: int | None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    n_chunks = chunks or shares(docs, CHUNK)
    parts = -(-n_chunks // CHUNKS_A_PART)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)

    def load(table: pa.Table) -> _Chunk:
        return _Chunk(_ids(table["doc_id"]), table["text"], window)

    def ask_anchors(key, table):
        keys, count = np.unique(load(table).anchor_hash, return_counts=True)
        at = cuts(keys, parts).tolist()
        return _ask([(p, 0, key[0].as_py(), b - a, pack_sorted(keys[a:b]), pack_bits(count[a:b] > 1), None, None) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a])

    def ask_windows(key, table, answers):
        if not table.num_rows:
            return _ask([])
        c = load(table)
        start, hashes = c.candidates(_bits(answers, 0))
        keys, first, _ = c.firsts(start, hashes)
        ids, places = c.ids[c.doc[start[first]]], c.place[start[first]]
        at = cuts(keys, parts).tolist()
        return _ask([(p, 1, key[0].as_py(), b - a, pack_sorted(keys[a:b]), None, pack_signed(ids[a:b]), pack(places[a:b])) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a])

    def last(key, table, answers):
        if not table.num_rows:
            return finish(None, None, table)
        c = load(table)
        start, hashes = c.candidates(_bits(answers, 0))
        _, first, back = c.firsts(start, hashes)
        ids, places = c.ids[c.doc[start]], c.place[start]
        own = _bits(answers, 1)[back] & (ids == ids[first][back]) & (places == places[first][back])
        edge = np.zeros(len(c.doc) + 1, np.int64)
        again = start[~own]
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        return finish(c, np.cumsum(edge)[:-1] == 0, table)

    told = dealt.groupBy("chunk").applyInArrow(tidied(ask_anchors), _ASK).groupBy("part").applyInArrow(tidied(_twice), _TELL)
    asked = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(tidied(ask_windows), _ASK)
    both = told.unionByName(asked.groupBy("part").applyInArrow(tidied(_earliest), _TELL))
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(tidied(last), schema)


def digests(docs: DataFrame, window: int = 20, chunks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of documents.

    Removed is each word covered by a window of `window` words whose sequence also starts earlier:
    in a smaller doc_id (null is smallest) or earlier in the same one. Rows with the same doc_id
    count as one document: windows at the same start of it don't precede one another. Null and
    empty texts have no words; shorter texts lose none. kept_sha256 is of the kept words joined by
    one space. Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def finish(c: _Chunk | None, keep: np.ndarray | None, table: pa.Table) -> pa.Table:
        ids, n, gone, digest = [], [], [], []
        if c is not None:
            out, bounds = joined(c.w, keep)
            total = np.concatenate([[0], np.cumsum(keep)])[c.w.first]
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                digest.append(hashlib.sha256(out[a : max(a, b - 1)].tobytes()).hexdigest())
            ids, n = table["doc_id"].combine_chunks(), c.w.counts
            gone = n - np.diff(total)
        return pa.table([pa.array(ids, pa.int64()) if isinstance(ids, list) else ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=names)

    return _plan(docs.select("doc_id", "text"), window, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", [], chunks)


def remove_repeats(docs: DataFrame, window: int = 50, chunks: int | None = None) -> DataFrame:
    """The rows of documents with repeated passages cut out of `text` (and n_chars, if there, counted anew).

    As digests(), but a text that loses nothing stays as it is, and others keep the white space
    behind each kept word. Other columns are passed on.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    names = {c: f"other_{i}" for i, c in enumerate(others)}
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(names[c]) for c in others])
    types = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    order = plain.columns
    schema = ", ".join(f"{c} {'long' if c == 'doc_id' else types[c]}" for c in order)

    def finish(c: _Chunk | None, keep: np.ndarray | None, table: pa.Table) -> pa.Table:
        table = table.select(order)
        if c is None:
            return table
        text, new, bounds = table["text"].combine_chunks(), [], c.w.first.tolist()
        lost = np.add.reduceat(np.append(~keep, False).astype(np.int64), np.minimum(c.w.first[:-1], len(keep))) * (c.w.counts > 0) if len(c.w.counts) else []
        for i, gone in enumerate(lost):
            if not gone:
                new.append(text[i].as_py())
                continue
            a, b = bounds[i], bounds[i + 1]
            start, follow = c.w.start[a:b], np.append(c.w.start[a + 1 : b], c.offsets[i + 1])
            kept = keep[a:b]
            new.append(b"".join(c.w.buf[x:y].tobytes() for x, y in zip(start[kept].tolist(), follow[kept].tolist(), strict=True)).decode())
        return table.set_column(1, "text", pa.array(new, pa.string()))

    out = _plan(plain, window, finish, schema, list(names.values()), chunks)
    fields = [F.col(names[c]).alias(c) if c in names else F.col(c) for c in columns]
    out = out.select(*fields)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


__all__ = ["cover", "digests", "remove_repeats"]
