"""Operator 11: groups of tokens of two tokenizers that end at the same bytes, and which tokens they link."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import kept, local, send, ship, tidied
from ..storage import Scratch
from .bpe import read_merges, running
from .codec import pack, unpack
from .pieces import Memory, cut, one_by_one
from .textops import gather, slices

#: Labels of a byte: no token ends with it, one of A does, one of B does, or both.
A_END, B_END, BOTH = 1, 2, 3
#: Bytes of texts that tell their pairs together, about.
CHUNK = 2 << 20
#: A stretch of bytes up to one with which tokens of both end.
SPAN = re.compile(rb"[^\x03]*\x03")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_STEP = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


class _Strings:
    """A table of byte strings by number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.array(running(self.size.tolist())[:-1], np.int64)
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)


class ByteSide:
    """Ids of a byte-level BPE model in JSON; its special strings inside texts are plain text."""

    def __init__(self, path: str) -> None:
        ids, _ = read_merges(path)
        self.n = max(ids.values()) + 1
        by_id = [b""] * self.n
        for token, i in ids.items():
            by_id[i] = token
        self.tokens = _Strings(by_id)
        library = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.memory = Memory(one_by_one(library._encode_single_piece), room=32 << 20)  # cut() has applied the pattern, which the library's matcher can't on very long runs

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.memory.tokens(buf, *cut(buf, offsets))


class PieceSide:
    """Ids of a sentencepiece model that puts a space before a text and whose pieces hold spaces only at their start.

    Pieces then never reach into the next run of spaces: a run and what follows it up to the next is encoded
    by itself, once while the memory holds it.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this model hold spaces within")
        self.tokens = _Strings([bytes((int(p[3:5], 16),)) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        self.lead = len(self.model.encode("x"))
        self.memory = Memory(self._encode, room=32 << 20)

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        units = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        blank = [not u.strip(" ") for u in units]  # the library would add a space of its own to what it is given
        found = self.model.encode([f"x{u}" if b else u[1:] for u, b in zip(units, blank, strict=True)], num_threads=1)
        found = [ids[self.lead :] if b else ids for ids, b in zip(found, blank, strict=True)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """buf: texts that begin with a space each."""
        space = buf == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[offsets[:-1]] = True
        start = np.flatnonzero(head)
        return self.memory.tokens(buf, start, np.append(start[1:], len(buf)), np.searchsorted(start, offsets))


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.numbers = _Strings([b"%d," % i for i in range(max(self.a.n, self.b.n))])

    def _spaced(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts that aren't empty, a space before each, and which they are."""
        some = np.flatnonzero(np.diff(offsets))
        return np.insert(buf, offsets[some], 32), np.append(offsets[some] + np.arange(len(some)), len(buf) + len(some)), some

    @staticmethod
    def _spelled(side, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts, each text's first, and whether a text's tokens spell it."""
        ids, first = side.encode(buf, offsets)
        ends = np.concatenate([[0], np.cumsum(side.tokens.size[ids])])[first]
        same = np.diff(ends) == np.diff(offsets)
        flat = gather(side.tokens.bytes, side.tokens.start[ids], side.tokens.size[ids])
        if same.all():
            differ = np.flatnonzero(flat != buf)
            same[np.searchsorted(offsets, differ, "right") - 1] = False
        else:
            for k in np.flatnonzero(same).tolist():
                same[k] = (flat[ends[k] : ends[k + 1]] == buf[offsets[k] : offsets[k + 1]]).all()
        return ids, first, same

    def align(self, buf: np.ndarray, offsets: np.ndarray) -> dict:
        """Of each text n_a, n_b, n_groups, n_links and its groups' digest; of all links whose they are (doc) and the ids' pair (a * ids of B + b)."""
        n = len(offsets) - 1
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"sha": [""] * n, "doc": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64)}
        spaced, bounds, some = self._spaced(buf, offsets)
        if not len(some):
            return out
        a, a_first, a_same = self._spelled(self.a, spaced, bounds)
        b, b_first, b_same = self._spelled(self.b, spaced, bounds)
        good = a_same & b_same
        a, b, docs, size = a[np.repeat(good, np.diff(a_first))], b[np.repeat(good, np.diff(b_first))], some[good], np.diff(bounds)[good]
        if not len(docs):
            return out
        a_ends, b_ends, ends = np.cumsum(self.a.tokens.size[a]), np.cumsum(self.b.tokens.size[b]), np.cumsum(size)
        labels = np.zeros(int(ends[-1]), np.uint8)
        labels[a_ends - 1] |= A_END
        labels[b_ends - 1] |= B_END
        spans = np.array([m.end() for m in SPAN.finditer(labels.tobytes())], np.int64)
        to_a, to_b = (np.concatenate([[0], np.cumsum(labels & which > 0)]) for which in (A_END, B_END))
        group_a, group_b = np.append(0, to_a[spans]), np.append(0, to_b[spans])  # tokens before each group
        group = np.searchsorted(spans, ends)  # each text's last group
        at = np.flatnonzero(labels)  # each ends a stretch that one token of A and one of B cover
        pair = a[to_a[at]].astype(np.int64) * self.b.n + b[to_b[at]]
        last = {"n_a": to_a[ends], "n_b": to_b[ends], "n_groups": group + 1, "n_links": np.searchsorted(at, ends - 1) + 1}
        for c, v in last.items():
            out[c][docs] = np.diff(v, prepend=0)
        text, cuts = self._written(a, b, group_a, group_b)
        data, lo = memoryview(text), 0
        for k, hi in zip(docs.tolist(), cuts[group].tolist(), strict=True):
            out["sha"][k] = hashlib.sha256(data[lo : hi - 1]).hexdigest()
            lo = hi
        return out | {"doc": np.repeat(docs, out["n_links"][docs]), "pair": pair}

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups as a1,a2|b1; and where each ends."""
        per_a, per_b = np.diff(group_a), np.diff(group_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + np.repeat(group_b[:-1], per_a)] = a
        ids[np.arange(len(b)) + np.repeat(group_a[1:], per_b)] = b
        ends = np.cumsum(self.numbers.size[ids])
        text = gather(self.numbers.bytes, self.numbers.start[ids], self.numbers.size[ids])
        text[ends[group_a[1:] + group_b[:-1] - 1] - 1] = ord("|")
        cuts = ends[group_a[1:] + group_b[1:] - 1]
        text[cuts - 1] = ord(";")
        return text, cuts


def aligner(a_path: str, b_path: str) -> Aligner:
    return kept(("aligner", a_path, b_path), lambda: Aligner(local(a_path), local(b_path)))


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in _STEP.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def align(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of documents.

    a_path: a byte-level BPE model in JSON, b_path: a sentencepiece model. Both encode a space and the text. Texts that are
    null, empty, or not spelled by either's tokens have none: zeros and ''. Each row is a document by itself,
    whether its doc_id is null or repeated; other columns are not read. No rows: none.

    Every byte gets a label; a scan by regular expression cuts at those where both end. A labelled byte is a link: it ends what one
    token of A and one of B share. A chunk of texts tells its different pairs with the number of its documents
    that hold them; Spark adds them up, finds each A id's highest, and tells the chunk, which has kept its links as places among its pairs.
    """
    spark = docs.sparkSession
    ship(spark)
    for path in (a_path, b_path):
        send(spark, path)
    scratch = scratch or Scratch(spark)

    def run(batches):
        from pyspark import TaskContext

        tool, chunk = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            held, size = [], 0
            for lo, hi, buf, offsets in slices(batch.column(1)):
                held.append((lo, hi, tool.align(buf, offsets)))
                size += len(buf)
                if size >= CHUNK or hi == batch.num_rows:
                    yield from told_of(batch.column(0).slice(held[0][0], hi - held[0][0]), held, chunk)
                    held, size, chunk = [], 0, chunk + 1

    def told_of(ids, held, chunk: int):
        """What a chunk of texts tells: a row for each of them, and its different pairs."""
        base, n = held[0][0], len(ids)
        doc = np.concatenate([f["doc"] + lo - base for lo, _, f in held])
        keys, place = np.unique(np.concatenate([f["pair"] for _, _, f in held]), return_inverse=True)
        once = np.unique(doc * max(1, len(keys)) + place)  # each document's different pairs
        counts = np.bincount(once % max(1, len(keys)), minlength=len(keys))
        bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
        links = [pack(place[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
        whole = {c: np.concatenate([f[c] for _, _, f in held]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        yield _batch({"chunk": np.full(n, chunk), "doc_id": ids.cast(pa.int64()), "groups_sha256": [x for _, _, f in held for x in f["sha"]], "links": links, **whole}, n)
        for lo in range(0, len(keys), 1 << 16):
            part = keys[lo : lo + (1 << 16)]
            yield _batch({"chunk": np.full(len(part), chunk), "pair": part, "n": counts[lo : lo + (1 << 16)]}, len(part))

    width = sentencepiece.SentencePieceProcessor(model_file=local(b_path)).get_piece_size()
    step = scratch.save(docs.select("doc_id", "text").mapInArrow(tidied(run, keeps=True), _STEP))
    told = step.where("pair IS NOT NULL").select("chunk", "pair", "n")
    counts = told.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {width}"))))
    answers = told.select(F.col("chunk").alias("of"), "pair").join(counts, "pair")
    rows = step.where("links IS NOT NULL").drop("pair", "n")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        places = [unpack(b.as_buffer()).astype(np.int64) for b in left["links"].combine_chunks()] if left.num_rows else []
        sums = [pa.array([int(v[p].sum()) for p in places], pa.int64()) for v in (best, n)]
        return pa.table([left["doc_id"], left["n_a"], left["n_b"], left["n_groups"], left["n_links"], *sums, left["groups_sha256"]], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    return rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(tidied(add_up), SCHEMA)
