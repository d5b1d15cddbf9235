"""Operator 12: approximate nearest neighbours by a neighbour graph from NN-descent and greedy search on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..operators.skew import lookup
from ..ship import by_batch, ship, tidied
from ..storage import Scratch, partitions, release
from .embedding_dedup import _vectors

#: Nodes of a block in which the first, random neighbours are found, and how often the nodes are dealt into blocks.
BLOCK, DEALS = 256, 2
#: A node that more than so many have as a neighbour meets them in several groups.
CROWD = 1024
#: Bytes of rows that one group of a task holds, about.
GROUP = 24 << 20
#: Places from which the search for a vector that isn't in the index begins.
ENTRIES = 64
_GRAPH = "node long, code binary, ids binary, sims binary, fresh binary, far float, changed long"
_PAIR = "v long, w long, s float"


# --- vectors --------------------------------------------------------------------------------------


def _coded(rows: DataFrame, key: str) -> DataFrame:
    """key, vec (the values, as they are) and mark of the rows that take part."""
    single = rows.schema["embedding"].dataType.elementType == FloatType()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, bounds, good = _vectors(batch.column(1))
        good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        stored = v.astype("<f4" if single else "<f8")
        at = np.flatnonzero(good)
        blobs = [stored[bounds[k] : bounds[k + 1]].tobytes() for k in at.tolist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(at)), pa.array(blobs, pa.binary())], names=[key, "vec"])

    out = by_batch(rows.select(key, "embedding"), run, f"{key} long, vec binary")
    return out.withColumn("mark", F.sha2("vec", 256))


@dataclass(frozen=True)
class Shape:
    """How vectors are kept: bytes of a value, their greatest length, and the greatest norm as a fraction and an exponent of 2."""

    wide: int
    dim: int
    top: float

    def values(self, blobs: list[bytes]) -> np.ndarray:
        """Vectors in double precision; shorter ones end in zeros."""
        out = np.zeros((len(blobs), self.dim))
        sizes = np.array([len(b) // self.wide for b in blobs])
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            out[at, :n] = np.frombuffer(b"".join([blobs[k] for k in at.tolist()]), f"<f{self.wide}").reshape(len(at), n)
        return out

    def codes(self, blobs: list[bytes]) -> list[bytes]:
        """The direction in half precision and the norm as a share of the greatest."""
        if not blobs:
            return []
        x = self.values(blobs)
        n = norms(x)
        unit = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float64)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        flat = np.empty((len(x), 2 * self.dim + 8), np.uint8)
        flat[:, :-8] = unit.astype("<f2").view(np.uint8)
        flat[:, -8:] = np.minimum(n / self.top, 1.0)[:, None].view(np.uint8)
        return [r.tobytes() for r in flat]

    def points(self, flat: bytes, query: bool = False) -> np.ndarray:
        """Codes as points of one more dimension, all of norm 1, so that the nearest by angle has the largest inner product; a query's last coordinate is 0."""
        raw = np.frombuffer(flat, np.uint8).reshape(-1, 2 * self.dim + 8)
        s = np.ascontiguousarray(raw[:, -8:]).view("<f8")
        out = np.empty((len(raw), self.dim + 1), np.float32)
        out[:, :-1] = np.ascontiguousarray(raw[:, :-8]).view("<f2") * (1.0 if query else s)
        out[:, -1:] = 0.0 if query else np.sqrt(1.0 - s * s)
        return out


def norms(x: np.ndarray) -> np.ndarray:
    """Without overflow in the squares; at most the largest double."""
    top = np.abs(x).max(axis=1)
    return np.minimum(top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)), np.finfo(np.float64).max)


# --- lists of neighbours --------------------------------------------------------------------------


def best(v: np.ndarray, w: np.ndarray, s: np.ndarray, old: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (v, w) are each v's k nearest, in that order (ties: smaller w), and each one's rank. Of a repeated pair one that is old stays."""
    order = np.lexsort((~old, w, v))
    keep = np.ones(len(order), bool)
    keep[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
    order = order[keep]
    order = order[np.lexsort((w[order], -s[order], v[order]))]
    head = np.ones(len(order), bool)
    head[1:] = v[order][1:] != v[order][:-1]
    first = np.flatnonzero(head)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k], rank[rank < k]


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with ids, sims and fresh: how many each has, and all of them one behind the other."""
    flat = [b"".join(table[c].to_pylist()) for c in ("ids", "sims", "fresh")]
    size = np.array([len(b) for b in table["fresh"].to_pylist()], np.int64)
    return size, np.frombuffer(flat[0], "<i8"), np.frombuffer(flat[1], "<f4"), np.frombuffer(flat[2], np.uint8)


def opened(size: np.ndarray, fresh: np.ndarray, n: int) -> np.ndarray:
    """The first n fresh entries of each list, which a search looks behind next."""
    if n <= 0 or not len(fresh):
        return np.zeros(len(fresh), bool)
    total = np.cumsum(fresh.astype(np.int64))
    before = np.repeat(np.concatenate([[0], total])[np.cumsum(size) - size], size)
    return (fresh > 0) & (total - before <= n)


def _merged(rows: DataFrame, told: DataFrame, k: int, parts: int, scratch: Scratch, settle: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The lists of rows, each with the best k of its own entries and of those told (v, w, s), which are fresh."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = left["node"].to_numpy()
        size, ids, sims, fresh = _lists(left)
        fresh = settle(size, fresh)
        v, w, s = (np.concatenate([a, b]) for a, b in ((np.repeat(nodes, size), right["v"].to_numpy()), (ids, right["w"].to_numpy()), (sims, right["s"].to_numpy())))
        old = np.arange(len(v)) < len(ids)
        flag = np.concatenate([fresh, np.ones(right.num_rows, np.uint8)])
        at, _ = best(v, w, s, old, k)
        order = np.argsort(nodes)
        place = np.searchsorted(nodes[order], v[at])
        bounds = np.searchsorted(place, np.arange(len(nodes) + 1))
        new = np.concatenate([[0], np.cumsum(~old[at])])[bounds]
        out = [[a[lo:hi].tobytes() for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)] for a in (w[at].astype("<i8"), s[at].astype("<f4"), flag[at].astype(np.uint8))]
        far = np.where(np.diff(bounds) > 0, np.append(s[at], 0.0)[bounds[1:] - 1], -np.inf)
        return pa.table([pa.array(nodes[order]), left["code"].take(pa.array(order)), *(pa.array(o, pa.binary()) for o in out), pa.array(far.astype(np.float32)), pa.array(np.diff(new))], names=["node", "code", "ids", "sims", "fresh", "far", "changed"])

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    one, two = rows.select(part("node").alias("part"), "node", "code", "ids", "sims", "fresh"), told.select(part("v").alias("of"), "v", "w", "s")
    return scratch.save(one.groupBy("part").cogroup(two.groupBy("of")).applyInArrow(tidied(run), _GRAPH))


def _groups(spark, rows: int, each: int) -> int:
    """Groups of about GROUP bytes, and as many as there are shuffle partitions at least."""
    return max(partitions(spark), -(-rows * each // GROUP))


# --- the graph ------------------------------------------------------------------------------------


def _pairs_of(groups, shape: Shape, m: np.ndarray, codes: list[bytes], thr: np.ndarray, fresh: np.ndarray, k: int) -> pa.Table:
    """Pairs of the members of each group of which one at least is fresh, nearer than the farthest that v knows; the best k of each v."""
    out = [[], [], []]
    for at in groups:
        _, first, back = np.unique(m[at], return_index=True, return_inverse=True)
        new = np.bincount(back, fresh[at], len(first)) > 0
        if not new.any() or len(first) < 2:
            continue
        at = at[first]
        x = shape.points(b"".join([codes[i] for i in at.tolist()]))
        near = x @ x.T
        ok = (near > thr[at][:, None]) & (new[:, None] | new[None, :])
        np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        for o, a in zip(out, (m[at][i], m[at][j], near[i, j]), strict=True):
            o.append(a)
    v, w, s = (np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float32), strict=True))
    keep, _ = best(v, w, s, np.zeros(len(v), bool), k)
    return pa.table([pa.array(v[keep]), pa.array(w[keep]), pa.array(s[keep].astype(np.float32))], names=["v", "w", "s"])


def _runs(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows that agree in all columns, group by group."""
    order = np.lexsort(columns)
    change = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        change |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


def _first(nodes: DataFrame, shape: Shape, count: int, k: int) -> DataFrame:
    """Pairs of random blocks: every node is dealt into one block of about BLOCK for each deal."""
    blocks = -(-count // BLOCK)
    deal = F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))
    parts = _groups(nodes.sparkSession, count * DEALS, 2 * shape.dim + 40)
    dealt = nodes.select("node", "code", deal.alias("deal")).withColumn("block", F.pmod(F.xxhash64("node", "deal"), F.lit(blocks))).withColumn("part", F.pmod(F.xxhash64("block", "deal"), F.lit(parts)).cast("int"))

    def run(key, t: pa.Table) -> pa.Table:
        m = t["node"].to_numpy()
        return _pairs_of(_runs([t["block"].to_numpy(), t["deal"].to_numpy()]), shape, m, t["code"].to_pylist(), np.full(len(m), -np.inf), np.ones(len(m)), k)

    return dealt.groupBy("part").applyInArrow(tidied(run), _PAIR)


def _edges(graph: DataFrame) -> DataFrame:
    """(v, w, s, fresh) of all lists, with each node's code and the nearness of its last neighbour (thr)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = pa.Table.from_batches([batch])
        size, ids, sims, fresh = _lists(t)
        at = pa.array(np.repeat(np.arange(len(size)), size))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(ids), pa.array(sims), pa.array(fresh.astype(np.int8)), batch.column(1).take(at), batch.column(5).take(at)], names=["v", "w", "s", "fresh", "code", "thr"])

    return by_batch(graph.select("node", "code", "ids", "sims", "fresh", "thr"), run, "v long, w long, s float, fresh byte, code binary, thr float")


def _round(graph: DataFrame, shape: Shape, count: int, k: int, scratch: Scratch) -> DataFrame:
    """Pairs of neighbours of a node, and of nodes that have it as a neighbour."""
    known = graph.withColumn("thr", _last(k))
    backward = _edges(known).select(F.col("w").alias("u"), F.col("v").alias("m"), "fresh", "code", "thr")
    forward = _edges(known).select(F.col("v").alias("u"), F.col("w").alias("m"), "fresh").join(known.select(F.col("node").alias("m"), "code", "thr"), "m")
    crowds = scratch.save(backward.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))
    backward, forward = backward.withColumn("salt", F.lit(0)), forward.withColumn("salt", F.lit(0))
    if crowds.head(1):
        salts = crowds.select("u", F.ceil(F.col("n") / CROWD).cast("int").alias("salts"))
        backward = lookup(backward, salts, ["u"], crowds, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("m"), "salts").cast("int"), F.lit(0))).drop("salts")
        forward = forward.join(salts, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    names = ["u", "m", "fresh", "code", "thr", "salt"]
    parts = _groups(graph.sparkSession, 2 * k * count, 2 * shape.dim + 60)
    members = backward.select(*names).unionByName(forward.select(*names)).withColumn("part", F.pmod(F.xxhash64("u", "salt"), F.lit(parts)).cast("int"))

    def run(key, t: pa.Table) -> pa.Table:
        m, fresh = t["m"].to_numpy(), t["fresh"].to_numpy()
        return _pairs_of(_runs([t["u"].to_numpy(), t["salt"].to_numpy()]), shape, m, t["code"].to_pylist(), t["thr"].to_numpy(), fresh, k)

    return members.groupBy("part").applyInArrow(tidied(run), _PAIR)


def _last(k: int) -> Column:
    """Nearness of a full list's last entry; others take all."""
    return F.when(F.length("fresh") >= k, F.col("far")).otherwise(F.lit(float("-inf"))).cast("float")


@dataclass
class Index:
    """Different vectors (nodes), their neighbour graph, and what search() reads: each node's links with their codes."""

    nodes: DataFrame
    links: DataFrame
    shape: Shape
    count: int
    scratch: Scratch

    def search(self, queries: DataFrame, k: int = 20, breadth: int = 128, rounds: int = 4, pool: int = 256, same_ids: bool = True) -> DataFrame:
        """query_id, rank, vec_id and score of the k nearest found for each row of queries (query_id, embedding).

        Greedy search: a query keeps its `pool` best nodes and looks behind the `breadth` best that it hasn't yet,
        `rounds` times at most, or until none is left. It begins at its own node if its vector is in the index, else at the best of
        ENTRIES fixed nodes. Then the nearest are scored anew, exactly. same_ids: a query_id is a vec_id, which isn't its own answer.
        Rows that repeat an id and a vector count once; those that repeat an id with another vector each by itself.
        """
        spark, shape = queries.sparkSession, self.shape
        asked = self.scratch.save(_coded(queries.select("query_id", "embedding"), "query_id").distinct())
        per_key = self.scratch.save(asked.groupBy("mark").agg(F.count("*").alias("n"), F.first("vec").alias("vec")))
        starts = self.scratch.save(per_key.select("mark", "vec").join(self.nodes.select("mark", F.col("node").alias("own")), "mark", "left").withColumn("node", F.monotonically_increasing_id()))
        entries = self.nodes.select("node", "code").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()
        entry_ids, entry_codes = np.array([r.node for r in entries], np.int64), b"".join(bytes(r.code) for r in entries)

        def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, own = shape.codes(batch.column(1).to_pylist()), batch.column(2).to_pylist()
            near = shape.points(b"".join(codes), query=True) @ shape.points(entry_codes).T
            out = []
            for o, row in zip(own, near, strict=True):
                ids, sims = (entry_ids, row) if o is None else (np.array([o]), np.full(1, 2.0))
                order = np.lexsort((ids, -sims))
                out.append((ids[order].astype("<i8").tobytes(), sims[order].astype("<f4").tobytes(), bytes([1]) * len(ids)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), *(pa.array(list(c), pa.binary()) for c in zip(*out, strict=True)), pa.array([np.frombuffer(x[1], "<f4")[-1] for x in out], pa.float32()), pa.array(np.zeros(len(out), np.int64))], names=["node", "code", "ids", "sims", "fresh", "far", "changed"])

        pools = self.scratch.save(by_batch(starts.select("node", "vec", "own"), begin, _GRAPH))
        total = starts.count()
        parts = _groups(spark, total, 2 * shape.dim + 26 * pool)

        def front(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, ids, _, fresh = _lists(pa.Table.from_batches([batch]))
            go = opened(size, fresh, breadth)
            at = pa.array(np.repeat(np.arange(len(size)), size)[go])
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(5).take(at), pa.array(ids[go])], names=["q", "code", "thr", "u"])

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            q, thr = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            ids, codes = batch.column(3), batch.column(4)
            size = ids.value_lengths().to_numpy().astype(np.int64)
            x, y = shape.points(b"".join(codes.flatten().to_pylist())), shape.points(b"".join(batch.column(1).to_pylist()), query=True)
            row = np.repeat(np.arange(len(size)), size)
            s = np.concatenate([x[lo:hi] @ y[r] for r, (lo, hi) in enumerate(zip((np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True))]) if len(size) else np.zeros(0, np.float32)
            near = np.flatnonzero(s > thr[row])
            v, w, s = q[row][near], ids.flatten().to_numpy()[near], s[near]
            keep, _ = best(v, w, s, np.zeros(len(v), bool), pool)
            return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(w[keep]), pa.array(s[keep].astype(np.float32))], names=["v", "w", "s"])

        def settle(size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
            return np.where(opened(size, fresh, breadth), 0, fresh).astype(np.uint8)

        for _ in range(rounds):
            known = pools.withColumn("thr", _last(pool))
            frontier = by_batch(known.select("node", "code", "ids", "sims", "fresh", "thr"), front, "q long, code binary, thr float, u long")
            met = frontier.join(self.links, F.col("u") == F.col("node")).select("q", "code", "thr", "links", "codes")
            found = by_batch(met, score, _PAIR)
            before, pools = pools, _merged(pools, found, pool, parts, self.scratch, settle)
            self.scratch.drop(before)
            release(spark)
            if not int(pools.agg(F.sum("changed")).first()[0] or 0):
                break
        return self._exact(asked, per_key, starts, pools, k, same_ids)

    def _exact(self, asked: DataFrame, per_key: DataFrame, starts: DataFrame, pools: DataFrame, k: int, same_ids: bool) -> DataFrame:
        shape, most = self.shape, 2 * k + 24

        def first(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(b, "<i8")[:most] for b in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(ids)), [len(i) for i in ids]))
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], names=["q", "w"])

        chosen = by_batch(pools.select("node", "ids"), first, "q long, w long").unionByName(starts.where("own IS NOT NULL").select(F.col("node").alias("q"), F.col("own").alias("w"))).distinct()
        both = chosen.join(self.nodes.select(F.col("node").alias("w"), F.col("vec").alias("x"), "vec_ids"), "w").join(starts.select(F.col("node").alias("q"), F.col("vec").alias("y"), "mark"), "q").select("mark", "x", "y", "vec_ids")

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                s = (shape.values(batch.column(1).to_pylist()) * shape.values(batch.column(2).to_pylist())).sum(axis=1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(-s), batch.column(3)], names=["mark", "far", "vec_ids"])

        scored = by_batch(both, score, "mark string, far double, vec_ids array<long>")
        entry = F.transform("vec_ids", lambda i: F.struct(F.col("far").alias("far"), i.alias("vec_id")))
        lists = scored.select("mark", entry.alias("e")).groupBy("mark").agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, k + 1).alias("near"))
        joined = lookup(asked.select("query_id", "mark"), lists, ["mark"], per_key.select("mark", "n"))
        mine = F.filter("near", lambda e: e["vec_id"] != F.col("query_id")) if same_ids else F.col("near")
        ranked = joined.select("query_id", F.posexplode(F.slice(mine, 1, k)).alias("at", "e"))
        return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("e.far")).alias("score"))


def build(rows: DataFrame, k: int = 32, keep: int = 21, rounds: int = 14, still: float = 0.002) -> Index:
    """An index of all rows (vec_id, embedding) for the largest inner products.

    Rows without vec_id and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors shorter
    than the longest count as ending in zeros. Equal vectors are one node, which knows its `keep` smallest vec_ids: no answer of up to keep - 1 needs more.

    NN-descent: every node begins with its k best of random blocks. In each round the neighbours of a node, and the nodes
    that have it as a neighbour, are compared with each other unless both were before, and tell each other;
    a node keeps its k best. It ends after `rounds`, or when fewer than `still` of all entries change. A crowd that shares
    a neighbour meets in several groups of CROWD, so no group grows. Points get one more coordinate that gives all the same norm, so that inner products
    rank as distances. Links for the search: a node's neighbours and the 2 k nearest of those that have it as theirs.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    wide = 4 if rows.schema["embedding"].dataType.elementType == FloatType() else 8
    coded = scratch.save(_coded(rows.select("vec_id", "embedding"), "vec_id"))
    copies = scratch.save(coded.groupBy("mark").agg(F.count("*").alias("n"), F.first("vec").alias("vec")))
    longest, most = copies.agg(F.max(F.length("vec")), F.max("n")).first()
    shape = Shape(wide, (longest or wide) // wide, 1.0)
    salts = -(-(most or 1) // 4096)
    smallest = lambda c: F.slice(F.array_sort(c), 1, keep)
    ids = coded.groupBy("mark", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(smallest(F.collect_set("vec_id")).alias("some"))
    ids = ids.groupBy("mark").agg(smallest(F.flatten(F.collect_list("some"))).alias("vec_ids"))

    def normed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(norms(shape.values(batch.column(0).to_pylist())))], names=["norm"])

    top = by_batch(copies.select("vec"), normed, "norm double").agg(F.max("norm")).first()[0]
    shape = Shape(wide, shape.dim, top or 1.0)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = shape.codes(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "code"])

    nodes = copies.select("mark", "vec").join(ids, "mark").withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(by_batch(nodes.select("node", "vec", "mark", "vec_ids"), code, "node long, vec binary, mark string, vec_ids array<long>, code binary"))
    count = nodes.count()
    parts = _groups(spark, count, 2 * shape.dim + 8 + 26 * k)
    none = F.lit(b"")
    graph = nodes.select("node", "code", none.alias("ids"), none.alias("sims"), none.alias("fresh"), F.lit(float("-inf")).cast("float").alias("far"), F.lit(0).cast("long").alias("changed"))
    as_is = lambda size, fresh: fresh
    seen = lambda size, fresh: np.zeros(len(fresh), np.uint8)
    graph = _merged(graph, _first(nodes, shape, count, k), k, parts, scratch, as_is)
    for _ in range(rounds if count > 2 else 0):
        before, graph = graph, _merged(graph, _round(graph, shape, count, k, scratch), k, parts, scratch, seen)
        scratch.drop(before)
        release(spark)
        if int(graph.agg(F.sum("changed")).first()[0]) <= still * count * k:
            break
    edges = scratch.save(_edges(graph.withColumn("thr", F.lit(0.0).cast("float"))).select("v", "w", "s"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "v"))
    back = edges.withColumn("rank", rank).where(F.col("rank") <= 2 * k).select(F.col("w").alias("node"), F.col("v").alias("link"))
    every = edges.select(F.col("v").alias("node"), F.col("w").alias("link")).unionByName(back).distinct()
    links = every.join(nodes.select(F.col("node").alias("link"), "code"), "link").groupBy("node").agg(F.collect_list(F.struct("link", "code")).alias("e"))
    links = scratch.save(links.select("node", F.col("e.link").alias("links"), F.col("e.code").alias("codes")))
    release(spark)
    return Index(nodes, links, shape, count, scratch)


def nearest(rows: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows found with the largest inner product with each row that `asks` picks, itself excepted.

    Largest first, ties to the smaller vec_id; fewer where there are fewer. See build() and Index.search() for rows that take no part.
    """
    index = build(rows, keep=k + 1)
    return index.search(rows.where(asks).select(F.col("vec_id").alias("query_id"), "embedding"), k)
