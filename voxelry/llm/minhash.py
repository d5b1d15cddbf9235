"""Operator 2: near-duplicate documents by min-max hashing, banding and exact confirmation.

Each permutation gives two signature values, the least and the greatest hash of the set; equal
sets in both have the same chance as one min-hash, at half the evaluations. Documents with equal
shingle sets are one node from the start. Within a band's bucket every member is compared with the
bucket's smallest document; after the confirmed links are joined to components, only members of
buckets that still hold several components are compared across those components, in blocks: the
share of equal bytes of their signatures chooses, full sets decide, and each block tells only which
nodes it joins. So a group of copies costs one comparison a member, no pairs of a group are written
out, and no link between different texts is lost to a group's size.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, union
from ..operators.skew import lookup
from ..ship import by_batch, tidied
from ..storage import Scratch, partitions, release
from .textops import U64, Words, gather, mix, randoms, slices, window_hash, words

_SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands binary, sig binary"
#: Buckets beyond this many nodes, or shingles of all nodes, are compared in cells of two salts.
CELL, CELL_SHINGLES = 2048, 1 << 22
#: Bytes of a group of cells that one task loads, about.
GROUP = 32 << 20
#: Ids up to this many (32 MB) are sent to every executor to pick out rows of documents; more are joined by a shuffle.
BROADCAST_IDS = 4 << 20


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's shingles; a text of fewer words is one shingle, of none none."""
    counts = w.counts
    start = np.flatnonzero(w.room() >= size)
    hashes = window_hash(w.hash, start, size)
    bounds = np.searchsorted(start, w.first)
    whole = {}
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        whole |= dict(zip(short.tolist(), window_hash(w.hash, w.first[short], n), strict=True))
    return [np.array([whole[i]], U64) if i in whole else np.unique(hashes[a:b]) for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))]


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    return randoms(n, 77)[:, None] | U64(1), randoms(n, 7777)[:, None]


def signature(s: np.ndarray, permutations: int) -> np.ndarray:
    """Least and greatest value of each permutation, side by side."""
    a, b = _permutations(permutations)
    low, high = np.full(permutations, ~U64(0)), np.zeros(permutations, U64)
    for i in range(0, len(s), 2048):
        v = a * s[None, i : i + 2048] + b
        v ^= v >> U64(29)
        v *= U64(0xBF58476D1CE4E5B9)
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    each = sig.reshape(bands, rows)
    key = randoms(bands, 99).copy()
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + each[:, j])
    return key.view(np.int64)


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, keys, bytes_ = [], [], [], [], []
        for _, _, buf, offsets in slices(batch.column(1)):
            for s in shingle_sets(words(buf, offsets, lower=True), size):
                n.append(len(s))
                one.append(int(mix(s.sum(dtype=U64, keepdims=True)).view(np.int64)[0]) if len(s) else 0)
                two.append(int(mix(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True)).view(np.int64)[0]) if len(s) else 0)
                if len(s):
                    sig = signature(s, bands * rows // 2)
                    keys.append(band_keys(sig, bands, rows).tobytes())
                    bytes_.append((mix(sig) >> U64(56)).astype(np.uint8).tobytes())
                else:
                    keys.append(b"")
                    bytes_.append(b"")
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.binary()), pa.array(bytes_, pa.binary())], names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"])

    return by_batch(docs, run, _SIGNED)


def _exploded(classes: DataFrame, bands: int) -> DataFrame:
    """(band, key, node, n_shingles): a row for each band of each node."""
    schema = "band int, key long, node long, n_shingles long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, n = (np.repeat(batch.column(i).to_numpy(), bands) for i in (0, 1))
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), pa.array(keys), pa.array(node), pa.array(n)], names=["band", "key", "node", "n_shingles"])

    return by_batch(classes.select("node", "n_shingles", "bands"), run, schema)


def _cells(table: pa.Table):
    """Rows of each cell (band, key, a, b) of a table with more than one row."""
    columns = [table[k].to_numpy() for k in ("band", "key", "a", "b")]
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for v in columns:
        change[1:] |= v[order][1:] != v[order][:-1]
    bounds = [0, *np.flatnonzero(change).tolist(), len(order)]
    return [table.take(pa.array(order[lo:hi])) for lo, hi in zip(bounds, bounds[1:], strict=False) if hi - lo > 1]


def _close(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cell, of different components and fitting sizes, whose signatures are nearly alike enough; i ascends."""
    c, n, salt = (cell[k].to_numpy() for k in ("c", "n_shingles", "salt"))
    band, two = cell["band"][0].as_py(), cell["a"][0].as_py() != cell["b"][0].as_py()
    keys = np.frombuffer(b"".join(cell["bands"].to_pylist()), np.int64).reshape(len(c), -1)
    sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(len(c), -1)
    share = percent / 100
    least = (share - 5 * (share * (1 - share) / sig.shape[1]) ** 0.5) * sig.shape[1]  # five standard deviations below
    order = np.argsort(n, kind="stable")
    c, n, salt, keys, sig = c[order], n[order], salt[order], keys[order], sig[order]
    one, other = [], []
    for i in range(len(c) - 1):
        j = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // percent, "right")))
        j = j[(c[j] != c[i]) & ((salt[j] != salt[i]) if two else True)]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
        if len(j):  # a pair is the business of the first band that it shares
            j = j[(keys[j, :band] != keys[i, :band]).all(axis=1)]
            one.append(np.full(len(j), i))
            other.append(j)
    none = np.zeros(0, np.int64)
    return (order[np.concatenate(one)], order[np.concatenate(other)]) if one else (none, none)


def _linked(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) by the pairs of a cell whose full sets are similar enough: at most a row a node."""
    one, other = _close(cell, percent)
    if not len(one):
        return one, other
    node, sets = cell["node"].to_numpy(), [np.frombuffer(x, U64) for x in cell["set"].to_pylist()]
    size = np.array([len(x) for x in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    there, yes = np.zeros(len(every), bool), np.zeros(len(one), bool)
    for i in np.unique(one):
        pairs = np.flatnonzero(one == i)
        own = at[first[i] : first[i] + size[i]]
        there[own] = True
        for lo in range(0, len(pairs), 256):
            p = pairs[lo : lo + 256]
            j = other[p]
            hits = there[gather(at, first[j], size[j])]
            common = np.add.reduceat(hits, np.cumsum(size[j]) - size[j], dtype=np.int64)
            yes[p] = 100 * common >= percent * (size[i] + size[j] - common)
        there[own] = False
    if not yes.any():
        return one[:0], one[:0]
    seen, low = union(node[one[yes]], node[other[yes]])
    return seen[seen != low], low[seen != low]


def _across(open_: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(src, dst): links between components of the nodes that share a bucket, contracted to one a node and cell.

    In a large bucket only pairs with a member outside its largest component can link: those are dealt into blocks, all members
    into chunks, and each block meets each chunk in a cell. So a bucket of many copies and few others costs rows in
    proportion to its members. Signatures choose the nodes that may have a link in a cell; only their sets move there and decide.
    The number of groups follows the counted bytes.
    """
    per = open_.groupBy("band", "key", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    big = F.max_by(F.struct("c", "n", "shingles"), F.struct("n", -F.col("c")))
    count = per.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), big.alias("big"))
    count = count.select("band", "key", "n", "shingles", F.col("big.c").alias("big"), (F.col("n") - F.col("big.n")).alias("n_out"), (F.col("shingles") - F.col("big.shingles")).alias("s_out"))
    pieces = lambda n, s: F.expr(f"CASE WHEN n > {CELL} OR shingles > {CELL_SHINGLES} THEN greatest(ceil({n} * 2 / {CELL}), ceil({s} * 2 / {CELL_SHINGLES})) ELSE 0 END").cast("int")
    count = scratch.save(count.withColumn("blocks", pieces("n_out", "s_out")).withColumn("chunks", pieces("n", "shingles")))
    weight = lambda n, s: F.col(n) * 512 + F.col(s) * 8
    total = count.agg(F.sum(weight("n", "shingles") * F.greatest("blocks", F.lit(1)) + weight("n_out", "s_out") * F.col("chunks"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-int(total) // GROUP))
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    cell = lambda a, b, salt: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(salt).alias("salt"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<a:int,b:int,salt:int>>")
    outside = F.when(F.col("c") != F.col("big"), F.transform(every("chunks"), lambda j: cell(dealt(F.col("blocks"), 1), F.col("blocks") + j, 0))).otherwise(none)
    inside = F.transform(every("blocks"), lambda i: cell(i, F.col("blocks") + dealt(F.col("chunks"), 2), 1))
    cells = F.when(F.col("blocks") > 0, F.concat(outside, inside)).otherwise(F.array(cell(F.lit(0), F.lit(0), 0)))
    placed = (
        lookup(open_, count.select("band", "key", "big", "blocks", "chunks"), ["band", "key"], count.select("band", "key", "n")).withColumn("cell", F.explode(cells))
        .select("band", "key", "node", "c", "n_shingles", "cell.*").withColumn("part", F.pmod(F.xxhash64("band", "key", "a", "b"), F.lit(parts)).cast("int"))
    )
    full = placed.join(classes.select("node", "bands", "sig"), "node").select("part", "band", "key", "a", "b", "salt", "node", "c", "n_shingles", "bands", "sig")

    def flag(_, table):
        found = [cell.take(pa.array(np.unique(np.concatenate(pairs)))) for cell in _cells(table) if len((pairs := _close(cell, percent))[0])]
        return pa.concat_tables(found) if found else table.slice(0, 0)

    def verify(_, table):
        found = [_linked(cell, percent) for cell in _cells(table)]
        pair = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
        return pa.table([pa.array(p, pa.int64()) for p in pair], names=["src", "dst"])

    flagged = scratch.save(full.groupBy("part").applyInArrow(tidied(flag), full.schema))
    sets = scratch.save(_sets(_picked(docs, scratch.save(flagged.select(F.col("node").alias("doc_id")).distinct()), "left_semi"), size))
    return flagged.join(sets.withColumnRenamed("doc_id", "node"), "node").groupBy("part").applyInArrow(tidied(verify), "src long, dst long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [s.tobytes() for _, _, buf, offsets in slices(batch.column(1)) for s in shingle_sets(words(buf, offsets, lower=True), size)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "set"])

    return by_batch(docs, run, "doc_id long, set binary")


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of documents whose doc_id is (left_semi) or isn't (left_anti) in a written table of ids; its size is counted."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (src, dst) whose full sets are similar enough: 100 * intersection >= percent * union."""
    wanted = scratch.save(pairs.select(F.col("src").alias("doc_id")).unionByName(pairs.select(F.col("dst").alias("doc_id"))).distinct())
    sets = scratch.save(_sets(_picked(docs, wanted, "left_semi"), size))
    both = pairs.join(sets.select(F.col("doc_id").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("doc_id").alias("dst"), F.col("set").alias("b")), "dst")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    found = scratch.save(by_batch(both.select("src", "dst", "a", "b"), run, "src long, dst long"))
    scratch.drop(sets)
    return found


def _once(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Documents with each doc_id (but null) once, with the smallest of its texts; the ids that repeat and how often, if any do."""
    repeated = scratch.save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1"))
    if not repeated.head(1):
        return docs, None
    one = _picked(docs, repeated.select("doc_id"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return _picked(docs, repeated.select("doc_id"), "left_anti").unionByName(one), repeated


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents.

    Texts are lower-cased (A-Z) and cut into words; a document's set holds its different shingles
    of `size` words, the whole sequence if it has fewer, nothing if it has no words or no text.
    Two documents link if 100 * intersection >= percent * union of their sets (64-bit hashes);
    empty sets link with nothing. component_id is the smallest doc_id reachable, itself included;
    kept is doc_id = component_id. Rows that repeat a doc_id are one document with the smallest
    non-null of their texts, and give a row each; a null doc_id links with nothing and is kept, its
    component_id null. bands * rows signature values, of half as many permutations, choose the
    candidates: a pair at similarity s is missed with probability (1 - s**rows)**bands. Those of a
    bucket's pairs that aren't with its smallest document also need signatures that agree in no
    less than five standard deviations below the threshold (3 in 10 million at the threshold).
    """
    scratch = Scratch(docs.sparkSession)
    docs, repeated = _once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    signed = scratch.save(_signed(docs, size, bands, rows))
    # nodes: the smallest document of each different set
    one = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.save(one.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    hashed = _exploded(classes, bands)
    crowded = scratch.save(hashed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    members = scratch.save(lookup(hashed, crowded.select("band", "key", "hub"), ["band", "key"], crowded.select("band", "key", "n")))
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    sizes = classes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("n_a"))
    first = scratch.save(members.where("node <> hub").select("hub", "node", F.col("n_shingles").alias("n_b")).distinct().join(sizes, "hub").where(fits).select(F.col("hub").alias("src"), F.col("node").alias("dst")))
    links = _confirmed(first, docs, size, percent, scratch)
    release(docs.sparkSession)
    joined = components(links, scratch)
    # buckets that still hold several components: their members, across components
    named = members.join(joined.withColumnRenamed("component", "found"), "node", "left").withColumn("c", F.coalesce("found", "node")).drop("found")
    split = scratch.save(named.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "key", "n"))
    open_ = scratch.save(lookup(named, split.select("band", "key"), ["band", "key"], split).select("band", "key", "node", "c", "n_shingles"))
    more = scratch.save(_across(open_, classes, docs, size, percent, scratch))
    final = components(links.unionByName(more), scratch)
    of_set = classes.join(final, "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "node").alias("component"))
    sizes = scratch.save(signed.groupBy("fp1", "fp2", "n_shingles").agg(F.count("*").alias("n")))
    rows_ = lookup(signed.select("doc_id", "fp1", "fp2", "n_shingles"), of_set, ["fp1", "fp2", "n_shingles"], sizes, "left")
    if repeated is not None:
        rows_ = rows_.join(repeated, "doc_id", "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    component = F.coalesce("component", "doc_id")
    return rows_.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of documents whose component keeps them, columns unchanged.

    Kept are the rows of the smallest doc_id of each component of near_duplicates(): texts without
    words, null texts and null ids always, repeated rows of a kept id all. No rows: none.
    """
    gone = Scratch(docs.sparkSession).save(near_duplicates(docs, **how).where("NOT kept").select("doc_id").distinct())
    return _picked(docs, gone, "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))
