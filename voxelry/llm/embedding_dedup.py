"""Operator 8: near-duplicate vectors by random-hyperplane signs in several tables and exact cosines."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..operators.graph import components, union
from ..operators.skew import lookup
from ..ship import by_batch, ship, tidied
from ..storage import Scratch, partitions

#: Buckets beyond this many vectors are compared in cells of two salts.
CELL = 4096
#: Buckets of up to so many vectors are compared side by side, so many pairs at a time.
SMALL, PAIRS = 32, 1 << 15
_ROWS = 256
#: Bytes of rows that one group of a task loads, about.
GROUP = 32 << 20


def settings(nodes: int, least: float, missed: float) -> tuple[int, int]:
    """Signs in a code and number of tables for so many different vectors.

    As many signs as keep the buckets of unrelated vectors at about one each, however many there
    are, and as many tables as miss a pair at the threshold with a probability of at most `missed`.
    """
    bits = min(30, max(8, (max(1, nodes) - 1).bit_length()))
    agree = (1 - np.arccos(least) / np.pi) ** bits
    return bits, int(np.ceil(np.log(missed) / np.log1p(-agree)))


@cache
def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, tables, bits]).standard_normal((dim, tables * bits))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, bounds, and which lists are usable: not null, all finite, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    v = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
    nonzero = np.concatenate([[0], np.cumsum(v != 0)])
    good = (bad[bounds[1:]] == bad[bounds[:-1]]) & (nonzero[bounds[1:]] > nonzero[bounds[:-1]])
    return v, bounds, good


def _coded(rows: DataFrame, tables: int, bits: int, single: bool) -> DataFrame:
    """vec_id, label, the vector as floats or doubles and its sign codes, 4 bytes a table; unusable rows have no vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, bounds, good = _vectors(batch.column(1))
        good &= batch.column(2).is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        size = np.diff(bounds)
        codes = np.zeros((len(size), tables), "<i4")
        for dim in np.unique(size[good]).tolist():
            at = np.flatnonzero(good & (size == dim))
            signs = v[bounds[at][:, None] + np.arange(dim)] @ planes(dim, tables, bits) > 0
            codes[at] = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits)).astype(np.int64)
        stored = v.astype("<f4" if single else "<f8")
        blobs = [stored[a:b].tobytes() if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        flat = pa.array([c.tobytes() for c in codes], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.string()), pa.array(blobs, pa.binary()), flat], names=["vec_id", "label", "vec", "codes"])

    return by_batch(rows, run, "vec_id long, label string, vec binary, codes binary")


def _hashed(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, label, dim, table, code): a row for each table of each node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
        codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4")
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(codes)], names=["node", "label", "dim", "table", "code"])

    return by_batch(nodes.select("node", "label", "dim", "codes"), run, "node long, label string, dim int, table int, code int")


def _earlier(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the codes of each pair agree in a table before this one."""
    return ((codes[i] == codes[j]) & (np.arange(codes.shape[1]) < table[:, None])).any(axis=1)


def together(order: np.ndarray, first: np.ndarray, size: np.ndarray, x: np.ndarray, codes: np.ndarray, table: np.ndarray, least: float):
    """Linked pairs (i, j) of small buckets order[first:first + size], and whether this is the first table they share."""
    for m in np.unique(size).tolist():
        idx = order[first[size == m][:, None] + np.arange(m)]
        a, b = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(a))
        for lo in range(0, len(idx), step):
            i, j = idx[lo : lo + step, a].reshape(-1), idx[lo : lo + step, b].reshape(-1)
            near = np.einsum("ij,ij->i", x[i], x[j]) >= least
            i, j = i[near], j[near]
            yield i, j, ~_earlier(codes, i, j, table[i])


def compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, codes: np.ndarray, salt: np.ndarray, table: int, two: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a cell, by copies of the others, and the smallest id it reaches in the cell.

    x: unit vectors. A pair counts only in the first table whose codes agree. two: the cell is of
    two different salts, and only pairs of one with the other are its own.
    """
    n = len(ids)
    links, label = np.zeros(n, np.int64), np.arange(n)
    found_i, found_j = [], []
    for lo in range(0, n, _ROWS):
        i, j = np.nonzero(x[lo : lo + _ROWS] @ x.T >= least)
        i += lo
        own = i != j
        if two:
            own &= salt[i] != salt[j]
        i, j = i[own], j[own]
        found_i.append(i[i < j].astype(np.int32))
        found_j.append(j[i < j].astype(np.int32))
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= codes[i, t] != codes[j, t]
        links += np.bincount(i[new], copies[j[new]], n).astype(np.int64)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while len(i):  # smallest rank over links, then over what that one reached
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[order][label]
        if (label == before).all():
            break
    return links, ids[order][label]


def near_duplicates(rows: DataFrame, least: float = 0.93, missed: float = 4e-4, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings (vec_id, embedding, label).

    Two vectors with equal, non-null labels and lengths link if they share a sign code in some table
    and their cosine in double precision is at least `least`; a pair at the border itself is missed
    with a probability of at most `missed` (see settings()). Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without label or vec_id, link with nothing:
    no links, their own component, kept. Rows that repeat a vector link with each other, whatever
    their vec_id; rows that repeat a vec_id with other vectors or labels are compared each by itself.
    n_links counts other rows; component_id is the smallest vec_id reachable; kept is vec_id = component_id.

    Equal vectors are one node with a number of copies. Buckets of one are dropped before vectors
    move; buckets beyond `cell` nodes are dealt out by salt into cells that meet every pair once.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    single = rows.schema["embedding"].dataType.elementType == FloatType()
    bits, tables = settings(rows.count(), least, missed)
    coded = scratch.save(_coded(rows.select("vec_id", "embedding", "label"), tables, bits, single).withColumn("mark", F.sha2("vec", 256)))
    nodes = scratch.save(coded.where("vec IS NOT NULL").groupBy("label", "mark").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("codes").alias("codes")).withColumn("dim", F.length("vec")).withColumn("node", F.monotonically_increasing_id()))
    hashed = _hashed(nodes, tables)
    key = ["label", "dim", "table", "code"]
    crowded = scratch.save(hashed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    salts = crowded.select(*key, F.when(F.col("n") > cell, F.ceil(F.col("n") * 2 / cell)).otherwise(1).cast("int").alias("salts"))
    cells = crowded.agg(F.sum(F.col("n") * F.when(F.col("n") > cell, F.ceil(F.col("n") * 2 / cell)).otherwise(1))).first()[0] or 0
    each = (nodes.agg(F.max("dim")).first()[0] or 0) + 4 * tables + 64
    parts = max(partitions(spark), -(-int(cells) * each // GROUP))
    placed = (
        lookup(hashed, salts, key, crowded).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("node", "label", "dim", "table", "code", "salt", F.least("salt", "other").alias("a"), F.greatest("salt", "other").alias("b"))
        .withColumn("part", F.pmod(F.xxhash64("label", "dim", "table", "code", "a", "b"), F.lit(parts)).cast("int"))
    )
    full = placed.join(nodes.select("node", "copies", "vec", "codes"), "node")

    def run(key_, table):
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        columns = [label, *(table[c].to_numpy() for c in ("dim", "table", "code", "a", "b"))]
        order = np.lexsort(columns[::-1])
        change = np.ones(len(order), bool)
        change[1:] = False
        for c in columns:
            change[1:] |= c[order][1:] != c[order][:-1]
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(order)))
        ids, copies, salt = (table[c].to_numpy() for c in ("node", "copies", "salt"))
        vec, codes = table["vec"].to_pylist(), np.frombuffer(b"".join(table["codes"].to_pylist()), "<i4").reshape(-1, tables)
        out = [[], [], []]

        def tell(at: np.ndarray, links: np.ndarray, reached: np.ndarray) -> None:
            some = (links > 0) | (reached != at)
            for o, v in zip(out, (at[some], links[some], reached[some]), strict=True):
                o.append(v)

        def unit(at) -> np.ndarray:
            x = np.frombuffer(b"".join([vec[k] for k in at.tolist()]), "<f4" if single else "<f8").reshape(len(at), -1).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            at = order[lo : lo + n]
            links, reached = compare(ids[at], copies[at], unit(at), codes[at], salt[at], int(columns[2][at[0]]), bool(columns[4][at[0]] != columns[5][at[0]]), least)
            tell(ids[at], links, reached)
        few = (size >= 2) & (size <= SMALL)
        dims = columns[1][order[first]]
        for dim in np.unique(dims[few]).tolist():  # a vector's length in bytes
            own = few & (dims == dim)
            rows_ = order[np.repeat(own, size)]
            place = np.zeros(len(order), np.int64)
            place[rows_] = np.arange(len(rows_))
            starts = np.concatenate([[0], np.cumsum(size[own])[:-1]])
            x, links, pairs = unit(rows_), np.zeros(len(rows_), np.int64), []
            two = columns[4][rows_] != columns[5][rows_]  # a large bucket's cell that is small by chance
            for i, j, new in together(np.arange(len(rows_)), starts, size[own], x, codes[rows_], columns[2][rows_], least):
                new &= ~two[i] | (salt[rows_][i] != salt[rows_][j])
                np.add.at(links, i[new], copies[rows_][j[new]])
                np.add.at(links, j[new], copies[rows_][i[new]])
                pairs.append((ids[rows_][i], ids[rows_][j]))
            reached = ids[rows_].copy()
            if pairs and sum(len(a) for a, _ in pairs):
                seen, low = union(*(np.concatenate(p) for p in zip(*pairs, strict=True)))
                hit = np.isin(ids[rows_], seen)
                reached[hit] = low[np.searchsorted(seen, ids[rows_][hit])]
            tell(ids[rows_], links, reached)
        a = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table([pa.array(v, pa.int64()) for v in a], names=["node", "links", "reached"])

    met = scratch.save(full.groupBy("part").applyInArrow(tidied(run), "node long, links long, reached long"))
    found = components(met.where("node <> reached").select(F.col("node").alias("src"), F.col("reached").alias("dst")), scratch)
    found = scratch.save(found)
    named = found.join(nodes.select("node", "smallest"), "node").groupBy("component").agg(F.min("smallest").alias("name"))
    of_node = nodes.select("label", "mark", "node", "copies", "smallest").join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found.join(named, "component"), "node", "left")
    of_node = scratch.save(of_node.select("label", "mark", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "smallest").alias("component")))
    per_vector = of_node.select("label", "mark", F.col("copies").alias("n"))
    joined = lookup(coded.select("vec_id", "label", "mark"), of_node.drop("copies"), ["label", "mark"], per_vector, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
