"""Operator 13: the trie of conversations' prefixes, by a global sort of turn arrays and a sweep over it."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship, tidied
from ..storage import Scratch

#: Bytes of a turn's key: the start of a SHA-256 of its role and text.
KEY = 16
#: Bytes of turn keys sorted and swept by one task, and of ids in one part of a long run.
SHARE, BLOB = 16 << 20, 1 << 20
NONE = hashlib.sha256(b"").hexdigest()

_ARRAYS = ("n", "least", "children", "leaves", "saved")
_SWEPT = "kind int, part int, side int, seq long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, sizes array<long>, " + ", ".join(f"`{c}` array<long>" for c in _ARRAYS) + ", ends array<string>, blob binary"
_STITCHED = "kind int, part int, side int, depth long, node long, deepest boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
#: Kinds of rows: nodes whose parent is known, nodes below an open path, open paths, parts of a run of ids; stitched nodes, and the places where they lie.
CLOSED, BELOW, OPEN, RUN = range(4)
NODE, PLACE = range(2)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_arrays(turns: DataFrame, by: Column | None = None) -> DataFrame:
    """conv_id and seq, its turns in order: an array of structs with the key and the text's bytes.

    turns: conv_id, turn, role, text; null turns come first, turns of one number in the order of their keys (rows that
    repeat are turns of their own), null role and text count as empty, rows without conv_id are left out. Texts stay
    where they are: only keys move. by: a value that conv_id decides; conversations that share it lie in one partition.
    A conversation's keys are one row: 16 bytes a turn.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("one"))
    if by is not None:
        rows = rows.withColumn("by", by).repartition("by")
    keys = ["conv_id"] if by is None else ["by", "conv_id"]
    seq = F.transform(F.array_sort(F.collect_list("one")), lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes")))
    return rows.groupBy(*keys).agg(seq.alias("seq"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id and seq of every conversation c: the first h turns of conversation c - c mod `every`, then its own after its first h; h = crc32(decimal c) mod `most`.

    The rest of a division is never negative. A conversation to start from that isn't there has no turns.
    """
    own = turn_arrays(turns, F.col("conv_id") - F.pmod("conv_id", F.lit(every)))
    together = own.groupBy("by").agg(F.collect_list(F.struct("conv_id", "seq")).alias("all"))  # `every` of them at most
    start = F.coalesce(F.get(F.filter("all", lambda x: x["conv_id"] == F.col("by")), F.lit(0))["seq"], F.expr("array()").cast(own.schema["seq"].dataType))
    one = together.select(start.alias("start"), F.explode("all").alias("one")).select("start", "one.conv_id", "one.seq")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    return one.select("conv_id", F.concat(F.slice("start", F.lit(1), h), F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))).alias("seq"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    if a == b:
        return len(a) // KEY
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = np.flatnonzero(x != y)
    return int(differ[0] if len(differ) else n) // KEY


def _batches(schema: str, rows: dict, size: int = 1 << 15):
    """Record batches of columns given as lists; columns that are missing are null."""
    fields = [f.strip().replace("`", "").split(" ") for f in schema.split(", ")]
    n = len(next(iter(rows.values())))
    for lo in range(0, n, size):
        m = min(size, n - lo)
        yield pa.RecordBatch.from_arrays([pa.array(rows[name][lo : lo + m], _ARROW[kind]) if name in rows else pa.nulls(m, _ARROW[kind]) for name, kind in fields], names=[name for name, _ in fields])


class _Sweep:
    """A stack of open nodes over sorted paths. A node's numbers are of what has been seen below it."""

    def __init__(self) -> None:
        self.depth, self.parent, self.size = array("q"), array("q"), array("q")
        self.n, self.least, self.children, self.leaves, self.saved = (array("q") for _ in range(5))
        self.stack: list[int] = []
        self.path = b""

    def push(self, size: int) -> None:
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.depth.append(len(self.stack))
        self.stack.append(len(self.size))
        self.size.append(size)
        for a in (self.n, self.children, self.leaves, self.saved):
            a.append(0)
        self.least.append(np.iinfo(np.int64).max)

    def to(self, path: bytes, sizes, close) -> None:
        """Close the nodes that end before this path, and open its own: those deeper than the longest common prefix with the path before."""
        if not self.stack:
            self.push(0)
        common = _common(self.path, path)
        while len(self.stack) > common + 1:
            close(self.stack.pop())
        for size in sizes[common:]:
            self.push(size)
        self.path = path

    def gather(self, i: int) -> None:
        """Tell the parent of a node its members."""
        p = self.parent[i]
        if p >= 0:
            self.n[p] += self.n[i]
            self.least[p] = min(self.least[p], self.least[i])

    def settle(self, i: int) -> None:
        """A node's leaves and savings, now that all below it is known, and its parent's."""
        if not self.children[i]:
            self.leaves[i] = 1
        self.saved[i] += (self.n[i] - 1) * self.size[i]
        p = self.parent[i]
        if p >= 0:
            self.children[p] += 1
            self.leaves[p] += self.leaves[i]
            self.saved[p] += self.saved[i]


def _run(part: int, side: int, ids: list[int]) -> list[tuple]:
    """Ids of a run that may go on in another partition, as text, in parts."""
    out, text, size = [], [], 0
    for i in ids:
        text.append(str(i))
        size += len(text[-1]) + 1
        if size >= BLOB:
            out.append((RUN, part, side, len(out), ",".join(text).encode()))
            text, size = [], 0
    if text:
        out.append((RUN, part, side, len(out), ",".join(text).encode()))
    return out


def _sweep(batches):
    """Nodes of a partition's sorted paths. Those on its first and on its last path may go on in other partitions: they are told as open paths."""
    s, first, ends, ids, part, sizes, runs = _Sweep(), None, {}, [], 0, [], []

    def close(i: int) -> None:
        s.gather(i)
        if i > first:
            s.settle(i)

    def end_run(last: bool) -> None:
        """The conversations that end at the deepest node of the path."""
        node = s.stack[-1]
        if node == first or last:
            runs.extend(_run(part, 0 if node == first else 1, ids))
        else:
            ends[node] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        ids.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        for conv, path, row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if first is None or path != s.path:
                if first is not None:
                    end_run(False)
                s.to(path, row, close)
                if first is None:
                    first, sizes, first_path = len(row), row, path
                last_row = row
            node = s.stack[-1]
            s.n[node] += 1
            s.least[node] = min(s.least[node], conv)
            ids.append(conv)
    if first is None:
        return
    end_run(True)
    for i in reversed(s.stack):
        s.gather(i)
    shared = sum(i <= first for i in s.stack)  # of the last path with the first
    of = lambda nodes: {c: [[getattr(s, c)[i] for i in nodes]] for c in _ARRAYS}
    paths = [(0, first_path, sizes, range(first + 1))] + ([(1, s.path, last_row, s.stack[shared:])] if shared < len(s.stack) else [])
    for side, path, size, nodes in paths:
        yield from _batches(_SWEPT, {"kind": [OPEN], "part": [part], "side": [side], "path": [path], "sizes": [size], "ends": [[ends.get(i) for i in nodes]], **of(nodes)})
    for row in runs:
        yield from _batches(_SWEPT, {k: [v] for k, v in zip(("kind", "part", "side", "seq", "blob"), row, strict=True)})
    total = len(s.size)
    depth, parent, least = (np.frombuffer(a, np.int64) for a in (s.depth, s.parent, s.least))
    last = np.zeros(total, bool)
    last[s.stack] = True
    own = np.flatnonzero((np.arange(total) > first) & ~last)
    if not len(own):
        return
    up = parent[own]
    below = (up <= first) | last[up]
    hashes = [ends.get(i, NONE) for i in own.tolist()]
    for lo in range(0, len(own), 1 << 15):
        k, u, b = own[lo : lo + (1 << 15)], up[lo : lo + (1 << 15)], below[lo : lo + (1 << 15)]
        yield from _batches(_SWEPT, {
            "kind": np.where(b, BELOW, CLOSED), "part": np.full(len(k), part), "side": np.where(u <= first, 0, 1), "conv_id": least[k], "depth": depth[k], "parent_conv_id": least[u],
            "n_convs": np.frombuffer(s.n, np.int64)[k], "n_children": np.frombuffer(s.children, np.int64)[k], "n_leaves": np.frombuffer(s.leaves, np.int64)[k], "saved_tokens": np.frombuffer(s.saved, np.int64)[k],
            "ends_sha256": hashes[lo : lo + (1 << 15)],
        })


def _stitch(batches):
    """One sweep over the open paths of all partitions, in order: two paths each at most."""
    s, places, ends = _Sweep(), [], {}
    for batch in batches:
        for r in batch.to_pylist():
            s.to(r["path"], r["sizes"], s.settle)
            start = len(s.stack) - len(r["n"])
            for k, node in enumerate(s.stack[start:]):
                s.n[node] += r["n"][k]
                s.least[node] = min(s.least[node], r["least"][k])
                s.children[node] += r["children"][k]
                s.leaves[node] += r["leaves"][k]
                s.saved[node] += r["saved"][k]
                if r["ends"][k]:  # a run within one partition
                    ends[node] = r["ends"][k]
                places.append((PLACE, r["part"], r["side"], start + k, node, start + k == len(s.stack) - 1))
    while s.stack:
        s.settle(s.stack.pop())
    if not places:
        return
    n = len(s.size)
    yield from _batches(_STITCHED, {
        "kind": [NODE] * n, "node": list(range(n)), "depth": s.depth.tolist(), "conv_id": s.least.tolist(), "parent_conv_id": [s.least[p] if p >= 0 else None for p in s.parent],
        "n_convs": s.n.tolist(), "n_children": s.children.tolist(), "n_leaves": s.leaves.tolist(), "saved_tokens": s.saved.tolist(), "ends_sha256": [ends.get(i) for i in range(n)],
    })
    columns = [list(c) for c in zip(*places, strict=True)]
    yield from _batches(_STITCHED, dict(zip(("kind", "part", "side", "depth", "node", "deepest"), columns, strict=True)) | {"conv_id": [s.least[node] for node in columns[4]]})


def _hashes(batches):
    """SHA-256 of each node's ids, whose parts come in order."""
    node, digest = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != node:
                if digest is not None:
                    yield told()
                node, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(blob.as_buffer())
    if digest is not None:
        yield told()


def trie(arrays: DataFrame, scratch: Scratch | None = None, share: int = SHARE) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, each once, and seq as turn_arrays() gives it).

    A node is a different sequence of first turns; the root has none. Per node: conv_id, its smallest member; depth;
    parent_conv_id, the parent's (root: null); n_convs, members; n_children; n_leaves, childless nodes of its subtree;
    saved_tokens, over its subtree, each node's (n_convs - 1) times bytes of its last text; ends_sha256, of the decimal
    conv_ids of members that end there, ascending, joined by commas. Conversations without turns are members of the
    root alone; no conversations: no rows. Turns are equal if 128 bits of their SHA-256 are.

    Paths (keys one behind the other) and ids are sorted over all partitions, whose number follows their counted bytes;
    the longest common prefix with the path before tells what to close and open on a partition's stack. Nodes on a
    partition's first and last path stay open: one task stitches these, two paths a partition. Equal paths lie in
    as many partitions as they need; the ids that end at their node come together as texts of 1 MB, for its hash.
    """
    spark = arrays.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    path = F.unhex(F.array_join(F.transform("seq", lambda x: F.hex(x["key"])), ""))
    flat = scratch.save(arrays.select("conv_id", path.alias("path"), F.transform("seq", lambda x: x["bytes"]).alias("sizes")))
    size = int(flat.agg(F.sum(F.length("path") + KEY)).first()[0] or 0)
    ranged = flat.repartitionByRange(max(1, -(-size // share)), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = scratch.save(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "path", "sizes").mapInArrow(tidied(_sweep), _SWEPT))
    open_ = swept.where(F.col("kind") == OPEN).select("part", "side", "path", "sizes", "ends", *_ARRAYS)
    stitched = scratch.save(open_.repartition(1).sortWithinPartitions("part", "side").mapInArrow(tidied(_stitch), _STITCHED))
    nodes, places = stitched.where(F.col("kind") == NODE), stitched.where(F.col("kind") == PLACE)
    runs = swept.where(F.col("kind") == RUN).select("part", "side", "seq", "blob").join(places.where("deepest").select("part", "side", "node"), ["part", "side"])
    hashes = runs.repartition("node").sortWithinPartitions("node", "part", "side", "seq").select("node", "blob").mapInArrow(tidied(_hashes), "node long, ends_sha256 string")
    top = nodes.join(hashes.withColumnRenamed("ends_sha256", "over"), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "over", F.lit(NONE)))
    below = swept.where(F.col("kind") == BELOW).withColumn("up", F.col("depth") - 1).drop("parent_conv_id")
    named = below.join(places.select("part", "side", F.col("depth").alias("up"), F.col("conv_id").alias("parent_conv_id")), ["part", "side", "up"])
    return swept.where(F.col("kind") == CLOSED).select(*COLUMNS).unionByName(named.select(*COLUMNS)).unionByName(top.select(*COLUMNS))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as rebuilt() makes them; see both."""
    return trie(rebuilt(turns))
