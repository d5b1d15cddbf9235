"""Operator 9: quality rules, with language-specific bands of n-gram perplexity.

The language model counts sequences of four characters (code points; ASCII letters without case, a run
of blanks or of one ASCII symbol as one), for each language its own. Spark counts them over all texts
and derives the modified Kneser-Ney probabilities by aggregates and joins on the sequences, so the table
is partitioned and grows with the corpus. It is stored as sorted arrays of the sequences' hashes with
their bits, one row for each range of the hash space. Up to BROADCAST_SEQUENCES these arrays go to every
executor and texts are measured where they are read; beyond it chunks of texts ask the ranges for their
different sequences and get the bits in the order they asked. Both give the same result.
A sequence is a (model, first two characters) and b (last two), 21 bits a character; in lower orders
the leading characters are 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship, tidied
from ..storage import Scratch, text_bytes
from .codec import cuts, pack_sorted, unpack_sorted
from .textops import LOWER, SPACE, U64, Words, mix, segment_hash, slices, window_hash, words

ORDER = 4
#: Bits of a character in a and b.
WIDE = 21
_CHAR = (1 << WIDE) - 1
#: Bytes of text in a chunk, about.
CHUNK = 4 << 20
#: Bytes of text that are counted, and that are measured, at a time.
COUNTED, MEASURED = 1 << 20, 1 << 19
#: Sequences in a row of the model, about.
RANGE = 1 << 18
#: Sequences of the model up to which it is broadcast: 4 million, 48 MB.
BROADCAST_SEQUENCES = 4 << 20
#: Rows of content hashes up to which they are broadcast: 4 million, 32 MB.
BROADCAST_HASHES = 4 << 20
#: White space and ASCII symbols: a run of one of them counts once, as its length says nothing of the language.
_ONCE = np.array([k < 127 and not chr(k).isalnum() for k in range(128)])
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = "doc_id long, hash long, model int, " + "".join(f"{c} long, " for c in _BASE) + "base_failed boolean, bits double"
_ASK = "part int, chunk long, n long, keys binary"
_TELL = "part int, chunk long, bits binary"


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and each text's first; white space is a blank, of runs of a blank or symbol only the first, leading blanks left out."""
    head = (buf & 0xC0) != 0x80
    at = np.flatnonzero(head)
    c = np.where(SPACE[buf], np.uint8(32), LOWER[buf])[at].astype(np.int64)
    far = np.flatnonzero(c >= 0x80)
    if len(far):
        size, place, v = np.diff(np.append(at, len(buf)))[far], at[far], c[far]
        v &= np.where(v >= 0xF0, 7, np.where(v >= 0xE0, 15, 31))
        for k in (1, 2, 3):
            more = size > k
            v[more] = v[more] << 6 | (buf[place[more] + k] & 63)
        c[far] = v & _CHAR
    first = np.concatenate([[0], np.cumsum(head)])[offsets]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != c[:-1]) | ~_ONCE[np.minimum(c[1:], 127)]
    start = first[:-1][first[:-1] < len(c)]
    keep[start] = c[start] != 32  # a text's leading blanks are those before it
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def sequences(buf: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
    """The sequence that ends at each character, as a number of this chunk; each text's first; what turns numbers into (a, b).

    A text begins after three blanks, which aren't predicted themselves.
    """
    c, first = characters(buf, offsets)
    there = np.zeros(1 << WIDE, bool)
    there[c] = there[32] = True
    chars = np.flatnonzero(there)
    to = np.zeros(1 << WIDE, np.int32)
    to[chars] = np.arange(len(chars))
    bits = max(1, (len(chars) - 1).bit_length())
    c, blank = to[c].astype(np.int64), int(to[32])
    place = np.arange(len(c)) - np.repeat(first[:-1], np.diff(first))

    def previous(back: int) -> np.ndarray:
        out = np.full(len(c), blank, np.int64)
        out[back:] = c[:-back] if back < len(c) else c[:0]
        out[place < back] = blank
        return out

    left = (np.repeat(model.astype(np.int64), np.diff(first)) << bits | previous(3)) << bits | previous(2)
    right = previous(1) << bits | c
    if int(model.max(initial=0)).bit_length() + ORDER * bits < 63:
        code, lefts, rights, width = left << 2 * bits | right, None, None, 1 << 2 * bits
    else:  # too many different characters for one number
        lefts, i = np.unique(left, return_inverse=True)
        rights, j = np.unique(right, return_inverse=True)
        width = max(1, len(rights))
        code = i * width + j

    def split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = code // width, code % width
        x, y = (x, y) if lefts is None else (lefts[x], rights[y])
        low = (1 << bits) - 1
        return x >> 2 * bits << 2 * WIDE | chars[x >> bits & low] << WIDE | chars[x & low], chars[y >> bits] << WIDE | chars[y & low]

    return code, first, split


def base(w: Words, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    n_docs = len(offsets) - 1
    head = (w.buf & 0xC0) != 0x80
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    salt = mix(np.arange(1, n_docs + 1, dtype=U64))
    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(w.buf == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(w.buf)]
    end = np.append(start[1:], len(w.buf))
    end = end - ((end > start) & (w.buf[np.maximum(end, 1) - 1] == 10)) if len(start) else end
    inside = np.concatenate([[0], np.cumsum(~SPACE[w.buf])])
    with_word = inside[end] > inside[start] if len(start) else np.zeros(0, bool)
    start, end = start[with_word], end[with_word]
    doc = np.searchsorted(offsets, start, "right") - 1
    line = segment_hash(w.buf, start, end) ^ salt[doc]
    _, first = np.unique(line, return_index=True)
    lines = np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs)
    # words in windows of three that occur twice
    at = np.flatnonzero(w.room() >= 3)
    word_doc = w.doc()
    _, back, count = np.unique(window_hash(w.hash, at, 3) ^ salt[word_doc[at]], return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": w.counts, "word_chars": per_doc(head & ~SPACE[w.buf]), "n_symbols": per_doc(symbol[w.buf]), "n_dup_lines": lines,
        "n_repeat_words": np.bincount(word_doc[covered], minlength=n_docs),
    }


def failed_base(n: dict[str, np.ndarray]) -> np.ndarray:
    return (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])


def _shorter(order: int) -> tuple[Column, Column]:
    """a and b of a sequence without its first character."""
    a, b = F.col("a"), F.col("b")
    gone = {4: _CHAR << WIDE, 3: _CHAR << WIDE | _CHAR}.get(order, 0)
    return a.bitwiseAND(F.lit(~gone).cast("long")), b.bitwiseAND(F.lit(_CHAR).cast("long")) if order == 2 else b


def table(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, p) of the different sequences (a, b, n): probability of the last character after the others, by modified Kneser-Ney.

    Lower orders count different left neighbours; each order of a model has its own discounts for
    counts 1, 2 and more; the lowest is mixed with equal chances for all characters of the model.
    """
    levels = {ORDER: grams}
    for k in range(ORDER, 1, -1):
        a, b = _shorter(k)
        levels[k - 1] = scratch.save(levels[k].select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")))
    model = F.shiftright("a", 2 * WIDE).alias("model")
    p = None
    for k in range(1, ORDER + 1):
        counts = levels[k].groupBy(model).agg(F.count("*").alias("types"), *(F.sum((F.col("n") == r).cast("double")).alias(f"n{r}") for r in (1, 2, 3, 4)))
        y = F.when(F.expr("n1 + n2 > 0"), F.expr("n1 / (n1 + 2 * n2)")).otherwise(0.5)
        d = lambda r: F.when(F.col(f"n{r}") > 0, F.least(F.greatest(r - (r + 1) * y * F.col(f"n{r + 1}") / F.col(f"n{r}"), F.lit(0.05 * r)), F.lit(0.95 * r))).otherwise(0.5 * r).alias(f"d{r}")
        t = levels[k].withColumn("model", model).join(F.broadcast(counts.select("model", "types", d(1), d(2), d(3))), "model")  # a row a model
        t = t.withColumn("cut", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")).withColumn("c", F.shiftright("b", WIDE))
        sums = t.groupBy("a", "c").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        t = t.join(sums, ["a", "c"])
        if k == 1:
            t = t.withColumn("lower", 1 / F.col("types"))
        else:
            la, lb = _shorter(k)
            t = t.withColumn("la", la).withColumn("lb", lb).join(p.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("p").alias("lower")), ["la", "lb"])
        p = scratch.save(t.select("a", "b", F.expr("(n - cut) / total + mass / total * lower").alias("p")))
    return p


def languages(docs: DataFrame, least: int) -> list[str]:
    """Languages with at least `least` bytes of text; the driver sees a row a language."""
    found = docs.where("lang IS NOT NULL").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).where(F.col("n") >= least)
    return sorted(r["lang"] for r in found.select("lang").collect())


def _content() -> Column:
    """A hash of what a verdict depends on."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(0), "lang")


class Model:
    """Bits of sequences by their hashes, in ascending order."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray) -> None:
        self.keys, self.bits = keys, bits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Bits of sequences, all of which the model holds."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if len(keys) and not (len(self.keys) and (self.keys[at] == keys).all()):
            raise LookupError("a sequence that wasn't counted; did the texts change meanwhile?")
        return self.bits[at]


def keys_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences."""
    return mix(mix(a.astype(U64) + U64(0x9E3779B97F4A7C15)) ^ b.astype(U64))


def _counted(docs: DataFrame, number: dict[str, int], scratch: Scratch) -> DataFrame:
    """(a, b, n): the different sequences of all texts."""

    def run(batches):
        for batch in batches:
            models = np.array([number.get(x, 0) for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, buf, offsets in slices(batch.column(0), COUNTED):
                code, _, split = sequences(buf, offsets, models[lo:hi])
                different, count = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*split(different), count)], names=["a", "b", "n"])

    ship(docs.sparkSession)
    return scratch.save(docs.select("text", "lang").mapInArrow(tidied(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))


def _stored(p: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The model's rows (part, keys, bits), how many ranges of the hash space they are, and how many sequences."""
    n = p.count()
    parts = max(1, -(-n // RANGE))

    def deal(batches):
        for batch in batches:
            keys = keys_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            order = np.argsort(keys)
            at = cuts(keys[order], parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts, dtype=np.int32), np.diff(at))), pa.array(keys[order].view(np.int64)), pa.array(-np.log2(batch.column(2).to_numpy()[order]).astype(np.float32))], names=["part", "key", "bits"])

    def sort(key, table):
        keys, bits = table["key"].to_numpy().view(U64), table["bits"].to_numpy()
        order = np.argsort(keys)
        if (keys[order][1:] == keys[order][:-1]).any():
            raise ValueError("two sequences share a 64-bit hash")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys[order].tobytes()], pa.binary()), "bits": pa.array([bits[order].tobytes()], pa.binary())})

    rows = p.select("a", "b", "p").mapInArrow(tidied(deal), "part int, key long, bits float").groupBy("part").applyInArrow(tidied(sort), "part int, keys binary, bits binary")
    return scratch.save(rows), parts, n


def _model(rows) -> Model:
    rows = sorted(rows, key=lambda r: r["part"])
    return Model(np.frombuffer(b"".join(r["keys"] for r in rows), U64), np.frombuffer(b"".join(r["bits"] for r in rows), np.float32))


def _measure(ids: pa.Array, column: pa.Array, models: np.ndarray, hashes: pa.Array, find) -> pa.RecordBatch:
    """The measures of texts; find: bits of ascending keys."""
    out: list[list] = [[] for _ in range(len(_BASE) + 2)]
    for lo, hi, buf, offsets in slices(column, MEASURED):
        n = base(words(buf, offsets), offsets)
        code, first, split = sequences(buf, offsets, models[lo:hi])
        different, at = np.unique(code, return_inverse=True)
        keys = keys_of(*split(different))
        order = np.argsort(keys)
        cost = np.empty(len(keys))
        cost[order] = find(keys[order])
        size = np.diff(first)
        total = np.add.reduceat(np.append(cost[at], 0.0), first[:-1])  # of each text alone, so that it doesn't depend on its neighbours
        for o, v in zip(out, (*(n[c] for c in _BASE), failed_base(n), np.where(size > 0, np.round(total / np.maximum(size, 1), 6), np.nan)), strict=True):
            o.append(v)
    columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
    types = [*[pa.int64()] * len(_BASE), pa.bool_(), pa.float64()]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), hashes, pa.array(models, pa.int32()), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in _MEASURED.split(", ")])


def _numbers(column, number: dict[str, int]) -> np.ndarray:
    return np.array([number.get(x, 0) for x in column.to_pylist()], np.int64)


def _measured(docs: DataFrame, least: int, scratch: Scratch, broadcast: int) -> DataFrame:
    """doc_id, hash, model, the base measures, base_failed and bits (NaN without characters) of every row."""
    spark = docs.sparkSession
    number = {lang: i + 1 for i, lang in enumerate(languages(docs, least))}
    model, parts, n = _stored(table(_counted(docs, number, scratch), scratch), scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", _content().alias("hash"))
    if n <= broadcast:
        shared = spark.sparkContext.broadcast(_model(model.collect()))

        def here(batches):
            for b in batches:
                if b.num_rows:
                    yield _measure(b.column(0), b.column(1), _numbers(b.column(2), number), b.column(3), shared.value.find)

        return scratch.save(rows.mapInArrow(tidied(here), _MEASURED))
    chunks = max(1, -(-text_bytes(docs) // CHUNK))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(chunks)))

    def ask(key, t):
        found = []
        models = _numbers(t["lang"], number)
        for lo, hi, buf, offsets in slices(t["text"], MEASURED):
            code, _, split = sequences(buf, offsets, models[lo:hi])
            found.append(keys_of(*split(np.unique(code))))
        keys = np.unique(np.concatenate(found))
        at = cuts(keys, parts).tolist()
        out = [(p, key[0].as_py(), b - a, pack_sorted(keys[a:b])) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pa.table([pa.array([r[i] for r in out], t_) for i, t_ in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.binary()])], names=["part", "chunk", "n", "keys"])

    def tell(key, asked, own):
        found = _model(own.to_pylist())
        bits = [found.find(unpack_sorted(k)).tobytes() for k in asked["keys"].to_pylist()]
        return pa.table([asked["part"], asked["chunk"], pa.array(bits, pa.binary())], names=["part", "chunk", "bits"])

    def finish(key, t, told):
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * len(_BASE), pa.bool_(), pa.float64())], names=[c.split()[0] for c in _MEASURED.split(", ")])
        models, found = _numbers(t["lang"], number), []
        for lo, hi, buf, offsets in slices(t["text"], MEASURED):
            code, _, split = sequences(buf, offsets, models[lo:hi])
            found.append(keys_of(*split(np.unique(code))))
        bits = b"".join(r["bits"] for r in sorted(told.to_pylist(), key=lambda r: r["part"]))
        own = Model(np.unique(np.concatenate(found)), np.frombuffer(bits, np.float32))
        return pa.Table.from_batches([_measure(t["doc_id"].combine_chunks(), t["text"], models, t["hash"].combine_chunks(), own.find)])

    told = dealt.groupBy("chunk").applyInArrow(tidied(ask), _ASK).groupBy("part").cogroup(model.groupBy("part")).applyInArrow(tidied(tell), _TELL)
    return scratch.save(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(tidied(finish), _MEASURED))


def bands(measured: DataFrame, spread: float) -> DataFrame:
    """By model: the quartiles of bits a character of documents that pass the base rules, widened by `spread` times their distance.

    Quartiles are of values to four decimals, the least that a quarter and three quarters of the
    documents don't exceed, from counts of equal values: exact, and the same in any order of rows.
    """
    good = measured.where("NOT base_failed AND NOT isnan(bits)").groupBy("model", F.round("bits", 4).alias("v")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("model")  # at most some ten thousand different values
    steps = good.select("model", "v", F.sum("n").over(by.orderBy("v")).alias("upto"), F.sum("n").over(by).alias("all"))
    q = steps.groupBy("model").agg(F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("v"))).alias("a"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("v"))).alias("b"))
    wide = spread * (F.col("b") - F.col("a"))
    return q.select("model", (F.col("a") - wide).alias("low"), (F.col("b") + wide).alias("high"))


def _judged(docs: DataFrame, spread: float, least: int, broadcast: int = BROADCAST_SEQUENCES) -> DataFrame:
    measured = _measured(docs, least, Scratch(docs.sparkSession), broadcast)
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return measured.join(F.broadcast(bands(measured, spread)), "model", "left").withColumn("kept", ~F.col("base_failed") & inside)  # a row a model


def judge(docs: DataFrame, spread: float = 3.0, least: int = 1 << 16, broadcast: int = BROADCAST_SEQUENCES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and bits of every row of documents (doc_id, text, lang).

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. kept:
    passes that, and its bits a character (log2 of the perplexity) lie within its language's band.
    Null and empty texts have no words, fail, and have no bits (null). Null languages and those of
    less than `least` bytes of text, too few for quartiles, share a model and a band. Models of up to
    `broadcast` sequences in all are sent to every executor. Rows may
    repeat and doc_id may be null: each row counts and gives one row. Other columns are not read.
    """
    return _judged(docs, spread, least, broadcast).select("doc_id", *_BASE, "base_failed", "kept", F.nanvl("bits", F.lit(None).cast("double")).alias("bits"))


def keep_good(docs: DataFrame, spread: float = 3.0, least: int = 1 << 16) -> DataFrame:
    """The rows of documents that judge() keeps, columns unchanged: those whose content hash isn't among the others'."""
    gone = Scratch(docs.sparkSession).save(_judged(docs, spread, least).where("NOT kept").select("hash").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_HASHES else gone
    name = f"gone_{uuid.uuid4().hex}"  # no column of the documents
    return docs.join(gone.withColumnRenamed("hash", name), _content() == F.col(name), "left_anti")
