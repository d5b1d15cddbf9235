"""Operator 4: Katz back-off language model, counted, stored and looked up in hash partitions.

Documents are dealt into chunks of bounded size. Order by order a chunk sends its different n-grams
to partitions of the n-grams' contexts, packed and sorted; a partition adds up the counts, keeps what
its contexts' back-off weights need, and answers in the order it was asked: each n-gram's number and
count, and the weights of those contexts alone in which the asker has an n-gram that training hasn't.
A context's own count is that of the shorter n-gram that it is, so it is known already; so is the
lower order's probability of an n-gram seen in training, which the asker sends as two counts. Requests
and answers grow with a chunk's different n-grams, not with its tokens, and a very common n-gram comes
once a chunk. Global numbers are a few counts of counts. Probabilities are then evaluated chunk by
chunk, each token recursively from the highest order down. Texts are cut into words again for each
order, which takes less disk than keeping tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import cuts, pack, pack_sorted, unpack, unpack_bits, unpack_sorted
from ..ship import ship, tidied
from ..storage import Scratch, release, shares
from .textops import U64, mix, raw, texts, words

END = U64(0x0E4D0E4D0E4D0E4D)
BEGIN = U64(1 << 62)
#: Counts up to this are discounted.
LOW = 5
#: Bytes of text in a chunk, about.
CHUNK = 8 << 20
_ASK = "part int, chunk long, n long, keys binary, runs binary, words binary, counts binary, lower binary, totals binary"
_TELL = "part int, chunk long, level int, n long, contexts long, ids binary, counts binary, none binary, open binary, mass binary, low binary, total long, types long, hist array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _ARROW[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _flags(bits: np.ndarray) -> bytes:
    return pack(np.packbits(bits))


def _unflag(blob: bytes, n: int) -> np.ndarray:
    return unpack_bits(unpack(blob).astype(np.uint8).tobytes(), n)


def _hist(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, LOW + 2), minlength=LOW + 3)[1 : LOW + 2].tolist()


def _different(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different value, ascending, and each value's number among them."""
    order = np.argsort(key)
    head = np.ones(len(order), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(head) - 1
    return order[head], back


def _pairs(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_different() of pairs, by the first, then the second."""
    first, a = _different(major)
    width = int(minor.max()) + 1 if len(minor) else 1
    if len(first) * width >= 1 << 63:
        last, minor = _different(minor)
        width = len(last)
    return _different(a * width + minor.astype(np.int64))


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def discounts(hist: list[int]) -> np.ndarray:
    """Factors d[r] on counts r = 0..LOW by Good and Turing, as Katz scales them; 1 beyond.

    hist[r - 1]: n-grams with count r, up to LOW + 1. Where the counts of counts can't give factors
    in (0, 1), one absolute discount n1 / (n1 + 2 n2) (a half if that fails too) gives them.
    """
    n = np.array([0, *hist], np.float64)
    d = np.ones(LOW + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (LOW + 1) * n[LOW + 1] / n[1]
        for r in range(1, LOW + 1):
            d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
    if not (np.all(np.isfinite(d)) and np.all(d[1:] > 0) and np.all(d[1:] < 1)):
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:] = 1 - cut / np.arange(1, LOW + 1)
    d[0] = 0.0
    return d


class Numbers:
    """The model's global numbers: training tokens and types, and discounts of each order."""

    def __init__(self) -> None:
        self.tokens = self.types = 0
        self.factors: list[np.ndarray] = []
        self.hists: list[list[int]] = []

    def add(self, stats: list) -> None:
        hist = np.sum([s["hist"] for s in stats], axis=0).tolist() if stats else [0] * (LOW + 1)
        if not self.factors:
            self.tokens, self.types = sum(s["total"] for s in stats), sum(s["types"] for s in stats)
        self.hists.append(hist)
        self.factors.append(discounts(hist))

    def _left(self) -> float:
        """Discounted mass of the words."""
        return float(((1 - self.factors[0][1:]) * np.arange(1, LOW + 1) * np.array(self.hists[0][:LOW], np.float64)).sum())

    def seen(self, level: int, counts: np.ndarray, totals: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of n-grams with these counts in training, given their contexts' totals."""
        d = self.factors[level - 1]
        if level == 1:
            totals = self.tokens + (0 if self._left() > 0 else 1)
        return np.where(counts <= LOW, d[np.minimum(counts, LOW)], 1.0) * counts / np.maximum(totals, 1)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words with these counts; 0 stands for the one class of unknown words."""
        if not self.tokens:
            return np.ones(len(counts))
        left = self._left()
        return np.where(counts > 0, self.seen(1, counts), (left or 1.0) / (self.tokens + (0 if left > 0 else 1)))

    def weight(self, level: int, low: np.ndarray, none: np.ndarray, totals: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Back-off weights of contexts: what discounting leaves, over what the lower order gives to words not seen in them."""
        d = self.factors[level - 1]
        left = ((1 - d[1:])[:, None] * np.arange(1, LOW + 1)[:, None] * low).sum(axis=0)
        return np.where(none, 1.0, left) / np.maximum(totals, 1) / np.maximum(1 - mass, 1e-12)


def _words():
    """Adds up word counts: of each asked word its number and count."""

    def run(key, table):
        rows, part = table.to_pylist(), key[0].as_py()
        keys, counts = np.concatenate([unpack_sorted(r["keys"]) for r in rows]), np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64)
        unique, back = _different(keys)
        total = np.bincount(back, counts, len(unique)).astype(np.int64)
        places, out, lo = np.empty(len(unique), np.int64), [], 0
        places[np.argsort(-total, kind="stable")] = np.arange(len(unique))  # frequent words get small numbers, which pack well
        for r in rows:
            own = back[lo : lo + r["n"]]
            out.append((part, r["chunk"], 1, r["n"], 0, pack(places[own]), pack(total[own]), None, None, None, None, 0, 0, None))
            lo += r["n"]
        out.append((part, -1, 1, 0, 0, None, None, None, None, None, None, int(total.sum()), int((total > 0).sum()), _hist(total)))
        return _table(out, _TELL)

    return run


def _grams(level: int, last: bool, numbers: Numbers):
    """Adds up n-gram counts, and what each context's back-off weight needs."""

    def run(key, table):
        rows, part = table.to_pylist(), key[0].as_py()
        contexts = [unpack_sorted(r["keys"]) for r in rows]
        runs = [unpack(r["runs"]).astype(np.int64) for r in rows]
        context = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, runs, strict=True)])
        word = np.concatenate([unpack(r["words"]) for r in rows])
        first, back = _pairs(context, word)
        total = np.bincount(back, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64), len(first)).astype(np.int64)
        lower = np.concatenate([unpack(r["lower"]) for r in rows]).astype(np.int64)[first]
        below = None  # the lower contexts' totals
        if level > 2:
            below = np.concatenate([np.repeat(unpack(r["totals"]).astype(np.int64), n) for r, n in zip(rows, runs, strict=True)])[first]
        p = np.where(total > 0, numbers.seen(level - 1, lower, below), 0.0)
        start = _starts(context[first])
        known = context[first][start]
        sums, mass = np.add.reduceat(total, start), np.add.reduceat(p, start)
        low = np.stack([np.add.reduceat((total == r).astype(np.int64), start) for r in range(1, LOW + 1)])
        none = (sums > 0) & (low.sum(axis=0) == 0)
        out, lo = [], 0
        for r, own, n in zip(rows, contexts, runs, strict=True):
            mine, at = back[lo : lo + r["n"]], np.searchsorted(known, own)
            open_ = np.logical_or.reduceat(total[mine] == 0, np.cumsum(n) - n) & (sums[at] > 0)
            asked = at[open_]
            blobs = None if last else pack_sorted(mine), pack(total[mine]), _flags(none[at]), _flags(open_), mass[asked].astype("<f8").tobytes(), pack(low[:, asked].reshape(-1))
            out.append((part, r["chunk"], level, r["n"], len(own), *blobs, 0, 0, None))
            lo += r["n"]
        out.append((part, -1, level, 0, 0, None, None, None, None, None, None, int(total.sum()), int((total > 0).sum()), _hist(total)))
        return _table(out, _TELL)

    return run


class _Chunk:
    """One chunk's tokens, and what the answers say of them, order by order."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, parts: int) -> None:
        self.parts = parts
        held = np.asarray(table["held"].fill_null(False).to_numpy(zero_copy_only=False), bool)
        buf, offsets = raw(texts(table["text"]))
        w = words(buf, offsets, lower=True)
        self.sizes = w.counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        tokens = np.insert(w.hash, w.first[1:], END)
        first, self.tokens = _different(tokens)
        self.vocab = tokens[first]
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], self.sizes)
        self.train, self.held = ~np.repeat(held, self.sizes), held
        self.answers: dict[int, list[dict]] = {}
        for a in sorted(answers.to_pylist(), key=lambda a: a["part"]) if answers is not None else []:
            self.answers.setdefault(a["level"], []).append(a)
        self.level = 0

    def _got(self, name: str) -> np.ndarray:
        return np.concatenate([unpack(a[name]) for a in self.answers[self.level]])

    def _ids(self, unpacked) -> np.ndarray:
        """Numbers of n-grams: their places in their partitions, and those."""
        return np.concatenate([unpacked(a["ids"]) * U64(self.parts) + U64(a["part"]) for a in self.answers[self.level]])

    def start(self) -> None:
        """Take the answers for words."""
        self.level = 1
        self.word_ids, self.word_counts = self._ids(unpack), self._got("counts").astype(np.int64)
        self.count = self.word_counts[self.tokens]  # of each token's n-gram of this order
        self.total = None  # of its context, with what none adds
        self.gram, self.gram_ids = self.tokens, self.word_ids
        self.word_rank = np.empty(len(self.vocab), np.int64)
        self.word_rank[np.argsort(self.word_ids)] = np.arange(len(self.vocab))

    def _contexts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that have an n-gram of that order, which shorter n-gram each one's context is, these contexts' counts in training, and the shorter n-grams' numbers."""
        at = np.flatnonzero(self.place >= level - 2)
        before = np.maximum(at - 1, 0)
        which, counts, ids = self.gram[before], self.count[before], self.gram_ids
        if level == 2:
            head = self.place[at] == 0
            which[head], counts[head] = len(ids), self.word_counts[np.searchsorted(self.vocab, END)]  # a document has one end, and one beginning
            ids = np.append(ids, BEGIN)
        return at, which, counts, ids

    def grams(self, level: int):
        """That order's different n-grams by partition, context and word: tokens, each one's n-gram, contexts, words, and a token of each; and the tokens' contexts' counts."""
        at, which, sums, ids = self._contexts(level)
        part = (mix(ids) % U64(self.parts)).astype(np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, part))] = np.arange(len(ids))
        first, gram = _different(rank[which] * len(self.vocab) + self.word_rank[self.tokens[at]])
        context = which[first]
        return at, gram, part[context], ids[context], self.word_ids[self.tokens[at[first]]], at[first], sums

    def ask(self, level: int, chunk: int) -> list[tuple]:
        if level == 1:
            counts = np.bincount(self.tokens[self.train], minlength=len(self.vocab))
            cut, out = cuts(self.vocab, self.parts).tolist(), []
            return [(p, chunk, b - a, pack_sorted(self.vocab[a:b]), None, None, pack(counts[a:b]), None, None) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
        at, gram, part, context, word, token, _ = self.grams(level)
        counts = np.bincount(gram[self.train[at]], minlength=len(word))
        lower = self.count[token]
        bounds, out = np.append(_starts(part), len(part)).tolist(), []
        for a, b in zip(bounds, bounds[1:], strict=False):
            start = a + _starts(context[a:b])
            totals = pack(self.total[token[start]]) if level > 2 else None
            out.append((int(part[a]), chunk, b - a, pack_sorted(context[start]), pack(np.diff(np.append(start, b))), pack(word[a:b]), pack(counts[a:b]), pack(lower[a:b]), totals))
        return out

    def climb(self, numbers: Numbers | None = None, p: np.ndarray | None = None) -> np.ndarray | None:
        """Take the next order's answers; with the model's numbers and the tokens' probabilities in this order, those in the next."""
        level = self.level + 1
        at, gram, _, context, _, _, sums = self.grams(level)
        self.level = level
        rows = self.answers[level]
        counts = self._got("counts").astype(np.int64)
        start = _starts(context)
        owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))[gram]  # each token's context
        none = np.concatenate([_unflag(a["none"], a["contexts"]) for a in rows])
        count, total = counts[gram], sums + none[owner]
        if p is not None:
            open_ = np.flatnonzero(np.concatenate([_unflag(a["open"], a["contexts"]) for a in rows]))
            mass = np.concatenate([np.frombuffer(a["mass"], "<f8") for a in rows])
            low = np.concatenate([unpack(a["low"]).astype(np.int64).reshape(LOW, -1) for a in rows], axis=1)
            totals = np.zeros(len(start), np.int64)
            totals[owner] = total
            weight = np.ones(len(start))
            weight[open_] = numbers.weight(level, low, none[open_], totals[open_], mass)
            seen = numbers.seen(level, count, total)
            p = p.copy()
            p[at] = np.where(sums == 0, p[at], np.where(count > 0, seen, weight[owner] * p[at]))
        self.count, self.total = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        self.count[at], self.total[at] = count, total
        self.gram = np.zeros(len(self.tokens), np.int64)
        self.gram[at] = gram
        if rows and rows[0]["ids"] is not None:
            self.gram_ids = self._ids(unpack_sorted)
        return p


def score(docs: DataFrame, held: Column, order: int = 3, chunks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of documents.

    The model learns from rows whose `held` is not true (null counts as false) and scores all.
    Lower-cased words (64-bit hashes), then one end, are the tokens; null and empty texts are the
    end alone. score: log10 of the text's probability by Katz back-off of `order`; base_score: that
    of the smoothed word counts. Unknown words share one class whose probability is the words'
    discounted mass; every distribution sums to one over the known words and that class. Contexts
    that leave no mass because all their counts are high get one more count for the rest. Rows may
    repeat and doc_id may be null: each row counts and gives one row. Without training rows every
    probability is 1.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch, parts = Scratch(spark), chunks or shares(docs, CHUNK)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).groupBy("chunk")
    numbers, tables = Numbers(), []

    def told(*needless: str):
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        return every.where("chunk >= 0").drop("total", "types", "hist", *needless).groupBy("chunk")

    def ask_words(key, table):
        return _table(_Chunk(table, None, parts).ask(1, key[0].as_py()), _ASK)

    def ask(level: int):
        def run(key, table, answers):
            if not table.num_rows:
                return _table([], _ASK)
            c = _Chunk(table, answers, parts)
            c.start()
            while c.level < level - 1:
                c.climb()
            return _table(c.ask(level, key[0].as_py()), _ASK)

        return run

    def finish(key, table, answers):
        if not table.num_rows:
            return _table([], _SCORES)
        c = _Chunk(table, answers, parts)
        c.start()
        n, first = numbers.tokens, c.first[:-1]
        base = np.log10((c.word_counts + 0.5) / (n + 0.5 * (numbers.types + 1)))[c.tokens]
        p = numbers.word(c.word_counts)[c.tokens]
        known = np.add.reduceat((c.count > 0).astype(np.int64), first)
        while c.level < order:
            p = c.climb(numbers, p)
        columns = [table["doc_id"].combine_chunks(), c.held, c.sizes, known, np.full(len(first), n), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]
        fields = [f.split() for f in _SCORES.split(", ")]
        return pa.table([pa.array(v, _ARROW[k]) if i else v for i, (v, (_, k)) in enumerate(zip(columns, fields, strict=True))], names=[f for f, _ in fields])

    for level in range(1, order + 1):
        asked = dealt.applyInArrow(tidied(ask_words), _ASK) if level == 1 else dealt.cogroup(told("open", "mass", "low")).applyInArrow(tidied(ask(level)), _ASK)
        reduce_ = _words() if level == 1 else _grams(level, level == order, numbers)
        tables.append(scratch.save(asked.groupBy("part").applyInArrow(tidied(reduce_), _TELL)))
        numbers.add(tables[-1].where("chunk < 0").select("total", "types", "hist").collect())  # a row a partition
        release(spark)
    return dealt.cogroup(told()).applyInArrow(tidied(finish), _SCORES)
