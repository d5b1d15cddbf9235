"""Operator 6: exact token counts at every prefix of a text."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Merges, PrefixCounts, read_merges
from .pieces import Memory, cut, one_by_one
from ..ship import by_batch, kept, local, send
from .textops import gather, slices


class Counter:
    """Counts tokens of a byte-level BPE model in JSON; special strings inside texts are one token each."""

    def __init__(self, path: str) -> None:
        ids, special = read_merges(path)
        self.special = sorted((s.encode() for s in special), key=len, reverse=True)
        self.prefix = PrefixCounts(Merges(ids))
        # the memory's pool holds, for each piece, the count at each of its bytes
        self.memory = Memory(one_by_one(self.prefix.counts))
        self.pattern = regex.compile(b"|".join(map(regex.escape, self.special))) if self.special else None

    def _apart(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the stretches between and of special strings; which stretches are special."""
        hits = []
        if self.pattern is not None:
            data, bounds = buf.tobytes(), offsets.tolist()
            for m in self.pattern.finditer(data):
                doc = bisect_right(bounds, m.start()) - 1
                if m.end() <= bounds[doc + 1]:  # else it lies across two texts
                    hits.append((m.start(), m.end()))
        if not hits:
            return offsets, np.zeros(len(offsets) - 1, bool)
        start, end = np.array(hits).T
        parts = np.unique(np.concatenate([offsets, start, end]))
        flags = np.zeros(len(parts), bool)
        flags[np.searchsorted(parts, start)] = True
        return parts, flags[:-1]

    def totals(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text: the counts at the ends of its pieces, added up."""
        parts, special = self._apart(buf, offsets)
        start, end, first = cut(buf, parts)
        place, size = self.memory.find(buf, start, end)
        last = np.concatenate([[0], np.cumsum(self.memory.pool[place + size - 1].astype(np.int64))])
        each = np.where(special, 1, last[first[1:]] - last[first[:-1]])
        total = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(parts, offsets)
        return total[at[1:]] - total[at[:-1]]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Token counts of all prefixes of one text, without encoding it again.

    Kept are the counts at piece ends and, for each byte, the count of its piece up to it. Cutting can
    change how the last few characters fall into pieces (white space at the end, quotes), so the last
    two pieces before the cut are cut anew; each is the beginning of a piece that was there already,
    whose table has its count, or else a few bytes that are worked out.
    """

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter = counter
        self.data = np.frombuffer(text.encode(), np.uint8)
        parts, special = counter._apart(self.data, np.array([0, len(self.data)]))
        start, end, first = cut(self.data, parts)
        place, size = counter.memory.find(self.data, start, end)
        self.inside = gather(counter.memory.pool, place, size)  # pieces lie one behind the other, so by bytes of the text
        n = self.inside[end - 1].astype(np.int64)
        for a, b in zip(first[:-1][special], first[1:][special], strict=True):
            n[a:b] = 0
            n[a] = 1
        self.parts, self.special, self.start = parts, special, start
        self.end, self.count = np.concatenate([[0], end]), np.concatenate([[0], np.cumsum(n)])

    def _piece(self, a: int, b: int) -> int:
        """Tokens of a piece that is the text's bytes a to b."""
        i = int(np.searchsorted(self.start, a))
        if i < len(self.start) and self.start[i] == a and b <= self.end[i + 1]:
            return int(self.inside[b - 1])
        return self.counter.prefix.counts(self.data[a:b].tobytes())[-1]

    def count_at(self, n_bytes: int) -> int:
        """Tokens of the text's first n_bytes bytes, which end a character."""
        if n_bytes <= 0:
            return 0
        if n_bytes >= len(self.data):
            return int(self.count[-1])
        i = int(np.searchsorted(self.parts, n_bytes, "right")) - 1
        lo = int(self.parts[i])
        if n_bytes == lo:
            return int(self.count[np.searchsorted(self.end, lo)])
        near = n_bytes
        if self.special[i]:  # a cut special string is ordinary text, together with what stands before it
            near = lo
            lo = int(self.parts[i - 1]) if i and not self.special[i - 1] else lo
        k = max(int(np.searchsorted(self.end, near)) - 3, int(np.searchsorted(self.end, lo)))
        base = int(self.end[k])
        start, end, _ = cut(self.data[base:n_bytes], np.array([0, n_bytes - base]))
        return int(self.count[k]) + sum(self._piece(base + a, base + b) for a, b in zip(start.tolist(), end.tolist(), strict=True))

    def longest_within(self, budget: int) -> int:
        """Bytes of the longest prefix, ending a character, of at most `budget` tokens.

        Counts at the ends of pieces never fall, but for the last two of a prefix, which may be cut
        otherwise; so the answer lies within a few pieces of where the budget ends among them, and
        only the characters there are asked, the farthest first.
        """
        if self.count[-1] <= budget:
            return len(self.data)
        k = min(int(np.searchsorted(self.count, budget, "right")) + 3, len(self.end) - 1)
        for n in range(int(self.end[k]), -1, -1):
            if (n == len(self.data) or self.data[n] & 0xC0 != 0x80) and self.count_at(n) <= budget:
                return n
        return 0


def counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(local(path)))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of documents.

    path: a byte-level BPE model in JSON. Null text counts as empty: 0 bytes, 0 tokens, false.
    Rows may repeat and doc_id may be null: each row gives one row. Other columns are not read.
    """

    send(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, size, n = counter(path), [], []
        for _, _, buf, offsets in slices(batch.column(1)):
            n.append(c.totals(buf, offsets))
            size.append(np.diff(offsets))
        total = np.concatenate(n)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(size), pa.int64()), pa.array(total, pa.int64()), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return by_batch(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=True)


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each text's longest prefix of whole characters that has at most `budget` tokens.

    Null text counts as empty: 0 and 0. Rows may repeat and doc_id may be null: each row gives one
    row. Other columns are not read.
    """
    send(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, size, n = counter(path), [], []
        for text in batch.column(1):
            table = c.table(text.as_py() or "")
            size.append(table.longest_within(budget))
            n.append(table.count_at(size[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return by_batch(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long", keeps=True)
