"""Cuts texts into the pieces that a byte-level tokenizer merges by itself, and remembers their tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import regex

from .textops import gather, same, segment_hash

OTHER, LETTER, NUMBER, BLANK = range(4)


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, of every code point."""
    out = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    return out


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of public_tokenizers.PATTERN in texts, and each text's first piece.

    The pattern's matches cover a text without gaps. A run of letters, of numbers or of other
    characters takes one space before it; a run of white space leaves its last character to what
    follows; 's 't 're 've 'm 'll 'd part from letters where the quote begins a match.
    """
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    place = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    doc = np.searchsorted(place, offsets)
    head = np.zeros(n + 1, bool)
    head[doc] = True
    kind = classes()[points]
    change = head.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change[:n])
    run_end = np.append(run[1:], n)
    blank = kind[run] == BLANK
    start = change[:n].copy()
    inner = blank & ~head[run_end]  # followed by more of the text
    last = run_end[inner] - 1
    start[last] = True
    joins = points[last] == 32
    start[run_end[inner][joins]] = False
    quote = run[(kind[run] == OTHER) & (points[run] == 39) & (run_end - run == 1) & ~head[run_end]]
    if len(quote):
        quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
        wide = np.append(points, np.zeros(3, np.uint32))
        a, b = wide[quote + 1], wide[quote + 2]
        more = ~head[np.minimum(quote + 2, n)]
        size = np.where(np.isin(a, [115, 116, 109, 100]), 2, 0)
        for x, y in ((114, 101), (118, 101), (108, 108)):
            size[(a == x) & (b == y) & more] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size
        start[after[after < n]] = True
    at = np.flatnonzero(start)
    return place[at], place[np.append(at[1:], n)], np.searchsorted(at, doc)


def one_by_one(encode: Callable[[bytes], list[int]]):
    """What Memory asks for, of a function of one piece."""

    def run(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        found = [encode(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    return run


class _Places:
    """A hash table of 64-bit keys with open addressing, asked and filled many keys at a time."""

    def __init__(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.key, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 for those that aren't there."""
        out = np.full(len(keys), -1)
        slot, open_ = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            there = self.place[slot]
            hit = (there >= 0) & (self.key[slot] == keys[open_])
            out[open_[hit]] = there[hit]
            on = (there >= 0) & ~hit
            open_, slot = open_[on], slot[on] + 1 & self.mask
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Different keys that aren't there."""
        slot, open_ = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = np.flatnonzero(self.place[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.place[slot[put]] = keys[open_[put]], places[open_[put]]
            on = np.ones(len(open_), bool)
            on[put] = False
            open_, slot = open_[on], slot[on] + 1 & self.mask


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.values, self.used = np.zeros(1 << 14, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(max(len(values), self.used), self.values.dtype)])
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)


class Memory:
    """Tokens of the pieces seen so far; begins anew when it holds `limit` pieces or `room` bytes of pieces and tokens.

    encode(buf, start, end): tokens of the pieces buf[start:end], one behind the other, and how many
    each has. Pieces are found by hash, and their bytes compared: those of up to eight bytes and one
    length can't share a hash, longer ones are looked at.
    """

    def __init__(self, encode, limit: int = 1 << 19, room: int = 64 << 20) -> None:
        self.encode, self.limit, self.room = encode, limit, room
        self._reset()

    def _reset(self) -> None:
        self.places = _Places(self.limit.bit_length())
        self.ids, self.bytes = _Pool(np.uint32), _Pool(np.uint8)
        self.start, self.size, self.key_start, self.key_size = (_Pool(np.int64) for _ in range(4))

    @property
    def pool(self) -> np.ndarray:
        return self.ids.values

    def _ask(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the different pieces buf[start:end], whose tokens now are in the pool."""
        ids, size = self.encode(buf, start, end)
        n = self.start.used
        self.start.add(self.ids.used + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)
        key_size = end - start
        self.key_start.add(self.bytes.used + np.cumsum(key_size) - key_size)
        self.key_size.add(key_size)
        self.bytes.add(gather(buf, start, key_size))
        return np.arange(n, n + len(start))

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of tokens of each piece buf[start:end]."""
        if self.start.used > self.limit or self.bytes.used + 4 * self.ids.used > self.room:
            self._reset()
        size = end - start
        hashes, first, back = np.unique(segment_hash(buf, start, end), return_index=True, return_inverse=True)
        head = first[back]
        other = size != size[head]
        long_ = np.flatnonzero((size > 8) & ~other & (head != np.arange(len(head))))
        other[long_[~same(buf, start[long_], buf, start[head[long_]], size[long_])]] = True
        odd = np.flatnonzero(other)  # pieces that only share the hash of another: asked by themselves
        at = np.concatenate([self.places.find(hashes), np.full(len(odd), -1)])
        back[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        known = np.flatnonzero(at >= 0)
        wrong = self.key_size.values[at[known]] != size[first[known]]
        long_ = np.flatnonzero(~wrong & (size[first[known]] > 8))
        k = known[long_]
        wrong[long_] = ~same(buf, start[first[k]], self.bytes.values, self.key_start.values[at[k]], size[first[k]])
        taken = known[wrong]  # the hash stands for another piece already
        at[taken] = -1
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._ask(buf, start[first[new]], end[first[new]])
            own = new[(new < len(hashes)) & ~np.isin(new, taken)]
            self.places.add(hashes[own], at[own])
        at = at[back]
        return self.start.values[at], self.size.values[at]

    def tokens(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and each text's first token; first: each text's first piece."""
        place, size = self.find(buf, start, end)
        return gather(self.pool, place, size), np.concatenate([[0], np.cumsum(size)])[first]
