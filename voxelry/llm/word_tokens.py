"""Token ids of a tokenizers-library model whose pieces never span white space, with a memory of words."""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from ..ship import kept, local
from .pieces import LETTER, NUMBER, Memory, classes
from .textops import gather, words


#: Code points of plain words: normalisation only lower-cases them, one by one, and none is white space.
PLAIN = ((0x21, 0x7E), (0xA1, 0x12F))
#: Words given to the library as one text.
TOGETHER = 1000


def piece_counts(points: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Pieces of each of n plain words, given their code points and whose they are.

    The model's pre-tokenizer, fixed by its file, takes runs of letters, single numbers and runs of
    other characters; 's 't 're 've 'm 'll 'd are pieces of their own where the quote begins one.
    """
    kind = classes()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    start = edge[:-1] | (kind == NUMBER)
    start[1:] |= kind[1:] != kind[:-1]
    count = np.bincount(word[start], minlength=n)
    run = np.append(np.flatnonzero(start), len(points))
    size = np.diff(run)
    at, low = run[:-1], np.append(points | np.where((points >= 65) & (points <= 90), 32, 0).astype(points.dtype), [0, 0, 0])
    quote = np.flatnonzero((points[at] == 39) & (size == 1) & ~edge[np.minimum(at + 1, len(points))])
    quote = quote[kind[at[quote] + 1] == LETTER]
    a, b, letters = low[at[quote] + 1], low[at[quote] + 2], size[quote + 1]
    one = np.isin(a, [115, 116, 109, 100])  # s t m d
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re ve ll
    whole = quote[one & (letters == 1) | ~one & two & (letters == 2)]  # no letters are left for another piece
    return count - np.bincount(word[at[whole]], minlength=n)


class WordEncoder:
    """Encodes whole texts; the library sees each different word once while the memory holds it.

    The model's normaliser folds white space and its pre-tokenizer drops it, so a text's ids are
    those of its words between ASCII white space, in order; special strings hold no white space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(self._encode)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has. Plain ones go to the library many at a time, as one text: the
        last token of each piece, and no other, ends a word in the vocabulary, and the pieces of a word are counted."""
        n, size = len(start), end - start + 1
        ends = np.cumsum(size)
        data = gather(np.append(buf, np.uint8(32)), start, size)
        data[ends - 1] = 32
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        gap = np.flatnonzero(points == 32)  # words hold no blanks
        inside = np.ones(len(points), bool)
        inside[gap] = False
        word = np.repeat(np.arange(n), np.diff(np.append(-1, gap)) - 1)
        points = points[inside]
        odd = ~np.logical_or.reduce([(points >= a) & (points <= b) for a, b in PLAIN])
        odd[:-1] |= (points[:-1] == 60) & (points[1:] == 124) & (word[1:] == word[:-1])  # may begin a special string
        plain = np.bincount(word[odd], minlength=n) == 0
        counts = piece_counts(points[plain[word]], (np.cumsum(plain) - 1)[word[plain[word]]], int(plain.sum()))
        at = np.flatnonzero(plain)
        bounds = np.append(-1, gap)
        out: list = [None] * n
        for lo in range(0, len(at), TOGETHER):
            some = at[lo : lo + TOGETHER]
            together = text[bounds[some[0]] + 1 : bounds[some[-1] + 1]] if some[-1] - some[0] == len(some) - 1 else " ".join([text[bounds[i] + 1 : bounds[i + 1]] for i in some.tolist()])
            ids = np.array(self.tokenizer.encode_batch_fast([together], add_special_tokens=False)[0].ids, np.uint32)
            closed = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(counts[lo : lo + TOGETHER])
            if len(closed) == last[-1]:
                cut = np.append(0, closed[last - 1])
                if len(some) == n:
                    return ids, np.diff(cut)
                for i, a, b in zip(some.tolist(), cut.tolist(), cut[1:].tolist(), strict=False):
                    out[i] = ids[a:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([text[bounds[i] + 1 : bounds[i + 1]] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, n)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by end_id, and where each text's begin."""
        w = words(buf, offsets)
        ids, first = self.memory.tokens(buf, w.start, w.end, w.first)
        if end_id is None:
            return ids, first
        return np.insert(ids, first[1:], end_id), first + np.arange(len(first))


def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("words", path), lambda: WordEncoder(local(path)))
