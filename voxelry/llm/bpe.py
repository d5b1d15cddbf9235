"""Byte-pair merges as a finite-state transducer and as a prefix table.

For a vocabulary of byte strings with ranks, the encoding of a prefix is known by its last token
alone: cutting it off leaves the encoding of a shorter prefix. `Merges.step` finds it among the
vocabulary's tokens that end the prefix, by asking whether it may follow the token before it.
"""

from __future__ import annotations

import base64
import json
from itertools import accumulate

INFINITE = 1 << 60
_BYTES = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_merges(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids by bytes of a byte-level model in JSON whose ids follow the order of its merges, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ids = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in letters for c in token)}
    return ids, {t["content"]: t["id"] for t in model["added_tokens"]}


class Merges:
    """A vocabulary with its merge order, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        #: 1: the bytes begin a longer token; 2: they are a token.
        self.kind = dict.fromkeys(ranks, 2)
        for prefix in {t[:i] for t in ranks for i in range(1, len(t))}:
            self.kind[prefix] = self.kind.get(prefix, 0) | 1
        self._spines: dict[bytes, tuple] = {}
        self._fits: dict[bytes, dict[bytes, bool]] = {}
        self._pairs = 0

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token joins."""
        if len(token) == 1:
            return None
        parts, top = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            _, i = min((self.ranks.get(a + b, INFINITE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if self.ranks.get(parts[i] + parts[i + 1], INFINITE) >= top:
                raise ValueError(f"token {token!r} can't be merged from its bytes")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def spines(self, token: bytes) -> tuple[list, list]:
        """Parts at a token's left and right edge, short to long, each with the rank at which it is merged on."""
        if (found := self._spines.get(token)) is None:
            sides = []
            for side in (0, 1):
                part, rank, out = token, INFINITE, []
                while True:
                    out.append((part, rank))
                    if (two := self.split(part)) is None:
                        break
                    part, rank = two[side], self.ranks[part]
                sides.append(out[::-1])
            if len(self._spines) > 200_000:
                self._spines.clear()
            found = self._spines[token] = (sides[0], sides[1])
        return found

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes a + b are encoded as the tokens a, b: no merge crosses their border in time."""
        right, left = self.spines(a)[1], self.spines(b)[0]
        ranks, i, j = self.ranks, 0, 0
        while True:
            (x, up_x), (y, up_y) = right[i], left[j]
            r = ranks.get(x + y)
            if r is not None and r < up_x and r <= up_y:
                return False
            if up_x <= up_y:
                if up_x == INFINITE:
                    return True
                i += 1
            else:
                j += 1

    def step(self, text: bytes, lasts, opens: tuple, before: bytes | None) -> tuple[bytes, tuple]:
        """The last token of the encoding of text, and where ends of text begin that begin some token.

        lasts[i]: the last token of text[:i + 1]; opens: those places for text[:-1]; before: the token before text.
        """
        known, kind, last, still = self._fits, self.kind, None, []
        for at in (*opens, len(text) - 1):
            token = text[at:]
            if (k := kind.get(token)) is None:
                continue
            if k & 1:
                still.append(at)
            if k & 2 and last is None:
                previous = lasts[at - 1] if at else before
                if previous is None:
                    last = token
                    continue
                if (row := known.get(previous)) is None:
                    if self._pairs > 400_000:
                        known.clear()
                        self._pairs = 0
                    row = known[previous] = {}
                if (fits := row.get(token)) is None:
                    fits = row[token] = self.fits(previous, token)
                    self._pairs += 1
                if fits:
                    last = token
        if last is None:
            raise ValueError(f"no token for byte {text[-1]}")
        return last, tuple(still)


class Transducer:
    """Reads bytes, writes tokens; states and moves come into being when first needed.

    A state holds the bytes whose tokens aren't settled, the last token of each of their prefixes,
    the places from which a coming token may begin, and the token before them all. Tokens are
    written as soon as every way on shares them: what the chains of last tokens from all those
    places have in common is final. The tables are dropped when they reach `limit` states; a state
    of long pending text counts as several.
    """

    START = (None, b"", (), ())

    def __init__(self, merges: Merges, lookahead: int = 5, limit: int = 500_000) -> None:
        self.merges, self.lookahead, self.limit = merges, lookahead, limit
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.moves, self.held = [self.START], {b"": 0}, {}, 1

    def _number(self, state: tuple) -> int:
        before, text = state[:2]
        key = text if before is None else (before, text)  # the rest follows from these
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(state)
            self.held += 1 + len(text) // 64
        return n

    def _move(self, number: int, byte: int) -> tuple[int, tuple]:
        before, pending, lasts, opens = self.states[number]
        text, out = pending + _BYTES[byte], ()
        last, opens = self.merges.step(text, lasts, opens, before)
        lasts = (*lasts, last)
        if len(text) >= self.lookahead:
            before, text, lasts, opens, out = self._settle(before, text, lasts, opens)
        return self._number((before, text, lasts, opens)), out

    def _settle(self, before, text: bytes, lasts: tuple, opens: tuple) -> tuple:
        at = len(text)
        for end in reversed(opens):  # ascending places; up both chains, from the farther end, until they meet
            while at != end:
                if at > end:
                    at -= len(lasts[at - 1])
                else:
                    end -= len(lasts[end - 1])
            if not at:
                return before, text, lasts, opens, ()
        if not at:
            return before, text, lasts, opens, ()
        out = self._chain(lasts, at)
        # what begins before the settled border belongs to chains that can't be taken up
        return out[-1], text[at:], tuple(t if t and len(t) <= i + 1 else None for i, t in enumerate(lasts[at:])), tuple(x - at for x in opens), out

    @staticmethod
    def _chain(lasts: tuple, at: int) -> tuple:
        out = []
        while at:
            out.append(lasts[at - 1])
            at -= len(lasts[at - 1])
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ranks = self.merges.ranks
        if piece in ranks:
            return [ranks[piece]]
        if self.held > self.limit:
            self._reset()
        state, moves, out = 0, self.moves, []
        for byte in piece:
            if (move := moves.get(state << 8 | byte)) is None:
                if self.held > self.limit:  # the tables begin anew with the state we are in
                    now = self.states[state]
                    self._reset()
                    state, moves = self._number(now), self.moves
                move = moves[state << 8 | byte] = self._move(state, byte)
            state, written = move
            if written:
                out += written
        _, pending, lasts, _ = self.states[state]
        out += self._chain(lasts, len(pending))
        return [ranks[t] for t in out]


class PrefixCounts:
    """Exact token counts of every prefix of a piece, by dynamic programming over last tokens.

    Prefixes that pieces share are worked out once: they are kept in a tree, dropped at `limit` nodes.
    """

    def __init__(self, merges: Merges, limit: int = 150_000, deep: int = 48) -> None:
        self.merges, self.limit, self.deep = merges, limit, deep
        self._reset()

    def _reset(self) -> None:
        self.nodes, self.below = [((), (), ())], {}

    def counts(self, piece: bytes) -> list[int]:
        """counts[i]: tokens of piece[:i + 1]; one step a byte."""
        if len(self.nodes) > self.limit:
            self._reset()
        nodes, below, at, step = self.nodes, self.below, 0, self.merges.step
        for i, byte in enumerate(piece[: self.deep]):
            if (next_ := below.get(at << 8 | byte)) is None:
                lasts, opens, counts = nodes[at]
                last, opens = step(piece[: i + 1], lasts, opens, None)
                counts = (*counts, 1 + (counts[i - len(last)] if len(last) <= i else 0))
                next_ = below[at << 8 | byte] = len(nodes)
                nodes.append(((*lasts, last), opens, counts))
            at = next_
        lasts, opens, counts = nodes[at]
        if len(piece) <= self.deep:
            return counts
        lasts, counts, lo, window = list(lasts), list(counts), 0, 4 * self.merges.longest
        for i in range(self.deep, len(piece)):
            if i - lo > 2 * window:  # work on a window that holds every token that can end here
                opens, lo = tuple(x - window for x in opens), lo + window
            last, opens = step(piece[lo : i + 1], lasts[lo:] if lo else lasts, opens, lasts[lo - 1] if lo else None)
            lasts.append(last)
            counts.append(1 + (counts[i - len(last)] if len(last) <= i else 0))
        return counts


def _leads() -> dict[int, tuple[int, int, int, int]]:
    """Of each byte that begins a longer character: bytes to come, bounds of the next one, and its own bits."""
    out = {}
    for b in range(0xC2, 0xF5):
        more = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        low, high = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        out[b] = (more, low, high, b & (0x3F >> more))
    return out


class Utf8Stream:
    """UTF-8 as an incremental state machine: the state is the bytes to come, the bounds of the next one, and the bits so far.

    Between states at rest, stretches of whole characters are decoded in one go. A byte that can't
    follow ends the open character as one U+FFFD and is read again from rest.
    """

    LEADS = _leads()
    REST = (0, 0, 0, 0)

    def __init__(self) -> None:
        self.state = self.REST

    def step(self, byte: int) -> str:
        """What a byte completes, if anything."""
        more, low, high, bits = self.state
        if more:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                self.state = (more - 1, 0x80, 0xBF, bits) if more > 1 else self.REST
                return "" if more > 1 else chr(bits)
            self.state = self.REST
            return "\ufffd" + self.step(byte)
        if byte < 0x80:
            return chr(byte)
        self.state = self.LEADS.get(byte, self.REST)
        return "" if self.state[0] else "\ufffd"

    def feed(self, data: bytes, last: bool = False) -> str:
        out, i = [], 0
        while i < len(data):
            if self.state[0]:
                out.append(self.step(data[i]))
                i += 1
                continue
            try:
                out.append(str(memoryview(data)[i:], "utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(str(memoryview(data)[i : i + e.start], "utf-8"))
                i += e.start
                out.append(self.step(data[i]))
                i += 1
        if last and self.state[0]:
            out.append("\ufffd")
            self.state = self.REST
        return "".join(out)


def running(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]
