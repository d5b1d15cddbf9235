"""The training-data operators against libraries and brute force, on small and odd tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelry.llm import bpe, bpe_codec, codec, dac, embedding_dedup, katz, minhash, packing, pieces, quality, substring_dedup, textops, token_counts, url_filter
from voxelry.llm.registry import RULES
from voxelry.operators import skew

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, chunk int"
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def thue_morse(a, b, n=1024):
    """n signs of the sequence over a and b; it and its complement have equal polynomial hashes modulo 2 ** 64."""
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


def pair(sep=""):
    return [sep.join(thue_morse("a", "b")), sep.join(thue_morse("b", "a"))]


def texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["The", "the", "Été", "naïve", "x<|endoftext|>y", "don't", "1234", "###", "中文"]
    prose = [" ".join(rng.choices(vocab, k=rng.choice([3, 30, 120, 400]))) for _ in range(40)]
    near = max(prose, key=len).split()
    near[3] = "changed"
    return [*prose, max(prose, key=len), " ".join(near), "", None, " \n\t ", "one", "two words", "a" * 3000, "\n".join(["same line"] * 9), prose[8] + " " + prose[9], *pair(), *pair(" "), "\n".join(x + " y" for x in pair()), "it's  'll\r\n x'll  ", "z " * 6000, "é     ß"]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, random.Random(i).choice(["en", "de", None]), "s", 0, "clash", 7) for i, t in enumerate(texts())] + [(None, "a row without id", "en", None, None, None, None), (1, texts()[1], "en", "again", 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    assert (codec.unpack_sorted(codec.pack_sorted(v)) == v).all()
    s = np.array([0, -1, 5, -(1 << 63), (1 << 63) - 1])
    assert (codec.unpack_signed(codec.pack_signed(s)) == s).all()
    cut = codec.cuts(v, 7)
    assert cut[0] == 0 and cut[-1] == 500 and (np.diff(cut) >= 0).all()


def test_hashes_tell_similar_strings_apart():
    rng = random.Random(6)
    strings = [*pair(), *pair(" "), "", "a", "a\0", "a\0\0", *("x" * n for n in range(1, 200)), *("".join(rng.choices("ab", k=rng.randint(1, 90))) for _ in range(5000))]
    strings = sorted({s.encode() for s in strings})
    ends = np.cumsum([len(s) for s in strings])
    buf, start = np.frombuffer(b"".join(strings), np.uint8), ends - [len(s) for s in strings]
    h = textops.segment_hash(buf, start, ends)
    assert len(np.unique(h)) == len(strings)
    assert (textops.segment_hash(np.frombuffer(strings[77] + b"tail", np.uint8), np.array([0]), np.array([len(strings[77])])) == h[77]).all()
    words = np.array([{"a": 1, "b": 2}[c] for x in pair() for c in x], np.uint64)
    for n in (2, 3, 5, 20, 50, 64, 1024):
        found = textops.window_hash(words, np.arange(len(words) - n + 1), n)
        assert len(np.unique(found)) == len({tuple(words[i : i + n].tolist()) for i in range(len(words) - n + 1)})


def test_memory_compares_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "segment_hash", lambda buf, start, end: np.minimum(end - start, 9).astype(np.uint64))
    strings = [b"aaaaaaaaaa", b"aaaaaaaaab", b"x", b"aaaaaaaaaa", b"aaaaaaaaaaa"]
    ends = np.cumsum([len(s) for s in strings])
    memory = pieces.Memory(pieces.one_by_one(list))
    for order in (strings, strings[::-1], [b"aaaaaaaaax", b"xx", *strings]):  # pieces that are new, known, and known by another's hash
        ends = np.cumsum([len(s) for s in order])
        place, size = memory.find(np.frombuffer(b"".join(order), np.uint8), ends - [len(s) for s in order], ends)
        assert [memory.pool[a : a + n].tolist() for a, n in zip(place, size, strict=True)] == [list(s) for s in order]


def test_memory_begins_anew():
    rng = random.Random(3)
    memory = pieces.Memory(pieces.one_by_one(list), limit=64, room=4000)
    for _ in range(60):
        order = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 9, 40]))) for _ in range(rng.randint(1, 50))]
        ends = np.cumsum([len(s) for s in order])
        place, size = memory.find(np.frombuffer(b"".join(order), np.uint8), ends - [len(s) for s in order], ends)
        assert [memory.pool[a : a + n].tolist() for a, n in zip(place, size, strict=True)] == [list(s) for s in order]


def test_word_pieces():
    """Words' ids, given to the library together, are those that it gives each alone."""
    from voxelry.llm.word_tokens import WordEncoder

    tk, rng = Tokenizer.from_file(WORDS), random.Random(8)
    words = ["".join(rng.choices("ab'slrevdmt.S1é´«'L", k=rng.randint(1, 9))) for _ in range(4000)] + ["'s", "''s", "'ll", "x'LL", "'re'", "'sample", "3'd4", "<|endoftext|>", "a<|b", "中文", "e\u0301", "\xad", "ſ", "İ"]
    ids, first = WordEncoder(WORDS).encode(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words).encode())]))
    want = [tk.encode(w, add_special_tokens=False).ids for w in words]
    assert ids.tolist() == [i for w in want for i in w] and first.tolist() == [0, len(ids)]


def test_transducer_equals_library():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    machine = bpe.Transducer(bpe.Merges(ranks), lookahead=4, limit=3000)
    counts = bpe.PrefixCounts(machine.merges, limit=2000)
    for _ in range(1500):
        piece = "".join(rng.choices("aeinsthr" if rng.random() < 0.5 else "ab é中\U0001f600'!", k=rng.choice([2, 9, 40, 300])))
        for p in regex.findall(P.PATTERN, piece):
            p = p.encode()
            ids = enc._encode_single_piece(p)
            assert machine.encode(p) == ids
            c = counts.counts(p)
            assert c[-1] == len(ids) and c[len(p) // 2] == len(enc._encode_single_piece(p[: len(p) // 2 + 1]))


def test_utf8_stream():
    text = "aé中\U0001f600" * 50
    data = text.encode()
    for step in (1, 2, 3, 5, 7):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.feed(b"", last=True) == text
    rng = random.Random(5)
    odd = [b"\xe4\xb8", b"a", b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90", "é\U0001f600".encode(), b"\xf0\x9f\x98", b"\x80"]
    for _ in range(300):
        data, s = b"".join(rng.choices(odd, k=6)), bpe.Utf8Stream()
        cut = sorted(rng.choices(range(len(data) + 1), k=3))
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
        assert "".join(map(s.feed, parts)) + s.feed(b"", last=True) == data.decode("utf-8", "replace")


def test_op1(docs, rows, empty):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = bpe_codec.digests(docs, P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    assert bpe_codec.digests(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


def sets(rows, size):
    out = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        out[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_op2(docs, rows, empty, size, percent):
    s = sets([r for r in rows if r[0] is not None], size)
    parent = {d: d for d in s}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs, size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_first(docs, size=size, percent=percent).columns == docs.columns


def test_op2_repeated_ids(spark):
    """Rows that repeat a doc_id are one document with the smallest of their texts, and give a row each."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, None), (7, b), (7, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 56, 3, True), *[(5, 56, 3, False)] * 2, *[(7, 56, 7, True)] * 3, (9, 56, 7, False)]
    assert sorted(r.doc_id for r in minhash.keep_first(df).collect()) == [3, 7, 7, 7]


def test_op2_crowded_buckets(spark, monkeypatch):
    """Large groups of near copies, compared in many small cells and looked up by broadcast, against brute force."""
    monkeypatch.setattr(minhash, "CELL", 8)
    monkeypatch.setattr(skew, "HEAVY", 40)
    monkeypatch.setattr(minhash, "lookup", lambda *a, **k: skew.lookup(*a, **k, least=5))
    rng = random.Random(17)
    table = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(120)]
        for i in range(40):
            w = list(words)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(120)] = f"x{rng.randrange(1000)}"
            table.append((1000 * g + i, " ".join(w)))
    s = sets(table, 5)
    reach = {d: d for d in s}
    links = {(a, b) for a in s for b in s if a != b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    for _ in range(30):
        for a, b in links:
            reach[a] = min(reach[a], reach[b])
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == reach and len(set(reach.values())) > 3


def test_op2_many_copies_and_an_outsider(spark, monkeypatch):
    """A bucket's rows in cells follow its members times its outsiders' blocks, not the square of its members."""
    monkeypatch.setattr(minhash, "CELL", 8)
    counted = []

    class Spy(minhash.Scratch):
        def save(self, df):
            out = super().save(df)
            if "blocks" in out.columns:
                counted.extend(out.collect())
            return out

    monkeypatch.setattr(minhash, "Scratch", Spy)
    rng, words = random.Random(21), [f"w{i}" for i in range(400)]
    table = [(i, " ".join(w if k != 3 * i + 5 else "changed" for k, w in enumerate(words))) for i in range(100)]
    outside = list(words)
    for k in range(0, 400, 33):
        outside[k] = f"o{rng.randrange(10**6)}"
    table.append((1000, " ".join(outside)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 5, 85).collect()}
    assert set(got.values()) == {0, 1000} and got[1000] == 1000
    large = [r for r in counted if r.blocks]
    assert large and all(r.n > 50 and r.n_out == 1 and r.n * r.blocks + r.n_out * r.chunks < 2 * r.n for r in large)


def test_op2_across_components(spark):
    """A chain whose ends don't link with each other is one component, whatever document a bucket begins with."""
    words = [f"v{i}" for i in range(400)]
    chain = []
    for k in range(4):
        w = list(words)
        for j in range(6 * k):
            w[(j * 61) % 400] = f"new{j}"
        chain.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in zip([3, 0, 2, 1], chain, strict=True)], "doc_id long, text string")
    s = sets([(i, t) for i, t in zip([3, 0, 2, 1], chain, strict=True)], 3)
    linked = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert linked and len({got[a] for pair in linked for a in pair}) <= len(linked)
    assert all(got[a] == got[b] for a, b in linked)


def test_op3(spark):
    urls = ["http://Example.ORG/en/12", "https://a.b.example.org/es/x?q", "http://example.org/en/2", "http://x.com/fr/1", "http://com/de/1#a", "http://xcom/de/", "http://org", None, "nothing", "ftp://a.org:80/", "http://notexample.org/en/1", "http://a.example.org/en/1" + "9" * 5000, "://", "http://org/a", "http://org/a"]
    pages = spark.createDataFrame([(i if i != 4 else None, u, "x", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id is not None, r.page_id or 0), r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect())
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append(((i != 4, i if i != 4 else 0), host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"))
    assert got == sorted(want)
    assert url_filter.judge(pages.limit(0), RULES).count() == 0 and url_filter.judge(pages, ()).where("verdict = 'allow'").count() == len(urls)


def good_turing(hist):
    """Katz's factors for counts 1 to 5 from the counts of counts 1 to 6, as in his paper; None where they don't lie in (0, 1)."""
    k, n = 5, dict(enumerate(hist, 1))
    if not n[1] or (k + 1) * n[k + 1] == n[1]:
        return None
    common, out = (k + 1) * n[k + 1] / n[1], []
    for r in range(1, k + 1):
        if not n[r]:
            return None
        adjusted = (r + 1) * n[r + 1] / n[r]
        out.append((adjusted / r - common) / (1 - common))
    return out if all(0 < d < 1 for d in out) else None


def factors(hist):
    """Factors on counts 0 to 5; where Good and Turing's fail, those of one absolute discount."""
    if (d := good_turing(hist)) is None:
        cut = hist[0] / (hist[0] + 2 * hist[1]) if hist[0] and hist[1] else 0.5
        d = [1 - cut / r for r in range(1, 6)]
    return [0.0, *d]


def test_op4_discounts():
    # counts of counts of a Zipf-like text: the factors by hand
    assert good_turing([1000, 300, 150, 90, 60, 45]) == pytest.approx([(0.6 - 0.27) / 0.73, (0.75 - 0.27) / 0.73, (0.8 - 0.27) / 0.73, (60 * 5 / 90 / 4 - 0.27) / 0.73, (0.9 - 0.27) / 0.73])
    for hist in ([1000, 300, 150, 90, 60, 45], [10, 0, 0, 0, 0, 0], [0] * 6, [5, 4, 3, 2, 1, 9], [7, 3, 1, 0, 2, 1]):
        assert katz.discounts(hist) == pytest.approx(factors(hist))


def brute_katz(texts_, held, order, low=5):
    """Scores by id and p(word, history) of a Katz model written straight from its definition."""
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in texts_}
    count = [Counter() for _ in range(order + 1)]
    for (d, _), t in zip(texts_, (tokens[d] for d, _ in texts_), strict=True):
        if not held(d):
            padded = ["<s>", *t]
            for i, w in enumerate(t):
                count[1][(w,)] += 1
                for k in range(2, order + 1):
                    if i >= k - 2:
                        count[k][tuple(padded[i + 2 - k : i + 2])] += 1
    factor = [None, *(factors([sum(v == r for v in c.values()) for r in range(1, low + 2)]) for c in count[1:])]
    d = lambda k, c: factor[k][c] if c <= low else 1.0
    children = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in count[k].items():
            children[k].setdefault(g[:-1], {})[g[-1]] = c
    n = sum(count[1].values())
    left = sum((1 - d(1, c)) * c for c in count[1].values())

    def p(w, h):
        if not h:
            c, total = count[1][(w,)], n + (left <= 1e-9)
            return (d(1, c) * c if c else (left if left > 1e-9 else 1.0)) / total
        k = len(h) + 1
        if h not in children[k]:
            return p(w, h[1:])
        own = children[k][h]
        mass = sum((1 - d(k, c)) * c for c in own.values())
        total = sum(own.values()) + (mass <= 1e-12)
        if w in own:
            return d(k, own[w]) * own[w] / total
        return (mass if mass > 1e-12 else 1.0) / total / (1 - sum(p(v, h[1:]) for v in own)) * p(w, h[1:])

    score = {}
    for doc, t in tokens.items():
        padded = ["<s>", *t]
        score[doc] = sum(np.log10(p(w, tuple(padded[max(0, i + 2 - order) : i + 1]) if order > 1 else ())) for i, w in enumerate(t))
    return score, p, count


@pytest.mark.parametrize(("order", "chunks"), [(1, 1), (2, 4), (3, None), (3, 7), (4, 3)])
def test_op4(docs, rows, order, chunks):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    score, p, count = brute_katz([(r[0], r[1]) for r in rows], is_held, order)
    text, total = {r[0]: r[1] for r in rows}, sum(count[1].values())
    got = katz.score(docs, held, order, chunks).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    for r in got:
        t = [*WORD.findall((text[r.doc_id] or "").translate(LOWER)), None]
        base = sum(np.log10((count[1][(w,)] + 0.5) / (total + 0.5 * (len(count[1]) + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known) == (is_held(r.doc_id), len(t), sum(count[1][(w,)] > 0 for w in t))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score[r.doc_id])
    known = [w for (w,) in count[1]]
    for h in [(), ("<s>",), ("the",), ("nowhere",), (known[0],)][: 1 if order == 1 else 5]:
        assert sum(p(w, h) for w in [*known, "never seen"]) == pytest.approx(1)


def test_op4_uses_two_words_of_context(docs, rows):
    score, _, _ = brute_katz([(r[0], r[1]) for r in rows], lambda d: False, 3)
    for r in katz.score(docs, F.lit(None).cast("boolean")).collect():
        assert r.score == pytest.approx(score[r.doc_id])


def test_op4_contexts_without_low_counts(spark):
    """Contexts all of whose followers are frequent leave no mass by discounting, and get a count for the rest."""
    table = [(i, "a b c a b d") for i in range(9)] + [(20 + i, t) for i, t in enumerate(["a b x", "x", "b a c", "q r s", None])] + [(30 + i, f"rare{i} a") for i in range(3)]
    held = lambda d: 20 <= d < 30
    for order in (2, 3):
        score, _, _ = brute_katz(table, held, order)
        got = by_id(katz.score(spark.createDataFrame(table, "doc_id long, text string"), F.col("doc_id").between(20, 29), order, 2))
        assert all(r.score == pytest.approx(score[d]) for d, r in got.items()) and len(got) == len(table)
    nothing = katz.score(spark.createDataFrame(table, "doc_id long, text string"), F.lit(True)).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_op4_empty(empty):
    assert katz.score(empty, F.lit(False)).count() == 0


def test_op5(docs, rows, empty):
    tk = Tokenizer.from_file(WORDS)
    ids = [[*tk.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = packing.pack(docs, WORDS, capacity=256).collect()
    want = Counter((r[0], k, a, zlib.crc32(struct.pack(f"<{len(x[a : a + 256])}I", *x[a : a + 256]))) for r, x in zip(rows, ids, strict=True) for k, a in enumerate(range(0, len(x), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= 1.05 * sum(map(len, ids)) / 256 + 2
    assert packing.pack(empty, WORDS).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths = np.clip(rng.lognormal(4, 1, 3000).astype(int), 1, 512)
        counts = np.bincount(lengths, minlength=513)
        used = np.zeros(513, np.int64)
        chosen = packing.plan(counts, 512)
        for pattern, n in chosen:
            assert sum(pattern) <= 512
            for k in pattern:
                used[k] += n
        assert (used == counts).all()
        assert sum(n for _, n in chosen) <= 1.02 * -(-lengths.sum() // 512) + 1


def test_op6(docs, rows, empty):
    tk = Tokenizer.from_file(BYTES)
    want = {r[0]: (len((r[1] or "").encode()), len(tk.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}
    got = token_counts.token_counts(docs, BYTES, limit=100).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (*want[r.doc_id], want[r.doc_id][1] > 100) for r in got)
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_op6_prefixes():
    tk, counter = Tokenizer.from_file(BYTES), token_counts.counter(BYTES)
    for text in ["it's  <|endoftext|> x<|endoftext|>y'll   z\n\n <|endof", "  \n a 'l 'll", "café  déjà vu 123 !!"]:
        table = counter.table(text)
        n = [len(tk.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [table.count_at(len(text[:i].encode())) for i in range(len(text) + 1)] == n
        for budget in range(n[-1] + 1):
            assert table.longest_within(budget) == max(len(text[:i].encode()) for i in range(len(text) + 1) if n[i] <= budget)


def test_op6_budgets(spark, docs, rows, empty):
    """The longest prefix within a budget: one character more has too many tokens, as the library counts them."""
    tk = Tokenizer.from_file(BYTES)
    n = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    text = {r[0]: r[1] or "" for r in rows}
    for budget in (0, 1, 7, 50):
        got = token_counts.truncated(docs, BYTES, budget).collect()
        assert len(got) == len(rows)
        for r in got:
            t = text[r.doc_id]
            kept = t.encode()[: r.n_bytes].decode()
            assert n(kept) == r.n_tokens <= budget
            longer = [t[: len(kept) + k] for k in (1, 2, 3, 5) if len(kept) + k <= len(t)]
            assert all(n(x) > budget for x in longer)
    assert token_counts.truncated(empty, BYTES, 5).count() == 0


def removed(rows, window):
    first = {}
    docs = {r[0]: WORD.findall(r[1] or "") for r in rows}
    key = lambda d: (d is not None, d or 0)
    for d in sorted(docs, key=key):
        for i in range(len(docs[d]) - window + 1):
            first.setdefault(tuple(docs[d][i : i + window]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        out[d] = (w, gone)
    return out


@pytest.mark.parametrize("window", [5, 20])
def test_op7(docs, rows, empty, window):
    want = removed(rows, window)
    got = substring_dedup.digests(docs, window, chunks=5).collect()
    assert len(got) == len(rows)
    for r in got:
        w, gone = want[r.doc_id]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.digests(empty).count() == 0
    cleaned = substring_dedup.remove_repeats(docs, window, chunks=3)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        w, gone = want[r.doc_id]
        assert WORD.findall(r.text or "") == [x for x, g in zip(w, gone, strict=True) if not g]


def test_covers():
    for window in (2, 3, 5, 20, 50, 64):
        period, cover = substring_dedup.cover(window)
        assert period <= window and {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize(("cell", "small", "kind"), [(4096, 32, "double"), (8, 3, "double"), (8, 32, "double"), (4096, 32, "float")])
def test_op8(spark, cell, small, kind, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((4, 16))
    vectors = [(centre[i % 4] + 0.2 * rng.standard_normal(16)).tolist() for i in range(60)]
    vectors += [vectors[0], [2 * x for x in vectors[0]], [0.0] * 16, None, [], [float("nan")] * 16, [None, 1.0], [1e300 if kind == "double" else 1e38] * 16, [1.0] * 16]
    rows = [(i, v, i % 2 if i % 11 else None, "x") for i, v in enumerate(vectors)] + [(None, vectors[1], 1, "x")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, mark string"), missed=1e-9, cell=cell).collect()
    assert len(got) == len(rows)
    ok = {i: np.array(v) / np.abs(v).max() for i, v, label, _ in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    links = {i: {j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.93 * np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])} for i in ok}
    reach = {i: i for i in ok}
    for _ in rows:
        reach = {i: min([reach[i], *(reach[j] for j in links[i])]) for i in ok}
    for r in got:
        if r.vec_id in ok:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), reach[r.vec_id], reach[r.vec_id] == r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_op8_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    # an id that repeats with other vectors, and a vector that repeats under other ids and labels
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(4, one, 1), (4, two, 1), (9, two, 1), (3, one, 2), (2, one, 1), (4, one, 1)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(2, 2, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 2, 2, False), (4, 2, 2, False), (9, 1, 4, False)]


def test_op8_recall(spark):
    """Links of every row whose id is divisible by 10, against all rows: pairs just above the threshold, among the driver's vectors."""
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, np.array(r.embedding, np.float64), r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    pairs = []
    for k, (i, v, label) in enumerate(rows):
        u = rng.standard_normal(len(v))
        v = v / np.linalg.norm(v)
        u -= (u @ v) * v
        c = 0.93 + 0.02 * rng.random()
        pairs.append((100_000 + i, c * v + (1 - c * c) ** 0.5 * u / np.linalg.norm(u), label))
    rows += pairs
    x = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([r[2] for r in rows])
    want = (((x @ x.T) >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")).collect()}
    found = np.array([got[r[0]] for r in rows])
    asked = np.array([r[0] % 10 == 0 for r in rows])
    assert want.sum() >= 4000 and (found <= want).all() and found[asked].sum() >= 0.99 * want[asked].sum() and found.sum() >= 0.99 * want.sum()


def test_op9(docs, rows, empty):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        x = text[r.doc_id]
        w = WORD.findall(x)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in x.split("\n") if WORD.search(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    kept = Counter(r.doc_id for r in got if r.kept)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and Counter(r.doc_id for r in good.collect()) == kept


def test_op9_bands(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choices(["tion", "the", "er", "an", "re", "in"], k=rng.randint(1, 3))) for _ in range(400)]
    prose = [" ".join(rng.choices(vocab, k=150)) for _ in range(300)]
    noise = ["".join(rng.choices("qxzjkvw ", k=900)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + noise)], "doc_id long, text string, lang string")
    got = by_id(quality.judge(df))
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 303))


def test_op9_junk(spark):
    rng = random.Random(10)
    vocab = ["".join(rng.choices(["tion", "the", "er", "an", "re", "in", "lo", "su", "mi"], k=rng.randint(1, 4))) for _ in range(600)]
    prose = [" ".join(rng.choices(vocab, k=rng.randint(100, 400))) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "###", " | ", ""]) for w in rng.choices(vocab, k=150)) for _ in range(6)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    got = by_id(quality.judge(df))
    assert sum(got[i].kept for i in range(300)) >= 297 and not any(got[i].kept for i in range(300, 306))
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i in got if got[i].kept}


ONCE = {chr(k) for k in range(127) if not chr(k).isalnum()}


def characters(text):
    """What the language model reads of a text: letters without case, white space as blanks, runs of a blank or ASCII symbol as one, no leading blank."""
    out = []
    for c in re.sub("[\x09-\x0d]", " ", text.translate(LOWER)):
        if not (out and out[-1] == c and c in ONCE) and not (c == " " and not out):
            out.append(c)
    return out


def brute_kneser_ney(texts_, order=4):
    """p(character, three before) by modified Kneser-Ney, written from its definition."""
    counts = [None, *(Counter() for _ in range(order))]
    for t in texts_:
        padded = [" "] * (order - 1) + characters(t)
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
    for k in range(order, 1, -1):
        counts[k - 1].update(g[1:] for g in counts[k])
    cut = [None]
    for c in counts[1:]:
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        cut.append([0.0, *(min(max(r - (r + 1) * y * n[r + 1] / n[r], 0.05 * r), 0.95 * r) if n[r] else 0.5 * r for r in (1, 2, 3))])
    following = [None, *({} for _ in range(order))]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            following[k].setdefault(g[:-1], {})[g[-1]] = c

    def p(c, h):
        k = len(h) + 1
        own = following[k].get(tuple(h), {})
        lower = p(c, h[1:]) if h else 1 / len(counts[1])
        if not own:
            return lower
        d = lambda n: cut[k][min(n, 3)]
        return (own.get(c, 0) - d(own.get(c, 0)) + sum(map(d, own.values())) * lower) / sum(own.values())

    return p, {g[0] for g in counts[1]}


def brute_bits(rows, least):
    """Bits a character of each (id, text, language)."""
    size = Counter()
    for _, t, lang in rows:
        size[lang] += len((t or "").encode())
    model = lambda lang: lang if lang is not None and size[lang] >= least else None
    models = {m: brute_kneser_ney([t or "" for _, t, lang in rows if model(lang) == m])[0] for m in {model(r[2]) for r in rows}}
    out = []
    for d, t, lang in rows:
        c = [" "] * 3 + characters(t or "")
        bits = [-np.log2(models[model(lang)](c[i], c[i - 3 : i])) for i in range(3, len(c))]
        out.append((d, model(lang), sum(bits) / len(bits) if bits else None))
    return out


def test_kneser_ney_sums_to_one():
    p, alphabet = brute_kneser_ney([t or "" for t in texts()[:12]])
    for h in ("   ", "  w", "the", "zzz", "w1 "):
        assert sum(p(c, list(h)) for c in alphabet) == pytest.approx(1)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_op9_model_and_verdict(spark, rows, broadcast, monkeypatch):
    """Bits, bands and verdicts equal those written from the definition, whether the model is broadcast or asked by chunks."""
    monkeypatch.setattr(quality, "CHUNK", 1 << 14)
    monkeypatch.setattr(quality, "RANGE", 300)
    rng = random.Random(21)
    vocab = {"en": ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(200)], "de": ["".join(rng.choices("stuvwxé", k=rng.randint(2, 6))) for _ in range(200)]}
    table = [(i, " ".join(rng.choices(vocab[lang], k=rng.randint(55, 90))), lang) for i, lang in enumerate(["en", "de"] * 30)]
    table += [(100 + i, "".join(rng.choices("qzjx \u4e2d#", k=500)), "en") for i in range(2)] + [(200 + i, r[1], r[2]) for i, r in enumerate(rows)] + [(300, table[0][1], "en"), (300, table[0][1], "en")]
    got = quality.judge(spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3), least=6000, broadcast=broadcast).collect()
    want = brute_bits(table, 6000)
    assert len(got) == len(want)
    bits, base = {d: (m, b) for d, m, b in want}, {r.doc_id: r.base_failed for r in got}
    assert sum(r.doc_id == 300 for r in got) == 2
    assert {m for m, _ in bits.values()} == {"en", "de", None}
    for r in got:
        assert (r.bits is None) == (bits[r.doc_id][1] is None) and (r.bits is None or r.bits == pytest.approx(bits[r.doc_id][1], abs=2e-5))
    found = {m: sorted(round(b, 4) for d, x, b in want if x == m and b is not None and not base[d]) for m in ("en", "de", None)}
    for r in got:
        m, b = bits[r.doc_id]
        if base[r.doc_id]:
            assert not r.kept
            continue
        lo, hi = (found[m][int(np.ceil(q * len(found[m]))) - 1] for q in (0.25, 0.75))
        edge = min(abs(b - (lo - 3 * (hi - lo))), abs(b - (hi + 3 * (hi - lo))))
        assert edge < 1e-3 or r.kept == (lo - 3 * (hi - lo) <= b <= hi + 3 * (hi - lo))
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 60) >= 58  # test_op9_bands has enough text to tell noise


def test_op9_characters(spark):
    rng = random.Random(11)
    vocab = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(2)) for _ in range(300)]
    prose = [" ".join(rng.choices(vocab, k=150)) for _ in range(300)]
    odd = [" ".join(chr(rng.randrange(0x4E00, 0x9F00)) + chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(150)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(prose + odd)], "doc_id long, text string, lang string")
    got = by_id(quality.judge(df))
    assert sum(got[i].kept for i in range(300)) >= 297 and not any(got[i].kept for i in range(300, 303))


def test_op9_rare_languages(spark):
    rng = random.Random(12)
    vocab = {x: ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(300)] for x, letters in (("en", "abcdefgh"), ("xx", "ijklmnop"), ("yy", "qrstuvwx"))}
    rows = [(" ".join(rng.choices(vocab["en"], k=60)), "en") for _ in range(5200)]
    rows += [(" ".join(rng.choices(vocab[x], k=700)), x) for x in ("xx", "yy") for _ in range(25)]
    rows += [(" ".join(rng.choices(vocab["yy"], k=700)), "xx")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = by_id(quality.judge(df))
    assert all(got[i].kept for i in range(5200, 5250)) and not got[5250].kept


def test_op9_sequences():
    many = "".join(chr(x) for x in range(0x100, 0x9000)) + "".join(chr(x) for x in range(0x10000, 0x18000))
    texts_ = ["  Ab \n\t c", "", "é中\U0001F600x", "aa", many]
    raw = [x.encode() for x in texts_]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for rows in (slice(0, 4), slice(0, 5)):
        cut = offsets[rows.start : rows.stop + 1]
        code, first, split = quality.sequences(np.frombuffer(b"".join(raw[rows]), np.uint8), cut, np.arange(3, 3 + len(cut) - 1))
        a, b = split(code)
        for i, x in enumerate(texts_[rows]):
            y = re.sub(r"[ \n\t]+", " ", x.translate(LOWER)).lstrip()
            padded = [32, 32, 32, *map(ord, y)]
            want = [((3 + i) << 42 | padded[k] << 21 | padded[k + 1], padded[k + 2] << 21 | padded[k + 3]) for k in range(len(y))]
            assert list(zip(a[first[i] : first[i + 1]].tolist(), b[first[i] : first[i + 1]].tolist(), strict=True)) == want


@pytest.mark.parametrize("segment", [dac.SEGMENT, 4000])
def test_op10(spark, docs, rows, empty, segment):
    tk = Tokenizer.from_file(WORDS)
    segments = dac.write(docs, WORDS, segment=segment)
    got = dac.read(segments).collect()
    at, want = 0, Counter()
    every = []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        every += ids
        want[r[0], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    files = segments.orderBy("segment").collect()
    assert len(files) > 5 or segment > 4000
    # any id and document straight from a file, by seeks
    at = 0
    for f in files:
        s = dac.Segment.open(f.file)
        assert s.n == f.n_tokens and [s[i] for i in range(0, s.n, 37)] == every[at : at + s.n : 37]
        a, b = s.bounds[s.docs // 2 : s.docs // 2 + 2]
        assert s.document(s.docs // 2).tolist() == every[at + a : at + b]
        at += s.n
    assert at == len(every)
    assert dac.read(dac.write(empty, WORDS)).count() == 0


@pytest.mark.parametrize("low", [0, 1 << 53, 1 << 62, -(1 << 63)])
def test_op10_large_ids(spark, low):
    """Neighbouring ids that are one double, over many files, stay in the order of integers."""
    rng = random.Random(14)
    table = [(low + i, " ".join(rng.choices("abcdef", k=rng.randint(1, 90)))) for i in range(300)]
    rng.shuffle(table)
    segments = dac.write(spark.createDataFrame(table, "doc_id long, text string").repartition(3), WORDS, segment=2000)
    assert segments.count() > 8
    tk, at, want = Tokenizer.from_file(WORDS), 0, []
    for d, t in sorted(table):
        n = len(tk.encode(t, add_special_tokens=False).ids) + 1
        want.append((d, at, n))
        at += n
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in dac.read(segments).collect()) == want


def test_op10_common_ids(spark):
    """A third of the rows have one id and a third none: their rows are dealt to several files, and the order holds."""
    rng = random.Random(13)
    table = [(5 if i % 3 == 0 else None if i % 3 == 1 else i // 3, " ".join(rng.choices("abcdef", k=40))) for i in range(300)]
    segments = dac.write(spark.createDataFrame(table, "doc_id long, text string").repartition(3), WORDS, segment=2000)
    assert segments.agg(F.max("n_tokens")).first()[0] < 2500 and segments.count() > 8
    got = sorted(dac.read(segments).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in table), key=lambda d: (d is not None, d or 0))
    tk = Tokenizer.from_file(WORDS)
    crc = lambda t: zlib.crc32(struct.pack("<41I", *tk.encode(t, add_special_tokens=False).ids, 1))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((d, crc(t)) for d, t in table)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()


def test_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 300, 2000), rng.integers(0, 1 << 31, 500), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    data = dac.build(ids, [5, None, -3], np.array([2000, 0, 505]))
    s = dac.Segment.of(data)
    assert s.doc_ids == [5, None, -3] and (s.all() == ids).all()
    assert [s[i] for i in range(len(ids))] == ids.tolist() and s.document(2).tolist() == ids[2000:].tolist() and not len(s.document(1))
    for a, b in ((0, 1), (511, 513), (700, 2400), (2505, 2505)):
        assert (s.span(a, b) == ids[a:b]).all()


def nearest_kept(rows, size, percent):
    """Row numbers that near-duplicate removal keeps, by brute force; a repeated id stands for the smallest of its texts."""
    text = {}
    for d, t in ((r[0], r[1]) for r in rows):
        if d is not None and (d not in text or (t is not None and (text[d] is None or t < text[d]))):
            text[d] = t
    s = sets(list(text.items()), size)
    reach = {d: d for d in s}
    links = [(a, b) for a in s for b in s if a != b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    for _ in range(len(s)):
        before = dict(reach)
        for a, b in links:
            reach[a] = min(reach[a], reach[b])
        if before == reach:
            break
    return [i for i, r in enumerate(rows) if r[0] is None or reach[r[0]] == r[0]]


def odd_rows():
    """Long prose in two languages with near copies, shared passages, nulls, ties, repeated rows, a very long text."""
    rng = random.Random(31)
    vocab = {"en": ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)], "de": ["".join(rng.choices("stuvwxé", k=rng.randint(2, 6))) for _ in range(500)]}
    prose = [(lang, rng.choices(vocab[lang], k=rng.randint(60, 140))) for lang in ["en", "de"] * 40]
    passage = rng.choices(vocab["en"], k=70)
    out = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(prose)]
    out += [(200 + i, " ".join([*w[:20], *passage, *w[20:]]), lang) for i, (lang, w) in enumerate(prose[:6])]
    out += [(300 + i, " ".join([*w[:40], "changed", *w[41:]]), lang) for i, (lang, w) in enumerate(prose[10:14])]
    out += [(400, "".join(rng.choices("qzjx \u4e2d#", k=900)), "en"), (401, None, "en"), (402, "", None), (403, "few words", "de"), (404, " ".join(["same"] * 200), "en")]
    out += [(None, " ".join(prose[20][1]), "en"), (None, " ".join(prose[21][1]), None), out[3], out[3], (5, out[7][1], "en"), (500, " ".join(rng.choices(vocab["en"], k=30_000)), "en")]
    return [(d, t, lang, "s", len(t or ""), "clash", 7) for d, t, lang in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


def shown(rows):
    return Counter((r[0], r[1], r[2], r[5], r[6]) for r in rows)


def test_stage_quality(spark, odd, empty):
    import corpus_pipeline

    rows = odd_rows()
    bits = brute_bits([(i, r[1], r[2]) for i, r in enumerate(rows)], 1 << 16)
    failed = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed.append(len(w) < 50 or 100 * len(cover) > 50 * len(w))
    band = {}
    for m in {m for _, m, _ in bits}:
        own = sorted(round(b, 4) for (i, x, b) in bits if x == m and not failed[i] and b is not None)
        lo, hi = (own[int(np.ceil(q * len(own))) - 1] for q in (0.25, 0.75))
        band[m] = (lo - 3 * (hi - lo), hi + 3 * (hi - lo))
    sure = [min(abs(b - band[m][0]), abs(b - band[m][1])) > 1e-3 if b is not None else True for _, m, b in bits]
    assert all(sure)
    got = corpus_pipeline.quality(spark, odd, "")
    assert got.columns == odd.columns
    assert shown(got.collect()) == shown(r for i, r in enumerate(rows) if not failed[i] and band[bits[i][1]][0] <= bits[i][2] <= band[bits[i][1]][1])
    assert corpus_pipeline.quality(spark, empty, "").count() == 0


def test_stage_near_duplicates(spark, odd, empty):
    import corpus_pipeline

    rows = odd_rows()
    got = corpus_pipeline.near_duplicates(spark, odd, "")
    assert got.columns == odd.columns and shown(got.collect()) == shown(rows[i] for i in nearest_kept(rows, 5, 80))
    assert len(rows) - got.count() >= 4 and corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_stage_passages(spark, odd, empty):
    import corpus_pipeline

    rows = odd_rows()
    first = {}
    key = lambda d: (d is not None, d or 0)
    for r in sorted(rows, key=lambda r: key(r[0])):
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            at = (key(r[0]), i)
            first[tuple(w[i : i + 50])] = min(at, first.get(tuple(w[i : i + 50]), at))
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] != (key(r[0]), i):
                gone[i : i + 50] = [True] * 50
        want[r[0], tuple(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    got = corpus_pipeline.repeated_passages(spark, odd, "")
    assert got.columns == odd.columns
    assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in got.collect()) == want
    assert got.where("text IS NULL").count() == 1 and got.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert corpus_pipeline.repeated_passages(spark, empty, "").count() == 0


def test_stage_packing(spark, odd, empty):
    import corpus_pipeline

    tk = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in odd_rows():
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.update((r[0], k, a, min(4096, len(ids) - a), zlib.crc32(struct.pack(f"<{len(ids[a : a + 4096])}I", *ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096)))
    got = corpus_pipeline.packing(spark, odd, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096 and len(at) <= sum(at.values()) // 4096 + 2
    assert corpus_pipeline.packing(spark, empty, "").count() == 0


def test_very_long_texts(spark):
    """Texts beyond a slice, a chunk and a batch: 12 MB of words, 3 MB without a blank, and copies of both."""
    rng = random.Random(41)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(4000)]
    long_ = " ".join(rng.choices(vocab, k=2_000_000))
    solid = "".join(rng.choices(["ab", "cde", "7", "\u4e2d", "-"], k=1_400_000))
    rows = [(1, long_), (2, solid), (3, long_), (4, solid), (5, "short"), (6, long_[: len(long_) // 2])]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(2)
    text = dict(rows)
    byte_ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_ranks, special_tokens={})
    ids = {d: enc.encode_ordinary(text[d]) for d in (1, 2, 6)}
    ids |= {3: ids[1], 4: ids[2]}
    for r in bpe_codec.digests(df, P.path("byte_bpe_50k.tiktoken")).where("doc_id <> 5").collect():
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(struct.pack(f"<{len(ids[r.doc_id])}I", *ids[r.doc_id])).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, BYTES).where("doc_id <> 5").collect()} == {d: len(x) for d, x in ids.items()}
    tk = Tokenizer.from_file(WORDS)
    word_ids = {d: [*tk.encode(text[d], add_special_tokens=False).ids, 1] for d in (2, 5, 6)}
    assert {r.doc_id: r.ids_crc32 for r in dac.read(dac.write(df, WORDS)).where("doc_id IN (2, 5, 6)").collect()} == {d: zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for d, x in word_ids.items()}
    assert packing.pack(df, WORDS).agg(F.sum("length")).first()[0] == 2 * len(tk.encode(long_, add_special_tokens=False).ids) + 2 + 2 * len(word_ids[2]) + len(word_ids[5]) + len(word_ids[6])
    near = by_id(minhash.near_duplicates(df))
    assert (near[3].component_id, near[4].component_id, near[5].component_id, near[6].component_id) == (1, 2, 5, 6)
    gone = by_id(substring_dedup.digests(df))
    assert gone[1].n_words == gone[3].n_removed == 2_000_000 and gone[1].n_removed == gone[4].n_removed == 0
    assert gone[6].n_words - gone[6].n_removed <= 1  # its last word is cut
    scores = by_id(katz.score(df, F.col("doc_id") == 6))
    assert scores[1].n_tokens == 2_000_001 and scores[1].score == pytest.approx(scores[3].score)
    judged = by_id(quality.judge(df))
    assert judged[1].n_words == 2_000_000 and judged[1].bits == judged[3].bits


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, sf)
        assert out.columns == names and [f.dataType for f in out.schema.fields] == [f.dataType for f in spark.read.parquet(f"{sf}/documents.parquet").schema.fields], k
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.count()
