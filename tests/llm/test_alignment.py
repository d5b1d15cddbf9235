"""Cross-tokenizer alignment against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxelry.llm import alignment, registry
from voxelry.llm.textops import raw, texts

SCHEMA = "doc_id long, text string, pair string, chunk int"
A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SPACE = "▁"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    parts = [" ", "  ", "a", "the", "\n", "\t", SPACE, "<0x41>", "<s>", "</s>", "<unk>", "é", "好", "\U0001f600", "\0", "1", "12", "'s", " ", "　", "<|endoftext|>", "\r\n", "ﬁ", "don't"]
    words = [f"w{i}" for i in range(80)] + ["The", "naïve", "1234", "###"]
    odd = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    return odd + [" ".join(rng.choices(words, k=rng.choice([1, 20, 200]))) for _ in range(60)] + ["", None, "   ", SPACE, " " * 3000 + "x", "x" * 9000, "\n" * 5000, "word " * 8000]


def tokens(libraries, text):
    """Ids and byte strings of both, or none."""
    a, b = libraries
    byte = dict(zip((chr(c) for c in [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True))
    byte |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in byte.values())}
    if not text:
        return [], []
    one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        hit = re.fullmatch("<0x(..)>", piece)
        two.append((i, bytes([int(hit[1], 16)]) if hit else piece.replace(SPACE, " ").encode()))
    same = all(b"".join(s for _, s in side) == f" {text}".encode() for side in (one, two))
    return (one, two) if same else ([], [])


def links(one, two):
    """(a, b) of all tokens that share a byte, and the groups as text."""
    out, groups = [], []
    spans = []
    for side in (one, two):
        ends = np.cumsum([len(s) for _, s in side]).tolist()
        spans.append([(e - len(s), e, i) for (i, s), e in zip(side, ends, strict=True)])
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    sides = [_by_group(side, ends) for side in spans]
    for k in range(len(ends)):
        x, y = sides[0][k], sides[1][k]
        groups.append(",".join(str(t[2]) for t in x) + "|" + ",".join(str(t[2]) for t in y))
        out += [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
    return out, groups


def _by_group(spans, ends):
    found = defaultdict(list)
    for t in spans:
        found[int(np.searchsorted(ends, t[1]))].append(t)
    return found


def brute(libraries, rows):
    each = [tokens(libraries, text) for _, text, *_ in rows]
    found = [links(*t) for t in each]
    count = Counter(p for f in found for p in set(f[0]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, *_), t, (pairs, groups) in zip(rows, each, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(t[0]), len(t[1]), len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


def test_equals_brute_force(spark, libraries, cases):
    rows = [(i, t, "clash", 1) for i, t in enumerate(cases)] + [(None, "a row without id", None, None), (None, None, None, None), (3, cases[3], "again", 2), (3, "other text", None, None)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(5), A_PATH, B_PATH)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(libraries, rows), key=repr)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes).replace("bigint", "long") == alignment.SCHEMA


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A_PATH, B_PATH).count() == 0
    only = alignment.align(spark.createDataFrame([(7, "", None, None)], SCHEMA), A_PATH, B_PATH)
    assert [tuple(r) for r in only.collect()] == [(7, 0, 0, 0, 0, 0, 0, "")]


def test_units_are_encoded_as_whole_texts(libraries, cases):
    side = alignment.PieceSide(B_PATH)
    some = [f" {t}" for t in cases if t and SPACE not in t]  # with that character a text is not spelled by its tokens, whatever they are
    ids, first = side.encode(*raw(texts(__import__("pyarrow").array(some))))
    assert [ids[x:y].tolist() for x, y in zip(first, first[1:], strict=False)] == [libraries[1].encode(t[1:]) for t in some]


def test_query(spark, sf, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.queries()["op11_alignment"](spark, sf).collect()), key=repr) == sorted(brute(libraries, rows), key=repr)
