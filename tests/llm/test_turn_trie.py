"""The trie of conversation prefixes against brute force, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from voxelry.llm import registry, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, part int"


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    turns, members, ends, out = defaultdict(list), defaultdict(list), defaultdict(list), []
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, key(role or "", text or ""), (role or "", text or "")))
    seq = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(seq.get(c - c % 5, [])[:h] + own[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    for p, m in members.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = sum(len(below[q]) == 1 for q in below[p])
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    odd = [(rng.choice([None, *range(40), -7, 1 << 62]), rng.choice([None, 0, 1, 2, 3, -1]), rng.choice([None, "u", "a", ""]), rng.choice([None, "", "x", "yé", "z" * 5, "a" * 40_000]), "clash", 3) for _ in range(300)]
    copies = [(100 + 5 * k + j, t, "u", f"t{t}", None, None) for k in range(60) for j in range(5) for t in range(3)]
    long_ = [(7001, t, "u", f"t{t % 3}", None, None) for t in range(150)]
    return odd + copies + long_ + odd[:20]


@pytest.mark.parametrize("share", [100, 700, 1 << 24])
def test_trie_equals_brute_force(spark, rows, share):
    """Copies, prefixes and long runs that lie across many partitions, within one, and all in one."""
    arrays = turn_trie.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = turn_trie.trie(arrays, share=share)
    assert got.columns == list(turn_trie.COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_runs_of_ids_come_in_parts(spark, rows, monkeypatch):
    parts = turn_trie._run(3, 1, list(range(10 ** 6, 10 ** 6 + 300_000)))
    assert len(parts) > 1 and b",".join(p[4] for p in parts) == ",".join(map(str, range(10 ** 6, 10 ** 6 + 300_000))).encode()


def test_no_rows(spark):
    assert turn_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert turn_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "u", "x", None, None)], SCHEMA)).count() == 0


def test_without_turns(spark):
    """A conversation shorter than what it takes from one that isn't there has no turns: the root alone."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 1, "u", "x", None, None)]
    assert sorted(map(tuple, turn_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = registry.queries()["op13_turn_trie"](spark, sf)
    want = con.execute(registry.oracle_sql()["op13_turn_trie"])
    names = [d[0] for d in want.description]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
