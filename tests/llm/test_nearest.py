"""Approximate nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.llm import nearest, registry

SCHEMA = "vec_id long, embedding array<float>, label int, node string, code int"


def brute(rows, asks, k):
    """query_id: all (score, vec_id), largest first, ties to the smaller vec_id."""
    good = sorted({(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])})
    dim = max((len(v) for _, v in good), default=0)
    x = np.zeros((len(good), dim))
    for i, (_, v) in enumerate(good):
        x[i, : len(v)] = np.array(v, np.float32)
    out = {}
    for i, (q, _) in enumerate(good):
        if asks(q):
            s = (x * x[i]).sum(axis=1)
            out[q] = sorted((-float(s[j]), w) for j, (w, _) in enumerate(good) if w != q)[:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((-r.score, r.vec_id))
    return out


def recall(got, want):
    return np.mean([len({w for _, w in got.get(q, [])} & {w for _, w in v}) / len(v) for q, v in want.items() if v])


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in r], 0, "clash", 1) for i, r in enumerate(np.asarray(x, np.float32))]


def test_few_rows_are_exact(spark):
    """Ties, copies, lengths that differ, and rows that take no part."""
    rng = np.random.default_rng(1)
    same = [3.0, 0.0, 0.0, 4.0]
    rows = rows_of(rng.standard_normal((40, 4)) * rng.uniform(0.01, 100, (40, 1)))
    rows += [(100 + i, same, None, None, None) for i in range(40)] + [(200, [5.0], 0, None, 0), (201, [0.0, 2.0], 0, None, 0), (202, [1e30, -1e30], 0, None, 0), (203, [1e-30], 0, None, 0)]
    rows += [(300, None, 0, None, 0), (301, [], 0, None, 0), (302, [0.0, 0.0], 0, None, 0), (303, [1.0, None], 0, None, 0), (304, [float("nan")], 0, None, 0), (305, [float("inf")], 0, None, 0), (None, [1.0, 2.0], 0, None, 0)]
    rows += [rows[3], rows[3], (101, same, 9, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = by_query(nearest.nearest(df, F.col("vec_id") % 20 < 2)), brute(rows, lambda q: q % 20 < 2, 20)
    assert got.keys() == want.keys()
    for q, v in want.items():
        assert [w for _, w in got[q]] == [w for _, w in v], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in v], rtol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_hardly_any_rows(spark, n):
    rows = rows_of([[1.0, 2.0], [3.0, 4.0]][:n])
    got = by_query(nearest.nearest(spark.createDataFrame(rows, SCHEMA), F.lit(True)))
    assert got == {q: v for q, v in brute(rows, lambda q: True, 20).items() if v}


def test_recall_with_crowds_and_norms(spark, monkeypatch):
    """A third of the rows near one vector, another sixth equal, norms from 1 to 9; small bounds, so that crowds are dealt out."""
    monkeypatch.setattr(nearest, "CROWD", 40)
    monkeypatch.setattr(nearest, "GROUP", 1 << 18)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    x *= rng.uniform(1, 9, (1500, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    x[500:1000] = x[500] + 0.01 * rng.standard_normal((500, 24))
    x[1000:1250] = x[1000]
    rows = rows_of(x)
    got, want = by_query(nearest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95


def test_vectors_that_are_not_in_the_index(spark):
    rng = np.random.default_rng(3)
    rows, asked = rows_of(rng.standard_normal((600, 8))), rows_of(rng.standard_normal((30, 8)), first=10 ** 6)
    index = nearest.build(spark.createDataFrame(rows, SCHEMA))
    found = by_query(index.search(spark.createDataFrame(asked, SCHEMA).select(F.col("vec_id").alias("query_id"), "embedding"), k=10))
    assert recall(found, {q: [p for p in v if p[1] < 10 ** 6][:10] for q, v in brute(rows + asked, lambda q: q >= 10 ** 6, 10 ** 4).items()}) >= 0.9


def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = by_query(registry.queries()["op12_nearest"](spark, sf)), brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
