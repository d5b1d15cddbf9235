"""Chunks that arrive one after the other against all at once, and labels of runs against brute force."""

import itertools
import random

import pytest

from voxelry.model import Grid
from voxelry.operators import labelling, sharing
from voxelry.storage import Scratch
from voxelry.streaming.linking import ChunkLinks

VOXEL = "t int, z int, y int, x int"


@pytest.mark.parametrize(("dims", "full", "periodic"), [(("t", "z", "y", "x"), False, ()), (("t", "z", "y", "x"), True, ("x",)), (("z", "y", "x"), False, ("y", "x")), (("z", "y", "x"), True, ("z", "y", "x")), (("y", "x"), True, ("x",)), (("x",), False, ("x",))])
def test_labels_of_runs(spark, dims, full, periodic, monkeypatch):
    """Against flooding, for long rows and short stretches; nulls, repeated voxels and columns of clashing names."""
    monkeypatch.setattr(labelling, "STRETCH", 3)
    sizes = {"t": 2, "z": 3, "y": 4, "x": 9}
    rng = random.Random(len(dims) + full)
    names = ("t", "z", "y", "x")
    cells = [p for p in itertools.product(*(range(n) for n in sizes.values())) if rng.random() < (0.25 if full else 0.5)]
    axes = [names.index(d) for d in dims]
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(dims)) if any(s) and (full or sum(map(abs, s)) == 1)]
    left, want = set(cells), []
    while left:
        part, queue = set(), [left.pop()]
        while queue:
            p = queue.pop()
            part.add(p)
            for s in steps:
                q = list(p)
                for a, k in zip(axes, s, strict=True):
                    q[a] += k
                    if names[a] in periodic:
                        q[a] %= sizes[names[a]]
                if (q := tuple(q)) in left:
                    left.remove(q)
                    queue.append(q)
        want.append(frozenset(part))
    rows = [(*p, "a", 5, 7) for p in cells] + [(*cells[0], "again", 5, 7), (None, 0, 0, 0, "b", 5, 7), (0, 0, 0, None, "b", 5, 7)]
    df = spark.createDataFrame(rows, f"{VOXEL}, component string, node int, label int").withColumnRenamed("component", "a.b").repartition(3)
    grid = Grid(**sizes)
    got = labelling.label(df, grid, Scratch(spark), dims=dims, full=full, periodic=periodic)
    assert sorted(got.columns) == sorted([*names, "a.b", "node", "label"])
    found = {}
    for r in got.collect():
        found.setdefault(r.label, []).append((r.t, r.z, r.y, r.x))
    assert sorted(map(frozenset, found.values()), key=min) == sorted(want, key=min)
    assert [min(found[k]) for k in sorted(found)] == sorted(min(p) for p in want) and sorted(found) == list(range(1, len(want) + 1))
    assert sum(map(len, found.values())) == len(cells) + 1
    big = labelling.label(df.drop("label"), grid, Scratch(spark), dims=dims, full=full, periodic=periodic, min_size=4).select(*names).distinct().count()
    assert big == sum(len(p) for p in want if len(p) + (cells[0] in p) >= 4)


def test_runs_move_fewer_rows(spark):
    """A run asks once for each direction and stretch, however many voxels it has."""
    df = spark.createDataFrame([(0, 0, y, x) for y in range(4) for x in range(500)], VOXEL)
    grid = Grid(z=1, y=4, x=500)
    rows = labelling.runs(df, grid).groupBy("t", "z", "y", "first").agg({"x": "min"}).count()
    assert rows == 4 and labelling.neighbours(df, grid).count() > 3000
    spans = labelling.runs(df, grid).groupBy("t", "z", "y", "first").agg(labelling.F.min("x").alias("lo"), labelling.F.max("x").alias("hi"))
    assert labelling.run_neighbours(spans, grid).count() == 3
    assert 'ArrowEvalPython' not in labelling.run_neighbours(spans, grid)._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    cells = [(t, 0, y, x) for t in range(12) for y in range(6) for x in range(6) if rng.random() < 0.45 and t != 8]
    grid, parts = Grid(z=1, y=6, x=6, t=12), []
    for lo, hi in ((0, 3), (3, 6), (6, 7), (7, 8), (9, 12)):  # one of a step, and a gap
        parts.append(labelling.label(spark.createDataFrame([c for c in cells if lo <= c[0] < hi], VOXEL), grid, Scratch(spark)).select("t", "z", "y", "x", "label"))
    return grid, parts, [3, 6, 7, 9]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.new, set()).add((r.chunk, r.old))
    return out


def test_arriving_chunks_equal_all_at_once(spark, chunks):
    grid, parts, borders = chunks
    links, scratch = ChunkLinks(spark, Scratch(spark).folder("links")), Scratch(spark)
    now = {}
    for k, part in enumerate(parts):
        told = {r.old: r.new for r in links.add(k, part).collect()}
        assert all(old > new and old < k << 40 for old, new in told.items())
        assert {r.old: r.new for r in links.add(k, part).collect()} == told  # given again, nothing changes
        want = groups(sharing.link_chunks(parts[: k + 1], borders[:k], grid, scratch)[1].collect()) if k else None
        if k:
            assert groups(links.links(scratch).collect()) == want
            before = {m: frozenset(g) for g in now.values() for m in g}
            assert {m for m in before if k and any(m in g and g & set(before) != before[m] for g in want.values())} <= {m for g in now.values() for m in g}
        now = groups(links.links(scratch).collect())
    with pytest.raises(ValueError, match="comes before"):
        links.add(9, parts[0])


def test_stream_of_chunks(spark, chunks, tmp_path):
    """Files of a chunk each, in two runs of the query; the second takes only what is new."""
    _, parts, _ = chunks
    source, scratch = f"{tmp_path}/in", Scratch(spark)
    links, alone = ChunkLinks(spark, f"{tmp_path}/links"), ChunkLinks(spark, f"{tmp_path}/alone")
    for k, part in enumerate(parts):
        alone.add(k, part)
    for some in (range(0, 2), range(2, len(parts))):
        for k in some:
            parts[k].withColumn("chunk", labelling.F.lit(k)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("t int, z int, y int, x int, label long, chunk int").option("maxFilesPerTrigger", 1).parquet(source)
        links.follow(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert groups(links.links(scratch).collect()) == groups(alone.links(scratch).collect())


def test_chunks_without_voxels(spark, tmp_path):
    links, none = ChunkLinks(spark, str(tmp_path)), spark.createDataFrame([], f"{VOXEL}, label long")
    some = spark.createDataFrame([(5, 0, 0, 0, 1), (5, 0, 0, 0, 1), (5, 0, 0, 1, None), (5, 0, 0, 2, 0)], f"{VOXEL}, label long")
    for k, part in enumerate((none, some, none, some)):
        assert links.add(k, part).count() == 0
    assert groups(links.links(Scratch(spark)).collect()) == {1: {(1, 1)}, 2: {(3, 1)}}


@pytest.mark.parametrize(("dims", "full", "periodic"), [(("t", "z", "y", "x"), True, ("t", "y", "x")), (("z", "y", "x"), False, ())])
def test_labels_of_blocks(spark, dims, full, periodic, monkeypatch):
    """Blocks of any size give the same labels, and only what touches their borders is left for components()."""
    rng, grid, ties = random.Random(7), Grid(t=4, z=2, y=96, x=9), []
    cells = [p for p in itertools.product(range(4), range(2), range(96), range(9)) if rng.random() < 0.4]
    df = spark.createDataFrame(cells, VOXEL)
    monkeypatch.setattr(labelling, "components", lambda edges, scratch, f=labelling.components: ties.append(edges.count()) or f(edges, scratch))
    out = []
    for block in ({"t": 32, "z": 8, "y": 32}, {"t": 1, "z": 1, "y": 2}):
        monkeypatch.setattr(labelling, "BLOCK", block)
        out.append(sorted(labelling.label(df, grid, Scratch(spark), dims=dims, full=full, periodic=periodic).collect()))
    assert out[0] == out[1] and len(out[0]) == len(cells)
    assert 0 < ties[0] < len(cells) / 10 < ties[1]


def test_large_tables_stay_on_executors(spark):
    """What is written in between is joined by shuffles, however small its files are; only the numbers of ranges, a row each, are broadcast."""
    chunk = labelling.label(spark.createDataFrame([(t, 0, y, 1) for t in range(3) for y in range(3)], VOXEL), Grid(), Scratch(spark))
    voxels, links = sharing.link_chunks([chunk.where("t < 2"), chunk.where("t = 2")], [2], Grid(), Scratch(spark))
    for df in (chunk, voxels, links):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and all("_range" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
