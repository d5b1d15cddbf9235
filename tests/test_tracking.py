"""The component tree and optimal links against brute force."""

import itertools
import random

import pytest

from voxelry.model import Grid
from voxelry.operators import assign, component_tree, detect
from voxelry.storage import Scratch

VOXEL = "t int, z int, y int, x int, v double"


def flooded(cells, sizes, periodic):
    """Sets of voxels that faces join."""
    left, out = set(cells), []
    while left:
        part, queue = set(), [left.pop()]
        while queue:
            p = queue.pop()
            part.add(p)
            for d in (1, 2, 3):
                for s in (-1, 1):
                    q = list(p)
                    q[d] += s
                    if d in periodic:
                        q[d] %= sizes[d]
                    if (q := tuple(q)) in left:
                        left.remove(q)
                        queue.append(q)
        out.append(frozenset(part))
    return out


@pytest.mark.parametrize(("block", "periodic"), [(2, ()), (3, ("x",)), (3, ("z", "y", "x")), (64, ("y",))])
def test_tree_equals_brute_force(spark, block, periodic):
    rng = random.Random(block)
    sizes = (2, 3, 7, 8)
    cells = {p: rng.choice([0, 1, 2, 3, 4]) + rng.random() for p in itertools.product(*map(range, sizes)) if rng.random() < 0.8}
    marks = [1.0, 2.0, 3.0, 4.5]
    rows = [(*p, v) for p, v in cells.items()] + [(0, 0, 0, None, 9.0), (0, 0, 0, 0, None)]
    rows = [r for r in rows if r[:4] != (0, 0, 0, 0)] + [(0, 0, 0, 0, 4.9)]
    cells[0, 0, 0, 0] = 4.9
    field = spark.createDataFrame(rows, VOXEL).repartition(3)
    grid, scratch = Grid(z=3, y=7, x=8), Scratch(spark)
    where = tuple(("t", "z", "y", "x").index(d) for d in periodic)
    want = {k: flooded([p for p, v in cells.items() if v >= m], sizes, where) for k, m in enumerate(marks)}
    voxels, nodes = component_tree.tree(field, "v", marks, grid, scratch, periodic, block)
    region = {r.node: r.region for r in nodes.collect()}
    found = {}
    for r in voxels.collect():
        assert len(r.nodes) == sum(r.v >= m for m in marks)
        for k, n in enumerate(r.nodes):
            found.setdefault((k, region[n]), set()).add((r.t, r.z, r.y, r.x))
    assert {(k, frozenset(p)) for (k, _), p in found.items()} == {(k, p) for k, parts in want.items() for p in parts}
    ups = {(r.level, r.region): r.up for r in nodes.collect()}
    assert all(found[k, r] <= found[k - 1, u] for (k, r), u in ups.items() if k) and all(u is None for (k, _), u in ups.items() if not k)
    size = {}
    for r in nodes.collect():
        size[r.level, r.region] = size.get((r.level, r.region), 0) + r.n
    assert size == {k: len(p) for k, p in found.items()}
    own = {}
    for r in component_tree.leaves(voxels, nodes, marks, 3).collect():
        own.setdefault((r["rank"], r.region), set()).add((r.t, r.z, r.y, r.x))
    kept = [(k, p) for k, parts in want.items() for p in parts if len(p) >= 3]
    assert {(k, frozenset(p)) for (k, _), p in own.items()} == {(k, p) for k, p in kept if not any(j > k and q <= p for j, q in kept)}


def test_thresholds_share_one_pass(spark):
    """As many tables are written for six thresholds as for two."""
    rows = [(0, 0, y, x, float((y * 7 + x * 3) % 11)) for y in range(12) for x in range(12)]
    field, made = spark.createDataFrame(rows, VOXEL), []
    for marks in ([1.0, 5.0], [1.0, 2.0, 3.0, 5.0, 7.0, 9.0]):
        scratch = Scratch(spark)
        component_tree.tree(field, "v", marks, Grid(z=1, y=12, x=12), scratch)
        made.append(scratch.n)
    assert made[0] == made[1]


def test_tree_of_nothing(spark):
    field = spark.createDataFrame([(0, 0, 0, 0, 0.5)], VOXEL)
    features, members = detect.detect_features(field, "v", [1.0, 2.0], 1, Grid(), Scratch(spark))
    assert features.count() == 0 and members.count() == 0


def exhaustive(edges, alone):
    """All ways to give each a, in order, one of its b or none: the least total, then the smallest b first."""
    first = sorted({a for a, _, _ in edges})
    cost, best = {(a, b): d for a, b, d in edges}, None
    for picks in itertools.product(*([b for x, b, _ in sorted(edges) if x == a] + [10 ** 9] for a in first)):
        used = [b for b in picks if b < 10 ** 9]
        if len(used) == len(set(used)):
            key = (sum(cost.get((a, b), alone) for a, b in zip(first, picks, strict=True)), picks)
            best = min(best or key, key)
    return {a: b for a, b in zip(first, best[1], strict=True) if b < 10 ** 9}


def subnets(edges):
    left, out = list(edges), []
    while left:
        part, more = [left.pop()], True
        while more:
            hit = [e for e in left if any(e[0] == p[0] or e[1] == p[1] for p in part)]
            more = bool(hit)
            part += hit
            left = [e for e in left if e not in hit]
        out.append(part)
    return out


def test_links_of_least_total(spark):
    """Many subnets with ties, numbers that are first and second ends, farther and repeated pairs."""
    rng = random.Random(5)
    edges = {}
    for net in range(60):
        for _ in range(rng.randint(1, 7)):
            edges[net * 10 + rng.randint(1, 4), net * 10 + rng.randint(5, 8) - 10 * rng.randint(0, 1)] = rng.choice([0.25, 0.5, 0.5, 1.0, 2.0, 3.5])
    rows = [(a, b, d) for (a, b), d in edges.items()] + [(a, b, d + 0.1) for (a, b), d in list(edges.items())[:9]] + [(None, 1, 0.1), (1, None, 0.1), (1, 2, None)]
    want = {}
    for part in subnets([(a, b, d) for (a, b), d in edges.items() if d <= 3]):
        want |= exhaustive(part, 3.0)
    got = assign.least_total(spark.createDataFrame(rows, "a long, b long, d double"), 3 ** 0.5, Scratch(spark))
    assert {r.a: r.b for r in got.collect()} == want


def test_radius_adapts(spark):
    """A chain of features that all compete falls apart within a smaller radius; what can't fall apart is refused."""
    rows = [(i, 100 + i, 0.04 + 0.001 * i) for i in range(20)] + [(i, 101 + i, 0.5) for i in range(19)]
    df = spark.createDataFrame(rows, "a long, b long, d double")
    got = assign.least_total(df, 1.0, Scratch(spark), most=4, step=0.5, stop=0.2)
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, 100 + i) for i in range(20)]
    with pytest.raises(ValueError, match="more than 4"):
        assign.least_total(df.withColumn("d", df.d * 0), 1.0, Scratch(spark), most=4, step=0.5, stop=0.2)
    assert assign.least_total(df.where("false"), 1.0, Scratch(spark)).count() == 0


def test_least_total_gives_other_tracks(spark):
    """The nearest pair first leaves one feature alone; the least total keeps both tracks."""
    rows = [(1, 0, 0.0), (2, 0, 1.0), (3, 1, 0.9), (4, 1, 1.9)]
    df = spark.createDataFrame([(f, t, 0.0, 0.0, x) for f, t, x in rows], "feature long, t int, zc double, yc double, xc double")
    near, best = ({r.feature: r.cell for r in detect.link_features(df, 1.5, Scratch(spark), subnet=s).collect()} for s in (None, detect.Subnet()))
    assert near[2] == near[3] and near[1] != near[3] and near[4] not in (near[1], near[2])
    assert best[1] == best[3] and best[2] == best[4]


def test_large_parts_go_on_by_rounds(spark, monkeypatch):
    """A row of features whose distances all tie: one connected part, beyond what a task may finish."""
    monkeypatch.setattr(detect, "PART", 3)
    n = 5
    rows = [(i + 1, 0, 0.0, 0.0, float(i)) for i in range(n)] + [(n + i + 1, 1, 0.0, 0.0, i + 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "feature long, t int, zc double, yc double, xc double")
    got = {r.feature: r.cell for r in detect.link_features(df, 0.6, Scratch(spark), min_steps=2, most_rounds=0).collect()}
    assert all(got[i + 1] == got[n + i + 1] == i + 1 for i in range(n))
