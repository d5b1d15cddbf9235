"""Golden cases and brute-force checks of the analytics operators."""

import datetime
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions import convection, grids, profiles
from voxelry.functions import physics as ph
from voxelry.model import Grid
from voxelry.operators import bundles, detect, environment, erosion, graph, labelling, lineage, sharing, skew, stats
from voxelry.sources import netcdf, readers
from voxelry.storage import Scratch
from voxelry.streaming import windows

VOXEL = "t int, z int, y int, x int"


def mask(spark, rows, extra="label long"):
    return spark.createDataFrame(rows, f"{VOXEL}, {extra}")


def labels(df, column="label"):
    return {(r.t, r.z, r.y, r.x): r[column] for r in df.collect()}


def test_faces_join_and_diagonals_dont(spark):
    v = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1)], VOXEL)
    got = labels(labelling.label(v, Grid(), Scratch(spark)))
    assert got == {(0, 0, 0, 0): 1, (1, 0, 0, 0): 1, (0, 0, 1, 1): 2}
    assert set(labels(labelling.label(v, Grid(), Scratch(spark), full=True)).values()) == {1}


def test_periodic_wraps_in_every_slice(spark):
    v = spark.createDataFrame([(0, z, 0, x) for z in (0, 1) for x in (0, 14)], VOXEL)
    assert set(labels(labelling.label(v, Grid(), Scratch(spark), dims=("z", "y", "x"), periodic=("x",))).values()) == {1}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_equal_union_find(spark, one_task):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (103, 103)]
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark), one_task).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_no_rows(spark):
    v = spark.createDataFrame([], VOXEL)
    assert labelling.label(v, Grid(), Scratch(spark)).count() == 0


def test_share_map(spark):
    current = mask(spark, [(0, 0, 0, 0, 1), (0, 0, 0, 1, 1), (0, 0, 5, 5, 2)])
    update = mask(spark, [(0, 0, 0, 0, 5), (0, 0, 0, 1, 3)])
    assert {r.old: r.new for r in sharing.share_map(current, update).collect()} == {1: 3, 2: 0}


def test_link_over_a_border(spark):
    first = mask(spark, [(0, 0, 0, x, k) for x, k in ((0, 1), (1, 1), (3, 2), (4, 2))])
    second = mask(spark, [(1, 0, 0, x, 1) for x in (1, 2, 3)])
    out, links = sharing.link_chunks([first, second], [1], Grid(), Scratch(spark))
    assert set(labels(out).values()) == {1}
    assert links.count() == 3


def test_max_union(spark):
    assert labels(labelling.union_masks([mask(spark, [(0, 0, 0, 0, 4)]), mask(spark, [(0, 0, 0, 0, 9)])])) == {(0, 0, 0, 0): 9}


def test_erosion_golden(spark):
    inside = mask(spark, [(0, 0, y, x, 1) for y in range(2, 7) for x in range(2, 7)])
    assert set(labels(erosion.weighted_erode(inside, 10, 10))) == {(0, 0, y, x) for y in range(3, 6) for x in range(3, 6)}
    corner = mask(spark, [(0, 0, y, x, 1) for y in range(5) for x in range(5)])
    topo = {(r.y, r.x): r.topography for r in erosion.topography(corner, 10, 10).collect()}
    assert topo[0, 0] == 1 and topo[4, 4] == pytest.approx(0.2)
    assert set(labels(erosion.weighted_erode(corner, 10, 10))) == {(0, 0, y, x) for y in range(3) for x in range(3)}


def test_topography_brute(spark):
    rng = random.Random(3)
    cells = {(y, x): rng.choice([1, 1, 2]) for y in range(9) for x in range(9) if rng.random() < 0.8}
    got = {(r.y, r.x): r.distance for r in erosion.topography(mask(spark, [(0, 0, y, x, k) for (y, x), k in cells.items()]), 9, 9).collect()}
    for (y, x), k in cells.items():
        assert got[y, x] == pytest.approx(min(math.hypot(y - a, x - b) for a in range(9) for b in range(9) if cells.get((a, b)) != k))


def test_topography_in_volume(spark):
    """Distances over three axes, for labels that touch one another, fill rows, and fill a whole volume."""
    rng = random.Random(4)
    cells = {(z, y, x): rng.choice([1, 1, 1, 2]) for z in range(5) for y in range(6) for x in range(7) if rng.random() < 0.93}
    df = mask(spark, [(0, *p, k) for p, k in cells.items()] + [(1, z, y, x, 3) for z in range(5) for y in range(6) for x in range(7)])
    got = {(r.t, r.z, r.y, r.x): r.distance for r in erosion.topography(df, 6, 7, z_size=5).collect()}
    every = [(z, y, x) for z in range(5) for y in range(6) for x in range(7)]
    for p, k in cells.items():
        assert got[0, *p] == pytest.approx(min(math.dist(p, o) for o in every if cells.get(o) != k))
    assert all(got[1, *p] is None for p in every)


def test_large_discs_erode(spark):
    n = 41
    disc = mask(spark, [(0, 0, y, x, 1) for y in range(n) for x in range(n) if math.hypot(y - 20, x - 20) < 18])
    got = {(r.y, r.x): r.distance for r in erosion.topography(disc, n, n).collect()}
    inside = set(got)
    border = [(y, x) for y in range(n) for x in range(n) if (y, x) not in inside]
    assert all(d == pytest.approx(min(math.hypot(y - a, x - b) for a, b in border)) for (y, x), d in got.items())


def test_lookup_leaves_heavy_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0), (None, 9), (4, 1)] + [(5, i) for i in range(40)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, w string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = sorted((r.k, r.v, r.w) for r in left.join(right, ["k"], how).collect() if r.k is not None)
        for least in (5, 1000):
            got = skew.lookup(left, right, ["k"], counts, how, least=least)
            assert sorted((r.k, r.v, r.w) for r in got.collect() if r.k is not None) == want and got.count() == left.join(right, ["k"], how).count()


PROFILE = "col long, lev int, tw double"


def test_anvil_bases(spark):
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate([1, 3, 5, 3, 1, 2, 4, 6, 3])], PROFILE)
    assert profiles.anvil_base(df, ("col",)).first().abh == 4
    assert profiles.anvil_base_old(df, ("col",)).first().abh == 6


def test_gradients(spark):
    df = spark.createDataFrame([(1, x, float(x * x)) for x in (0, 1, 3, 4)], PROFILE).withColumn("x", F.col("lev").cast("double"))
    one = df.select("lev", profiles.derivative(("col",), "x", F.col("tw")).alias("a"), profiles.gradient(("col",), "lev", F.col("x"), F.col("tw")).alias("b")).orderBy("lev").collect()
    assert [r.a for r in one] == pytest.approx([1, 2, 6, 7]) and [r.b for r in one] == pytest.approx([0, 2, 6, 8])


def test_tropopause(spark):
    df = spark.createDataFrame([(1, k, float(t), k * 1000.0) for k, t in enumerate([300, 291, 282, 273, 264, 262, 261, 260])], "col long, lev int, ta double, zg double")
    assert profiles.tropopause(df, ("col",)).first().tropopause == 5


def test_lifetime(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in ((0, 2.0), (1, 6.0), (2, 4.0))] + [(2, 0, 1.0)], "k long, t int, v double")
    rows = lineage.lifetime_normalised(df, "k", ["t"], "v", 4).orderBy("k", "bin").collect()
    assert [r.value for r in rows if r.k == 1] == [2, 4, 6, 5, 4]
    assert [r.value for r in rows if r.k == 2] == [None] * 5


def test_longitudes(spark):
    df = spark.createDataFrame([(1, x) for x in (170.0, 175.0, -175.0)] + [(2, 10.0)], "g long, lon double")
    got = {r.g: (r.lonn, r.lonx, r.crosses) for r in environment.circular_extent(df, ("g",)).collect()}
    assert got == {1: (170, 185, True), 2: (10, 10, False)}


def test_grid_slices_agree(spark):
    assert grids.axis(-83, -82.9, 0.1, -180)[0] == 970
    whole = {(r.iy, r.ix): (r.lat, r.lon) for r in grids.grid_points(spark, (-10, 10, -10, 10), 0.5).collect()}
    part = {(r.iy, r.ix): (r.lat, r.lon) for r in grids.grid_points(spark, (-3.2, 4.1, -2, 2), 0.5).collect()}
    assert part and all(whole[k] == v for k, v in part.items())


def test_watershed_equals_kruskal(spark):
    rng = random.Random(5)
    height = {(y, x): float(rng.randrange(1, 40)) for y in range(7) for x in range(7)}
    seeds = {(1, 1): 1, (5, 5): 2, (1, 5): 3}
    grid = Grid(z=1, y=7, x=7)
    got = detect.watershed(spark.createDataFrame([(0, 0, y, x, v) for (y, x), v in height.items()], f"{VOXEL}, v double"), "v", spark.createDataFrame([(0, 0, y, x, k) for (y, x), k in seeds.items()], f"{VOXEL}, feature long"), 0.0, grid, Scratch(spark))
    number = lambda p: p[0] * 7 + p[1]
    edges = sorted((-min(height[a], height[b]), number(a), number(b), a, b) for a in height for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)) if b in height)
    part = {p: p for p in height}
    owner = {p: seeds.get(p) for p in height}

    def find(p):
        while part[p] != p:
            p = part[p]
        return p

    for _, _, _, a, b in edges:
        a, b = find(a), find(b)
        if a != b and not (owner[a] and owner[b]):
            owner[a] = owner[a] or owner[b]
            part[b] = a
    assert {(r.y, r.x): r.feature for r in got.collect()} == {p: owner[find(p)] for p in height}


def test_links_are_nearest_first(spark):
    rows = [(1, 0, 0.0, 0.0), (2, 0, 0.0, 3.0), (3, 1, 0.0, 1.0), (4, 1, 0.0, 2.9), (5, 2, 0.0, 1.5), (6, 5, 0.0, 1.5)]
    df = spark.createDataFrame([(f, t, 0.0, y, x) for f, t, y, x in rows], "feature long, t int, zc double, yc double, xc double")
    got = {r.feature: (r.cell, r.time_cell) for r in detect.link_features(df, 1.6, Scratch(spark), min_steps=2).collect()}
    assert got == {1: (1, 0), 3: (1, 1), 5: (1, 2), 2: (2, 0), 4: (2, 1), 6: (0, 0)}


def test_links_of_a_long_row(spark):
    """Evenly spaced features shifted by half a step: all distances tie, so a round settles one pair."""
    n = 12
    rows = [(i + 1, 0, 0.0, 0.0, float(i)) for i in range(n)] + [(n + i + 1, 1, 0.0, 0.0, i + 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "feature long, t int, zc double, yc double, xc double")
    for rounds in (0, 3, 30):
        got = {r.feature: r.cell for r in detect.link_features(df, 0.6, Scratch(spark), min_steps=2, most_rounds=rounds).collect()}
        assert all(got[i + 1] == got[n + i + 1] == i + 1 for i in range(n))


def test_links_follow_velocities(spark):
    """Two features that pass each other: by place alone they swap, by velocity they don't; a new one borrows its neighbour's."""
    rows = [(1, 0, 0.0, 0.0), (2, 1, 0.0, 1.0), (3, 2, 0.0, 2.0), (4, 3, 0.0, 3.0), (11, 0, 0.4, 4.0), (12, 1, 0.4, 3.0), (13, 2, 0.4, 2.2), (14, 3, 0.4, 1.0)]
    df = spark.createDataFrame([(f, t, 0.0, y, x) for f, t, y, x in rows], "feature long, t int, zc double, yc double, xc double")
    got = {r.feature: r.cell for r in detect.link_features(df, 1.7, Scratch(spark), predict=2).collect()}
    assert got[1] == got[2] == got[3] == got[4] and got[11] == got[12] == got[13] == got[14] and got[1] != got[11]


@pytest.mark.parametrize(("shape", "sigma", "reach"), [((5, 7, 6), 0.9, 4), ((1, 3, 2), 1.3, 5)])
def test_smoothing_equals_definition(spark, shape, sigma, reach):
    rng = random.Random(2)
    field = {p: rng.random() for p in np.ndindex(shape) if rng.random() < 0.6}
    got = {(r.z, r.y, r.x): r.v for r in detect.smooth(spark.createDataFrame([(0, *p, v) for p, v in field.items()], f"{VOXEL}, v double"), "v", sigma, Grid(z=shape[0], y=shape[1], x=shape[2])).collect()}
    dense = np.zeros(shape)
    for p, v in field.items():
        dense[p] = v
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in range(3):
        padded = np.pad(dense, [(reach, reach) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        dense = sum(np.take(padded, np.arange(k, k + shape[axis]), axis) * w[k] / w.sum() for k in range(2 * reach + 1))
    assert all(got.get(p, 0.0) == pytest.approx(dense[p], abs=1e-12) for p in np.ndindex(shape))


def test_detection_options(spark):
    """An object over a periodic border has its centre there; erosion drops what is thin."""
    grid = Grid(z=1, y=9, x=12)
    rows = [(0, 0, y, x, 2.0) for y in (3, 4, 5) for x in (11, 0, 1)] + [(0, 0, 8, x, 2.0) for x in range(4, 9)]
    df = spark.createDataFrame(rows, f"{VOXEL}, v double")
    found = detect.detect_features(df, "v", [1.0], 1, grid, Scratch(spark), periodic=("x",))[0].collect()
    assert sorted((r.size, round(r.yc, 6), round(r.xc, 6) % 12) for r in found) == [(5, 8.0, 6.0), (9, 4.0, 0.0)]
    inner = detect.detect_features(spark.createDataFrame([(0, 0, y, x, 2.0) for y in (3, 4, 5) for x in (3, 4, 5)] + rows[9:], f"{VOXEL}, v double"), "v", [1.0], 1, grid, Scratch(spark), erode=1)[0].collect()
    assert [(r.size, r.yc, r.xc) for r in inner] == [(1, 4.0, 4.0)]
    close = spark.createDataFrame([(0, 0, 1, 1, 5.0), (0, 0, 1, 3, 2.0), (0, 0, 7, 7, 2.0)], f"{VOXEL}, v double")
    kept = detect.detect_features(close, "v", [1.0, 4.0], 1, grid, Scratch(spark), min_distance=2.5)[0].collect()
    assert sorted((r.yc, r.xc) for r in kept) == [(1.0, 1.0), (7.0, 7.0)]


def test_methods(spark):
    v = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 1)], VOXEL)
    assert labelling.connect(v, Grid(), Scratch(spark), "corners").select("label").distinct().count() == 1
    with pytest.raises(ValueError):
        labelling.connect(v, Grid(), Scratch(spark), "nearest")


def test_watershed_raises_unsettled(spark):
    df = spark.createDataFrame([(0, 0, 0, x, 5.0 - x / 10) for x in range(9)], f"{VOXEL}, v double")
    seeds = spark.createDataFrame([(0, 0, 0, 0, 1)], f"{VOXEL}, feature long")
    with pytest.raises(RuntimeError):
        detect.watershed(df, "v", seeds, 0.0, Grid(z=1, y=1, x=9), Scratch(spark), most_rounds=1)


def test_bundles_by_name(spark, sf):
    from voxelry.sources.adapters import grid_field, grid_mask

    field, cells = grid_field(spark, sf), grid_mask(spark, sf)
    out = bundles.compute({"a": {"function": "bulk"}, "b": {"function": "cloudy", "parameters": {"dxy": 5000.0}}}, cells, field)
    assert set(out) == {"a", "b"} and out["b"]["t"].columns[:2] == ["system", "t"]
    ratio = out["a"]["t"].select("system", "t", "cloud_volume").join(out["b"]["t"].select("system", "t", F.col("cloud_volume").alias("other")), ["system", "t"]).select((F.col("cloud_volume") / F.col("other")).alias("r")).first().r
    assert ratio == pytest.approx((11 / 5) ** 2)
    with pytest.raises(ValueError):
        bundles.compute({"a": {"function": "none"}}, cells, field)
    most = bundles.largest_slice(cells).agg(F.max("size")).first()[0]
    small = bundles.compute({"a": {"function": "bulk"}}, cells, field, max_size=most - 1)["a"]["t"]
    assert 0 < small.select("system").distinct().count() < cells.select("system").distinct().count()
    exported = stats.export(bundles.older_statistics(cells, field)["tz"])
    assert exported.where("cloud_cmf_mu IS NULL").count() == 0 and exported.where(f"cloud_cmf_mu = {stats.MISSING}").count() > 0
    env = bundles.flow_environment(field, bundles.first_updrafts(cells).select("system", "t", (F.col("x") * 0.5).alias("clon"), (F.col("y") * 0.5).alias("clat")), [1.0, 2.0], convection=True)
    assert {"cape_in1", "lcl_in2", "tropo_around2"} <= set(env.columns)
    assert env.where("lcl_in2 BETWEEN 50000 AND 100100").count() > 0


def test_anvil_below_base(spark):
    df = spark.createDataFrame([(1, k) for k in range(5)], "system long, z int")
    base = spark.createDataFrame([(1, 2.5)], "system long, abh double")
    assert sorted(r.z for r in profiles.anvil_mask(df, base, ("system",), "z", above=False).collect()) == [0, 1, 2]
    assert [r.d for r in spark.createDataFrame([(1, k, -float(k)) for k in range(3)], "c int, z int, h double").select(profiles.descends(("c",), "z", F.col("h")).alias("d")).collect()] == [True] * 3


def test_transect(spark):
    centre = spark.createDataFrame([(1, 0, 2, 2)], "system long, t int, y int, x int")
    wind = spark.createDataFrame([(1, 0, 3.0, 4.0)], "system long, t int, u double, v double")
    field = spark.createDataFrame([(0, 0, y, x, float(10 * y + x)) for y in range(6) for x in range(6)], f"{VOXEL}, q double")
    got = {r.step: r.q for r in environment.transect(centre, wind, field, 6, 6, "q").collect()}
    for step, q in got.items():
        assert q == pytest.approx(10 * (2 + 0.8 * step) + 2 + 0.6 * step)
    assert set(got) == {-2, -1, 0, 1, 2, 3}


def test_local_times(spark):
    df = spark.createDataFrame([("2021-07-01 12:00:00", -60.2, "America/Manaus"), ("2021-07-01 12:00:00", 31.0, None)], "u string, lon double, zone string")
    got = df.select(environment.local_time(F.to_timestamp("u"), F.col("lon"), F.col("zone")).cast("string").alias("a")).collect()
    assert [r.a for r in got] == ["2021-07-01 08:00:00", "2021-07-01 14:00:00"]


def test_divergence(spark):
    """A wind that grows eastward by 1 m/s a degree, at the equator."""
    field = spark.createDataFrame([(0, 0, y, x, float(x), 0.0, (y - 1) * 1.0) for y in range(3) for x in range(4)], f"{VOXEL}, ua double, va double, lat double")
    got = {(r.y, r.x): r.div for r in stats.divergence(field, 1.0, F.col("lat")).collect()}
    assert got[1, 1] == pytest.approx(1 / (math.radians(1) * 6371229.0)) and got[1, 0] is None and got[0, 1] is None


def test_parcel_is_sane():
    p = np.array([[100000.0, 90000, 80000, 70000, 60000, 50000, 40000]])
    t = np.array([[303.0, 293, 286, 279, 271, 262, 251]])
    cape, cin, lfc, lcl = convection.instability(p, t, np.full_like(t, 0.85))
    assert cape[0] > 500 and cin[0] <= 0 and 90000 < lcl[0] < 100000 and lfc[0] <= 100000
    assert np.isnan(convection.instability(p[:, :4], t[:, :4], np.full((1, 4), 0.8))[0][0])


def test_readers(spark, tmp_path):
    assert readers.chained(["b_20240101T0600_20240101T1200.nc", "a_20240101T0000_20240101T0600.nc"])[0].startswith("a_")
    with pytest.raises(ValueError):
        readers.chained(["a_20240101T0000_20240101T0600", "b_20240101T0700_20240101T0800"])
    stages, made = readers.Checkpoints(spark, str(tmp_path)), []
    for _ in range(2):
        df = stages.get("part_3", lambda: made.append(1) or spark.range(3))
    assert len(made) == 1 and df.count() == 3 and stages.last(r"part_(\d+)") == 3
    s = readers.Sources(spark)
    assert readers.file_contains("a_20240101T0000_20240101T0600.nc", "20240101T0500", "20240102T0000") and not readers.file_contains("a_20240101T0000_20240101T0600.nc", "20240101T0700", "20240102T0000")
    s.register("five", lambda sp: sp.createDataFrame([(0, 1.0, 270.0), (0, 2.0, 280.0)], "t int, total double, ta double"), rename={"total": "qall"})
    assert [r.qfrozen for r in s.load("five", ["qfrozen"]).collect()] == [1.0, None]


def test_catalogue_of_sources(spark, tmp_path):
    cells = grids.grid_points(spark, (-62, -60, -4, -2), 0.5).select(ph.healpix(F.col("lon"), F.col("lat"), 6).alias("cell")).distinct().withColumn("temp", F.col("cell").cast("double"))
    cells.write.parquet(str(tmp_path / "cells"))
    spark.createDataFrame([(1, -61.0, -3.0, 5.0), (2, 50.0, 0.0, 6.0)], "time int, lon double, lat double, ta double").write.parquet(str(tmp_path / "grid"))
    (tmp_path / "c.yaml").write_text(f"cells: {{path: {tmp_path}/cells, rename: {{temp: ta}}, zoom: 6, step: 0.5}}\ngrid: {{path: {tmp_path}/grid}}\n")
    s = readers.Sources(spark)
    assert s.catalogue(str(tmp_path / "c.yaml")) == ["cells", "grid"]
    got = s.load("cells", region=(-62, -60, -4, -2)).collect()
    assert len(got) == 16 and all(r.ta == spark.createDataFrame([(r.lon, r.lat)], "a double, b double").select(ph.healpix(F.col("a"), F.col("b"), 6).alias("p")).first().p for r in got[:3])
    assert [r.time for r in s.load("grid", start=0, end=2, region="amazon").collect()] == [1] and s.load("grid", region="congo").count() == 0
    with pytest.raises(KeyError):
        s.load("none")
    assert readers.version_path("/r/", "v1", "amazon", datetime.datetime(2021, 7, 1)) == "/r/v1/amazon/20210701"


def classic(version, dims, variables, records):
    """A file of the classic NetCDF formats: variables (name, dims, type, attributes, values); the first dimension is the unlimited one."""
    number = (lambda n: struct.pack(">q", n)) if version == 5 else lambda n: struct.pack(">i", n)
    text = lambda x: number(len(x)) + x.encode() + bytes(-len(x) % 4)
    names = list(dims)

    def attributes(a):
        out = struct.pack(">i", 12 if a else 0) + number(len(a))
        for k, v in a.items():
            data = np.array([v], ">f8").tobytes() if isinstance(v, float) else v.encode()
            out += text(k) + struct.pack(">i", 6 if isinstance(v, float) else 2) + number(1 if isinstance(v, float) else len(v)) + data + bytes(-len(data) % 4)
        return out

    def header(begins):
        out = b"CDF" + bytes([version]) + number(records) + struct.pack(">i", 10) + number(len(dims)) + b"".join(text(d) + number(0 if d == names[0] else n) for d, n in dims.items()) + attributes({"title": "odd"})
        out += struct.pack(">i", 11) + number(len(variables))
        for (name, own, kind, a, values), begin in zip(variables, begins, strict=True):
            out += text(name) + number(len(own)) + b"".join(number(names.index(d)) for d in own) + attributes(a) + struct.pack(">i", kind) + number(values.nbytes) + (struct.pack(">i", begin) if version == 1 else struct.pack(">q", begin))
        return out

    at, begins, fixed = len(header([0] * len(variables))), [], b""
    moving = [v for v in variables if v[1][0] == names[0]]
    for v in variables:
        if v not in moving:
            fixed += v[4].tobytes() + bytes(-v[4].nbytes % 4)
    pad = lambda b: b if len(moving) == 1 else b + bytes(-len(b) % 4)
    place, step = at, at + len(fixed)
    for v in variables:
        if v in moving:
            begins.append(step)
            step += len(pad(v[4][:1].tobytes()))
        else:
            begins.append(place)
            place += -(-v[4].nbytes // 4) * 4
    return header(begins) + fixed + b"".join(pad(v[4][k : k + 1].tobytes()) for k in range(records) for v in moving)


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf(spark, tmp_path, version):
    rng = np.random.default_rng(version)
    paths, want = [], {}
    for f, records in enumerate((2, 3)):
        q, w = rng.integers(-50, 50, (records, 3, 3)).astype(">i2"), rng.standard_normal((records, 3, 3)).astype(">f4")
        q[0, 1, 1], w[0, 1, 1], w[1, 2, 0] = -99, -999.0, -999.0
        lat, time = np.array([-1.0, 0.0, 1.0], ">f8"), (np.arange(records) + 10.0 * f).astype(">f8")
        data = classic(version, {"time": records, "lat": 3, "lon": 3}, [("lat", ("lat",), 6, {"units": "degrees"}, lat), ("q", ("time", "lat", "lon"), 3, {"_FillValue": -99.0, "scale_factor": 0.5, "add_offset": 2.0}, q), ("time", ("time",), 6, {}, time), ("w", ("time", "lat", "lon"), 5, {"missing_value": -999.0}, w)], records)
        paths.append(str(tmp_path / f"{f}.nc"))
        (tmp_path / f"{f}.nc").write_bytes(data)
        for k in range(records):
            for y in range(3):
                for x in range(3):
                    if (k, y, x) != (0, 1, 1):
                        want[2 * f + k, y, x] = (10.0 * f + k, lat[y], 2 + q[k, y, x] / 2, None if (k, y, x) == (1, 2, 0) else float(w[k, y, x]))
    df = netcdf.read_netcdf(spark, paths, ["q", "w"])
    assert df.columns == ["time", "lat", "lon", "time_at", "lat_at", "q", "w"]
    assert {(r.time, r.lat, r.lon): (r.time_at, r.lat_at, r.q, r.w) for r in df.collect()} == want
    with pytest.raises(ValueError):
        netcdf.read_netcdf(spark, paths, ["q", "lat"])
    (tmp_path / "no.nc").write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError):
        netcdf.read_netcdf(spark, [str(tmp_path / "no.nc")], ["q"])


def test_zones(spark):
    zones = spark.createDataFrame([("wide", -80.0, -40.0, -20.0, 10.0), ("Manaus", -61.0, -59.0, -4.0, -2.0)], "zone string, lon0 double, lon1 double, lat0 double, lat1 double")
    points = spark.createDataFrame([(1, -60.0, -3.0), (2, -70.0, 5.0), (3, 0.0, 0.0)], "k int, lon double, lat double")
    assert {r.k: r.zone for r in environment.with_zone(points, zones).collect()} == {1: "Manaus", 2: "wide", 3: None}


def test_boxes_and_systems(spark):
    start = datetime.datetime(2021, 7, 1)
    rows = [(s, start + datetime.timedelta(minutes=15 * k), -60.0 + 0.1 * k + 40 * (s == 2), -3.0) for s in (1, 2) for k in range(8)]
    cells = spark.createDataFrame(rows, "system long, time timestamp, lon double, lat double")
    cat = spark.createDataFrame([(1, start, 2.0, -60.0, -3.0), (2, start, 2.0, 100.0, 50.0)], "dcc long, initial_time timestamp, lifetime double, initial_lon double, initial_lat double")
    assert [readers.grab_system(cells, cat, s).count() for s in (1, 2, 3)] == [8, 8, 0]
    field = cells.select("time", "lon", "lat")
    one = readers.corresponding(field, cells.where("system = 1 AND lon > -59.75"), margin=0.01)
    assert one.count() == 5 and readers.corresponding(field, cells.limit(0)).count() == 0
    assert readers.corresponding(field, cells.where("system = 1 AND lon > -59.75"), margin=0.2, before_minutes=30).count() == 7


def test_batches(spark):
    df = spark.createDataFrame([(s, v) for s in (9, 2, 5, 7, 7) for v in (1, 2)], "system long, v int")
    assert sorted({r.system for r in readers.load_results(df, batch=1, size=2).collect()}) == [7, 9]
    assert sorted({r.system for r in readers.load_results(df, systems=[2, 5, 9], ignore=[5], apply=lambda d: d.where("v = 1")).collect()}) == [2, 9]
    assert [r.system for r in readers.keep_first(df, ["system"], ["v"]).orderBy("system").collect()] == [2, 5, 7, 9]
    assert [(r.system, r.n) for r in readers.repeated(df.where("v = 1"), "system").collect()] == [(7, 2)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b,c")], "k int, v double, s string")
    readers.write_csv(df, str(tmp_path / "c"))
    readers.write_csv(df.limit(1), str(tmp_path / "c"), append=True)
    assert sorted((r.k, r.v, r.s) for r in readers.read_csv(spark, str(tmp_path / "c"), "k int, v double, s string").collect()) == [(1, 2.5, "a"), (1, 2.5, "a"), (2, None, "b,c")]
    cells = spark.createDataFrame([(0, 0, 0, 0, 4.0), (0, 0, 0, 1, 0.0), (0, 0, 0, 2, None)], f"{VOXEL}, label double")
    readers.save_mask(cells, str(tmp_path / "m"))
    assert [(r.x, r.label) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [(0, 4)]
    for d in ("d1", "d2"):
        (df if d == "d1" else df.drop("s")).write.parquet(str(tmp_path / "r" / d))
    assert readers.day_records(spark, str(tmp_path / "r"), ["d1", "d2"]).where("s IS NULL").count() == 2
    assert readers.with_height(spark.createDataFrame([(0,), (1,), (5,)], "z int"), [100.0, 1600.0]).orderBy("z").select("height").collect() == [(100.0,), (1600.0,)]
    assert readers.level_slice(spark.range(9).withColumnRenamed("id", "z"), 2, 4).count() == 3


def test_projections(spark):
    rows = [(t, z, y, x, 1.0 + x, 260.0 if z else 300.0, 1.0, 100.0, float(y)) for t in range(4) for z in range(2) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(rows, f"{VOXEL}, qall double, ta double, rho double, dzghalf double, wa double")
    flat = readers.projection(df, "2d_5xy_30min").collect()
    assert {r.t for r in flat} == {0, 2} and {(r.x, r.iwp, r.wmax) for r in flat if r.y == 1} == {(0, 100.0, 1.0), (1, 200.0, 1.0)}
    coarse = readers.projection(df, "2d_10xy_15min").collect()
    assert {(r.iwp, r.wmax) for r in coarse} == {(150.0, 0.5)} and len(coarse) == 4
    assert set(readers.projection(df, "3d_5xy_15min").columns) == {"t", "z", "y", "x", "qfrozen", "wa"}


def test_regions(spark):
    assert grids.region_box("congo") == (1, 41, -15, 15) and grids.region_box((0, 1, 2, 3)) == (0, 1, 2, 3)
    with pytest.raises(KeyError):
        grids.region_box("nowhere")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.start, r.event_type, r.n, r.vmax) for r in rows)
    assert key(spark.sql("SELECT * FROM w").collect()) == key(windows.counts(events).collect())
