"""Ranges of HEALPix cells that cover boxes, and distances by envelopes, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions import cover, grids
from voxelry.functions.physics import healpix
from voxelry.operators import erosion
from voxelry.storage import Scratch


def test_centres_lie_in_their_cells(spark):
    for zoom in (0, 1, 3):
        cells = np.arange(12 << 2 * zoom)
        lon, lat = cover.centres(cells, zoom)
        df = spark.createDataFrame(list(zip(cells.tolist(), lon.tolist(), lat.tolist(), strict=True)), "cell long, lon double, lat double")
        assert df.where(healpix(F.col("lon"), F.col("lat"), zoom) != F.col("cell")).count() == 0


@pytest.mark.parametrize("box", [(-83, -43, -15, 15), (280, 325, -15, 10), (-180, 180, 60, 90), (170, 200, -90, -70), (-180, 180, -90, 90), (10, 10, 5, 5), (350, 371, 40, 50)])
@pytest.mark.parametrize("most", [3, 64])
def test_covers_hold_their_boxes(spark, box, most):
    ranges = cover.cover(box, 5, most)
    assert 0 < len(ranges) <= most and all(a <= b for a, b in ranges) and all(p[1] + 1 < n[0] for p, n in zip(ranges, ranges[1:], strict=False))
    rng = random.Random(1)
    points = [(rng.uniform(box[0], box[1]), rng.uniform(box[2], box[3])) for _ in range(3000)] + [(float(x), float(y)) for x in box[:2] for y in box[2:]]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("cell", healpix(F.col("lon"), F.col("lat"), 5))
    df = Scratch(spark).save(df)
    assert df.where(~cover.within(F.col("cell"), ranges)).count() == 0


def test_covers_are_narrow():
    share = sum(b - a + 1 for a, b in cover.cover((-83, -43, -15, 15), 6)) / (12 << 12)
    assert share < 0.1  # the box itself is 0.029 of the sphere
    assert cover.cover((5, -5, 0, 1), 6) == [] == cover.cover((0, 1, 5, -5), 6)


def test_ranges_reach_the_scan(spark):
    cells = Scratch(spark).save(spark.range(12 << 10).select(F.col("id").alias("cell"), (F.col("id") * 2).alias("value")))
    out = grids.regrid(grids.region_cells(cells, "anatomy_example", 5, 0.5), "anatomy_example", 5, 0.5)
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(cell," in plan and "LessThanOrEqual(cell," in plan
    points = grids.grid_points(spark, grids.region_box("anatomy_example"), 0.5).withColumn("cell", healpix(F.col("lon"), F.col("lat"), 5)).join(cells, "cell").drop("cell")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, points.collect())) and out.count() > 100


def test_curve(spark):
    from voxelry.sources.layout import morton

    with pytest.raises(ValueError, match="fit"):
        morton([F.col(c) for c in "tzyx"], 16)


def test_boxes_read_less_along_the_curve(spark, tmp_path):
    """The same rows from a box; of the bytes in row groups that it can't do without, far fewer than in a table sorted by time alone."""
    from pyarrow import parquet

    from voxelry.sources import layout

    df = spark.range(32 * 2 * 64 * 64).selectExpr("id % 32 AS t", "(id div 32) % 2 AS z", "(id div 64) % 64 AS y", "(id div 4096) AS x", "rand(3) AS v")
    df = Scratch(spark).save(df)
    layout.save_along_curve(df, f"{tmp_path}/curve", rows=1 << 16, group=1 << 15)
    df.repartitionByRange(4, "t").sortWithinPartitions("t", "v").write.option("parquet.block.size", 1 << 15).option("parquet.block.size.row.check.min", 1000).parquet(f"{tmp_path}/plain")
    box, bounds = "t BETWEEN 4 AND 11 AND z = 1 AND y BETWEEN 16 AND 23 AND x < 8", {"t": (4, 11), "z": (1, 1), "y": (16, 23), "x": (0, 7)}
    rows = [sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{n}").where(box).select("t", "z", "y", "x", "v").collect())) for n in ("curve", "plain")]
    assert rows[0] == rows[1] and len(rows[0]) == 8 * 8 * 8

    def needed(folder):
        total, asked = 0, 0
        for f in folder.glob("*.parquet"):
            meta = parquet.ParquetFile(f).metadata
            names = meta.schema.names
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = {n: group.column(names.index(n)).statistics for n in bounds}
                total += group.total_byte_size
                asked += group.total_byte_size * all(stats[n].min <= b and a <= stats[n].max for n, (a, b) in bounds.items())
        return asked / total

    assert needed(tmp_path / "curve") < 0.2 < 0.24 < needed(tmp_path / "plain")
    layout.save_along_curve(df.where("false"), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_envelopes():
    rng = random.Random(1)
    for _ in range(800):
        run, at, height, asked_run, asked = [], [], [], [], []
        for r in range(rng.randint(1, 6)):
            for p in sorted(rng.sample(range(20), rng.randint(1, 12))):
                if rng.random() < 0.7:
                    run.append(r)
                    at.append(p)
                    height.append(rng.choice([0, 1, 4, 9, 25, 100]))
                asked_run.append(r)
                asked.append(p)
        got = erosion.envelope(*(np.array(v, np.int64) for v in (run, at, height, asked_run, asked)))
        assert got.tolist() == [min((h + (p - a) ** 2 for q, a, h in zip(run, at, height, strict=True) if q == r), default=-1) for r, p in zip(asked_run, asked, strict=True)]


def test_topography_of_a_volume(spark):
    """Labels side by side, a repeated voxel, and rows without a place."""
    rng = random.Random(3)
    cells = {(0, z, y, x): rng.choice([1, 1, 1, 2]) for z in range(4) for y in range(7) for x in range(6) if rng.random() < 0.93}
    rows = [(*p, v) for p, v in cells.items()] + [(*next(iter(cells)), cells[next(iter(cells))]), (0, None, 0, 0, 1), (0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, label long").repartition(3)
    for deep in (None, 4):
        got = {(r.t, r.z, r.y, r.x): r.distance for r in erosion.topography(df, 7, 6, z_size=deep).collect()}
        for p, label in cells.items():
            others = [q for q in ((0, z, y, x) for z in range(4) for y in range(7) for x in range(6)) if cells.get(q) != label and (deep or q[1] == p[1])]
            assert got[p] == pytest.approx(min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in others) ** 0.5)
