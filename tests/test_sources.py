"""The gridded source and sink, spans of files, and resumed statistics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from voxelry.model import Grid
from voxelry.plans.resumable import Runs
from voxelry.sources import gridded, netcdf, spans

VOXEL = "t int, z int, y int, x int, v double, label long, w float"
GRID = Grid(t=12, z=3, y=6, x=5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    places = [(t, z, y, x) for t in range(12) for z in range(3) for y in range(6) for x in range(5) if rng.random() < 0.3 and t not in (3, 7)]
    return [(*p, rng.choice([None, rng.random(), -1.5]), rng.choice([0, 1, 7, 1 << 40]), float(i % 5)) for i, p in enumerate(places)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gridded") / "out")
    df = spark.createDataFrame(rows + rows[:5] + [(None, 0, 0, 0, 1.0, 1, 1.0)], VOXEL).repartition(4)
    gridded.save_gridded(df, path, GRID, steps=4)
    return path


def test_round_trip(spark, rows, folder):
    """Files of four steps with missing steps, values and labels; repeated rows and rows without a place."""
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["00000000.nc", "00000001.nc", "00000002.nc", "_SUCCESS"]
    got = gridded.read_gridded(spark, folder, ["v", "label", "w"]).collect()
    assert {(r.t, r.z, r.y, r.x): (r.v, r.label or 0, r.w) for r in got} == {r[:4]: (r[4], r[5], r[6]) for r in rows}
    assert all(r.t_at == r.t for r in got) and len(got) == len(rows)
    old = netcdf.read_netcdf(spark, [f"file://{folder}/{k:08d}.nc" for k in range(3)], ["v", "label", "w"])
    assert sorted(map(tuple, old.select("t", "z", "y", "x", "w").collect())) == sorted((*r[:4], r[6]) for r in rows)


def test_filters_reach_the_files(spark, rows, folder):
    """Steps outside the box aren't partitions, rows outside it aren't read, and what comes back is the same."""
    df = gridded.read_gridded(spark, folder, ["w"])
    box = df.where("t >= 5 AND t < 10 AND z = 1 AND y > 2 AND t_at <= 8")
    assert sorted((r.t, r.z, r.y, r.x) for r in box.collect()) == sorted(r[:4] for r in rows if 5 <= r[0] <= 8 and r[1] == 1 and r[2] > 2)
    files = [f"file://{folder}/{k:08d}.nc" for k in range(3)]
    reader = gridded.Slabs(files, ["w"], ["t", "z", "y", "x", "t_at", "w"])
    asked = [gridded.GreaterThanOrEqual(("t",), 5), gridded.LessThan(("t",), 10), gridded.EqualTo(("z",), 1), gridded.GreaterThan(("t_at",), 5.5)]
    assert list(reader.pushFilters(asked)) == asked
    parts = reader.partitions()
    assert [(p.path[-4:], p.steps) for p in parts] == [("1.nc", (2, 4)), ("2.nc", (0, 2))]
    read = []
    plain = gridded._open
    gridded._open = lambda p: (lambda f: setattr(f, "read", (lambda inner: lambda at, n: (read.append(n), inner(at, n))[1])(f.read)) or f)(plain(p))
    try:
        got = [b for p in parts for b in reader.read(p)]
    finally:
        gridded._open = plain
    assert sum(n for n in read if n >= 8 * 6 * 5) == 4 * 8 * 6 * 5  # of each of four steps one level of three
    assert sum(b.num_rows for b in got) == sum(6 <= r[0] <= 9 and r[1] == 1 for r in rows)
    reader = gridded.Slabs(files, ["w"], ["t", "z", "y", "x", "t_at", "w"])
    list(reader.pushFilters([gridded.EqualTo(("y",), 99)]))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == []
    assert df.where("y = 99").count() == 0


def test_failed_job_leaves_no_file(spark, rows, tmp_path):
    """A task that dies, before and after others have written: nothing is published; the files before stay."""
    good = spark.createDataFrame(rows, VOXEL)
    broken = good.withColumn("v", F.when(F.col("t") == 9, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="lost"):
        gridded.save_gridded(broken, path, GRID, steps=1)
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f.endswith(".nc") or f.startswith("_")]
    gridded.save_gridded(good.where("t = 1"), path, GRID, steps=1)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="lost"):
        gridded.save_gridded(broken, path, GRID, steps=1)
    assert sorted(os.listdir(path)) == before == ["00000001.nc", "_SUCCESS"]


def test_no_voxels(spark, tmp_path):
    gridded.save_gridded(spark.createDataFrame([], VOXEL), f"{tmp_path}/none", GRID)
    assert os.listdir(f"{tmp_path}/none") == ["_SUCCESS"]


def test_files_for_spans(spark):
    names = ["/a/m_20200101T0000-20200102T0000.nc", "/a/m_20200102T0000-20200103T1200.nc", "/a/m_20200110T0000-20200220T0000.nc", "/a/readme.txt", "/20200101T0000/x_20200105T0000.nc", None, "/a/m_20209901T0000-20200102T0000.nc"]
    index = spans.spans(spark.createDataFrame([(n, 5) for n in names] + [(names[0], 5)], "path string, length long"))
    assert sorted(r.path for r in index.collect()) == sorted(names[:3])
    asked = [("p", "2020-01-02 00:00:00", "2020-01-02 00:00:00"), ("q", "2020-01-03 12:00:00", "2020-01-10 00:00:00"), ("r", "2020-02-01 00:00:00", "2020-03-01 00:00:00"), ("none", "2021-01-01 00:00:00", "2021-01-02 00:00:00"), ("turned", "2020-02-01 00:00:00", "2020-01-01 00:00:00"), ("null", None, "2020-02-01 00:00:00")]
    df = spark.createDataFrame(asked, "name string, start string, stop string").selectExpr("name", "CAST(start AS TIMESTAMP_NTZ) AS start", "CAST(stop AS TIMESTAMP_NTZ) AS stop")
    pairs = lambda closed: sorted((r.name, names.index(r.path)) for r in spans.needed(index, df, closed).collect())
    assert pairs(True) == [("p", 0), ("p", 1), ("q", 1), ("q", 2), ("r", 2)]
    assert pairs(False) == [("r", 2)]  # a span without length, and one that only touches, meet nothing
    assert [r.path for r in spans.gaps(index).collect()] == [names[1]]


def test_counted_files(spark):
    """As needed() counts them, for spans and files of any length; files of the same times stand as one row, so that no pairs are made."""
    rng = random.Random(5)
    at = lambda: f"202001{rng.randrange(1, 6):02d}T{rng.choice((0, 0, 6, 23)):02d}00"
    index = spans.spans(spark.createDataFrame([(f"/a/m_{at()}-{at()}_{k}.nc",) for k in range(300)], "path string"))
    stamp = lambda c: F.to_timestamp(c, "yyyyMMdd'T'HHmm").cast("timestamp_ntz").alias(c)
    asked = spark.createDataFrame([(k, at(), at()) for k in range(200)], "name long, start string, stop string").select("name", stamp("start"), stamp("stop"))
    for closed in (True, False):
        want = spans.needed(index, asked, closed).groupBy("name").agg(F.count("*").alias("files"), F.min("path").alias("first"))
        got = spans.counted(index, asked, closed).select("name", "files", "first")
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 50
    same = spark.range(20000).select(F.concat(F.lit("/a/m_20200101T0000-20200102T1200_"), F.col("id").cast("string")).alias("path"))
    many = spark.range(20000).select(F.col("id").alias("name"), F.lit("20200101T0000").alias("start"), F.lit("20200103T0000").alias("stop")).select("name", stamp("start"), stamp("stop"))
    assert spans.counted(spans.spans(same), many).agg(F.sum("files")).first()[0] == 20000 * 20000


def test_listed_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d/e")
    for n in ("d/m_20200101T0000-20200102T0000.nc", "d/e/m_20200102T0000-20200103T0000.nc", "d/other.txt"):
        with open(f"{tmp_path}/{n}", "w") as f:
            f.write("x")
    index = spans.spans(spans.listed(spark, f"{tmp_path}/d", "*.nc"))
    assert index.count() == 2 and spans.gaps(index).count() == 0


def test_resumed_runs(spark, tmp_path):
    """A run that stops within a batch is taken up: only what is missing is computed, each system once."""
    table = spark.createDataFrame([(i % 23, float(i)) for i in range(230)] + [(99, 1.0)] * 300, "system long, v double")
    sizes = table.groupBy("system").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([(None, 5), (500, 0)], "system long, n long"))
    runs, asked = Runs(spark, str(tmp_path / "runs")), []

    def compute(ids):
        asked.append(sorted(r.system for r in ids.collect()))
        return table.join(ids, "system").groupBy("system").agg(F.sum("v").alias("v"))

    def stops(ids):
        out = compute(ids)
        return out.withColumn("v", F.raise_error(F.lit("stopped")).cast("double")) if len(asked) == 3 else out

    assert runs.finished().count() == 0 and runs.results() is None
    with pytest.raises(Exception, match="stopped"):
        runs.run(sizes, stops, budget=60)
    first = sorted(sum(asked[:2], []))
    assert sorted(r.system for r in runs.finished().collect()) == first
    os.makedirs(tmp_path / "runs" / "ids" / "halfway")  # ids that were never committed
    done = len(asked)
    assert runs.run(sizes, compute, budget=60) > 1
    assert not set(first) & set(sum(asked[done:], [])) and max(map(len, asked)) <= 8
    want = {r.system: r.v for r in table.groupBy("system").agg(F.sum("v").alias("v")).collect()}
    got = runs.results().collect()
    assert {r.system: r.v for r in got} == want and len(got) == len(want)
    assert sorted(r.system for r in runs.finished().collect()) == sorted([*want, 500])
    assert runs.run(sizes, compute, budget=60) == 0
