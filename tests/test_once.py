"""What is read several times is derived once: rows that pass a counter, and shuffles of a plan."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxelry.model import DIMS, Grid
from voxelry.operators import bundles, environment, labelling, sharing, stats
from voxelry.plans import catalogue
from voxelry.storage import Scratch

VOXEL = "t int, z int, y int, x int"


def counted(spark, df, column):
    """df, and an accumulator of how many of its rows have been computed with that column."""
    n = spark.sparkContext.accumulator(0)

    def tell(v):
        n.add(1)
        return v

    return df.withColumn(column, F.udf(tell, df.schema[column].dataType)(column)), n


def test_systems_meet_once(spark):
    """Against flooding over labels, with labels of one class alone and such that several of the other bridge; each mask is derived once."""
    rng = random.Random(3)
    cells = [p for p in itertools.product(range(2), range(2), range(5), range(12)) if rng.random() < 0.8]
    a = {p: rng.randrange(1, 25) for p in cells if rng.random() < 0.5}
    b = {p: rng.randrange(1, 25) for p in cells if rng.random() < 0.2}
    reach = defaultdict(set)
    for p in a.keys() & b.keys():
        reach["a", a[p]].add(("b", b[p]))
        reach["b", b[p]].add(("a", a[p]))

    def name(node):
        seen, queue = {node}, [node]
        while queue:
            for n in reach[queue.pop()] - seen:
                seen.add(n)
                queue.append(n)
        return min((v for side, v in seen if side == "a"), default=None)

    named = {p: name(("a", a[p]) if p in a else ("b", b[p])) for p in a.keys() | b.keys()}
    named = {p: v for p, v in named.items() if v is not None}
    rank = {v: k for k, v in enumerate(sorted(set(named.values())), 1)}
    mask, other = (spark.createDataFrame([(*p, v) for p, v in m.items()], f"{VOXEL}, label long") for m in (a, b))
    (mask, n), (other, m) = counted(spark, mask, "label"), counted(spark, other, "label")
    got = {(r.t, r.z, r.y, r.x): (r.system, r.u_tracks) for r in sharing.multivariate_systems(mask, other, Scratch(spark)).collect()}
    assert got == {p: (rank[v], b.get(p)) for p, v in named.items()}
    assert (n.value, m.value) == (len(a), len(b))


def test_runs_are_read_off(spark):
    """The ends of runs stand at one voxel of each, repeated voxels counted, without another shuffle."""
    rows = [(t, 0, y, x) for t in range(2) for y in range(3) for x in (0, 1, 1, 2, 5, 7, 8)]
    df = spark.createDataFrame(rows, VOXEL)
    placed = labelling.run_ends(labelling.runs(df, Grid(z=1, y=3, x=15)), "first", ("hi", "n"))
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert placed.count() == len(rows)
    ends = sorted((r.t, r.y, r.x, r.hi, r.n) for r in placed.where("n IS NOT NULL").collect())
    assert ends == sorted((t, y, *e) for t in range(2) for y in range(3) for e in ((0, 2, 4), (5, 5, 1), (7, 8, 2)))


def field_of(spark, rows=9):
    cells = [(t, z, y, x) for t in range(3) for z in range(5) for y in range(rows) for x in range(6)]
    v = lambda *p: (sum(a * k for a, k in zip(p, (7, 5, 3, 11), strict=True)) % 13) / 13
    data = [(*p, x * 0.5, y * 0.5, 1500.0 * z + 100, 1e5 - 12000.0 * z, 300.0 - 9 * z + v(*p), 0.002, v(*p) / 1000, v(x, y, z, t) / 1000, 1e-4, 5e-5, 2e-5, v(*p) * 9 - 4, v(y, *p[1:]) * 9 - 4, v(*p) * 4, 1500.0, 1.0) for p in cells for t, z, y, x in (p,)]
    return spark.createDataFrame(data, f"{VOXEL}, lon double, lat double, zg double, pfull double, ta double, hus double, cli double, clw double, qg double, qr double, qs double, ua double, va double, wa_phy double, dzghalf double, pr double")


def test_divergence_over_blocks(spark, monkeypatch):
    """Small blocks give what one block gives, null rows included; one shuffle serves both directions."""
    field = field_of(spark).withColumn("y", F.when(F.col("x") + F.col("z") != 3, F.col("y")))
    rows = lambda: sorted(((*(r[d] for d in DIMS), r.pfull, r.div) for r in stats.divergence(field, 0.5, F.col("lat")).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(stats, "BLOCK", 2)
    assert rows() == whole and len(whole) == field.count() and any(r[-1] is not None for r in whole)
    assert stats.divergence(field, 0.5, F.col("lat"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_points_move_once(spark):
    """A centre asks the cells around it, a point stands in its own: a point's row isn't multiplied before the join."""
    points = spark.createDataFrame([(i, i % 20 - 10.0, i // 20 - 5.0) for i in range(200)], "id int, lon double, lat double")
    centres = spark.createDataFrame([(1, 0.2, 0.1), (2, -9.9, 4.0)], "system int, clon double, clat double")
    found = environment.within(points, centres, 1.5)
    assert {(r.id, r.system) for r in found.collect()} == {(i, s) for i in range(200) for s, a, b in ((1, 0.2, 0.1), (2, -9.9, 4.0)) if (i % 20 - 10.0 - a) ** 2 + (i // 20 - 5.0 - b) ** 2 < 1.5**2}
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Generate explode") == 2 and "clon" in tree.split("Generate explode")[1]


@pytest.mark.parametrize("grain", ["", "tz", "tyx", "core_tz"])
def test_bundles_read_the_field_once(spark, grain):
    """Once for the voxels of systems and once for what lies around their centres, whichever grain is asked for."""
    field, n = counted(spark, field_of(spark), "pfull")
    mask = field_of(spark).where("clw > 0.0002 OR z = 3").select(*DIMS, F.expr("CAST(1 + y DIV 3 AS BIGINT)").alias("system"), F.when(F.col("wa_phy") > 1, F.expr("CAST(10 + y DIV 3 AS BIGINT)")).alias("u_tracks"))
    at = spark.createDataFrame([(1, 1, 1.0, 0.5), (2, 1, 1.0, 2.0), (3, 2, 1.0, 3.5)], "system long, t int, clon double, clat double")
    out = bundles.system_statistics(mask, field, at, 1.2, degrees=0.5)[grain]
    assert out.count() > 0 and out.collect()
    assert n.value <= 2 * 3 * 5 * 9 * 6


def test_flow_reads_the_field_once(spark):
    field, n = counted(spark, field_of(spark), "pfull")
    at = spark.createDataFrame([(1, 1, 1.0, 0.5), (2, 1, 1.0, 2.0)], "system long, t int, clon double, clat double")
    assert len(bundles.flow_environment(field, at, [1.2]).collect()) == 2
    assert n.value <= 3 * 5 * 9 * 6


@pytest.mark.parametrize("name", ["core_at_level", "anvil_stats"])
def test_objects_are_derived_once(spark, sf, name, monkeypatch):
    base = stats.derive(field_of(spark).withColumn("system", F.expr("CAST(1 + y DIV 3 AS BIGINT)")).withColumn("u_tracks", F.expr("CAST(x + 1 AS BIGINT)")))
    objects, n = counted(spark, base, "z")
    monkeypatch.setattr(catalogue, "_objects", lambda spark, sf: objects)
    assert catalogue.QUERIES[name](spark, sf).collect()
    assert n.value == base.count()
