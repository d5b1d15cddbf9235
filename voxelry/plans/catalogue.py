"""Queries of the analytics operators and the SQL that checks them, both by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions import profiles as pr
from ..functions.convection import cape_cin
from ..functions.grids import axis, coarsen, regrid, snap
from ..model import DIMS, Grid
from ..operators import detect, environment, erosion, labelling, lineage, sharing, stats
from ..operators.graph import consecutive
from ..sources import readers
from ..sources.adapters import columns, records, table, voxels
from ..storage import Scratch, shuffled
from ..streaming import linking, windows
from . import sqltext as q

GRID = Grid()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACE = "t, z, y, x"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def _rs(e: str, name: str, n: int = 6) -> str:
    return f"round({e}, {n}) + 0.0 AS {name}"


def _labelled(spark, sf, mask="cloud", **how):
    return labelling.label(voxels(spark, sf, mask), GRID, Scratch(spark), **how)


# --- labels -----------------------------------------------------------------------------------


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D)) + f"SELECT {PLACE}, label FROM l")
def components_4d(spark, sf):
    return _labelled(spark, sf).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_3D)) + f"SELECT {PLACE}, label FROM l")
def components_per_time(spark, sf):
    return _labelled(spark, sf, dims=("z", "y", "x")).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_2D)) + f"SELECT {PLACE}, label FROM l")
def components_2d(spark, sf):
    return _labelled(spark, sf, dims=("y", "x")).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FULL_3D)) + f"SELECT {PLACE}, label FROM l")
def components_26(spark, sf):
    return _labelled(spark, sf, dims=("z", "y", "x"), full=True).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D, min_size=2)) + f"SELECT {PLACE}, label FROM l")
def components_no_singletons(spark, sf):
    return _labelled(spark, sf, min_size=2).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D, periodic=True)) + f"SELECT {PLACE}, label FROM l")
def components_periodic(spark, sf):
    return _labelled(spark, sf, periodic=("x",)).select(*DIMS, "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D)) + "SELECT label, t, count(*) AS voxels, min(z) AS z_min, max(z) AS z_max FROM l GROUP BY label, t")
def object_volume_time(spark, sf):
    return _labelled(spark, sf).groupBy("label", "t").agg(F.count("*").alias("voxels"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query(
    q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D)) + "SELECT label, count(*) AS voxels, count(DISTINCT t) AS steps, min(t) AS t0, max(t) AS t1, count(DISTINCT y * 15 + x) AS footprint, "
    "CAST(max(s) AS BIGINT) AS max_slice FROM (SELECT *, count(*) OVER (PARTITION BY label, t, z) AS s FROM l) GROUP BY label"
)
def object_geometry(spark, sf):
    """Two levels: first by slice and by pixel, then by object, so that no object's pixels meet in one row."""
    voxel = Scratch(spark).save(_labelled(spark, sf).select(*DIMS, "label"))
    slices = voxel.groupBy("label", "t", "z").agg(F.count("*").alias("s")).groupBy("label").agg(F.sum("s").alias("voxels"), F.countDistinct("t").alias("steps"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("s").alias("max_slice"))
    return slices.join(voxel.select("label", "y", "x").distinct().groupBy("label").agg(F.count("*").alias("footprint")), "label")


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D), "e AS (SELECT * FROM l WHERE label IN (SELECT label FROM l GROUP BY 1 HAVING count(*) > 1))") + f"SELECT {PLACE}, dense_rank() OVER (ORDER BY label) AS label FROM e")
def consecutive_labels(spark, sf):
    """Labels of objects of more than a voxel: the others' numbers are gaps, which go."""
    scratch = Scratch(spark)
    every = shuffled(scratch.save(_labelled(spark, sf).select(*DIMS, "label")))
    some = shuffled(scratch.save(every.join(readers.repeated(every).select("label"), "label", "left_semi")))  # each is read twice
    return labelling.force_consecutive(some, Scratch(spark)).select(*DIMS, "label")


_BOTH = q.with_(q.vox("vi", "ice"), q.vox("vu", "updraft"), q.labelled("i", "vi", q.FACES_4D), q.labelled("u", "vu", q.FACES_4D), "m AS (SELECT t, u.label AS cur, i.label AS upd FROM u JOIN i USING (t, z, y, x))")


def _both(spark, sf):
    """Both masks, written: most queries read them more than once."""
    scratch = Scratch(spark)
    return tuple(shuffled(scratch.save(_labelled(spark, sf, m).select(*DIMS, "label"))) for m in ("ice", "updraft"))


@query(_BOTH + f"SELECT {PLACE}, max(label) AS label FROM (SELECT {PLACE}, label FROM i UNION ALL SELECT {PLACE}, label FROM u) GROUP BY ALL")
def union_masks(spark, sf):
    return labelling.union_masks([_labelled(spark, sf, m) for m in ("ice", "updraft")])  # each is read once


@query(_BOTH + "SELECT DISTINCT u.t, u.label, coalesce(k.s, 0) AS shared FROM u LEFT JOIN (SELECT t, cur, min(upd) AS s FROM m GROUP BY 1, 2) k ON u.t = k.t AND u.label = k.cur")
def share_labels_per_time(spark, sf):
    ice, updraft = _both(spark, sf)
    return sharing.per_time(updraft, ice)


@query(_BOTH + f"SELECT {PLACE}, s AS label FROM u JOIN (SELECT cur, min(upd) AS s FROM m GROUP BY 1) ON label = cur")
def share_labels(spark, sf):
    ice, updraft = _both(spark, sf)
    return sharing.share_labels(updraft, ice)


@query(_BOTH + "SELECT p.s AS old, min(a.s) AS new FROM (SELECT t, cur, min(upd) AS s FROM m GROUP BY 1, 2) p JOIN (SELECT cur, min(upd) AS s FROM m GROUP BY 1) a USING (cur) GROUP BY 1")
def share_labels_extra(spark, sf):
    ice, updraft = _both(spark, sf)
    return sharing.extra_map(updraft, ice, Scratch(spark))


@query(_BOTH + f"SELECT {PLACE}, label FROM u WHERE label IN (SELECT cur FROM m)")
def require_overlap_any(spark, sf):
    ice, updraft = _both(spark, sf)
    return labelling.overlapping(ice, updraft)


@query(_BOTH + f"SELECT {PLACE}, label FROM u WHERE (t, label) IN (SELECT (t, cur) FROM m)")
def require_overlap_time(spark, sf):
    ice, updraft = _both(spark, sf)
    return labelling.overlapping(ice, updraft, per_time=True)


_SYSTEMS = (
    _BOTH[:-1] + ", g AS (SELECT DISTINCT cur * 2 + 1 AS s, upd * 2 AS d FROM m), ge AS (SELECT s, d FROM g UNION ALL SELECT d, s FROM g), "
    "gr(s, d) AS (SELECT s, s FROM ge UNION SELECT r.s, e.d FROM gr r JOIN ge e ON r.d = e.s), gn AS (SELECT s, min(d) FILTER (d % 2 = 0) // 2 AS new FROM gr GROUP BY s), "
    f"al AS (SELECT {PLACE}, coalesce(gn.new, label) AS l FROM i LEFT JOIN gn ON gn.s = label * 2 UNION ALL SELECT {PLACE}, gn.new FROM u JOIN gn ON gn.s = label * 2 + 1), "
    f"mx AS (SELECT {PLACE}, max(l) AS l FROM al GROUP BY ALL), systems AS (SELECT {PLACE}, dense_rank() OVER (ORDER BY l) AS system, u.label AS u_tracks FROM mx LEFT JOIN u USING (t, z, y, x)) "
)


def _systems(spark, sf):
    ice, updraft = (_labelled(spark, sf, m) for m in ("ice", "updraft"))  # each is read once
    return sharing.multivariate_systems(ice, updraft, Scratch(spark))


@query(_SYSTEMS + f"SELECT {PLACE}, system, u_tracks FROM systems")
def multivariate_system(spark, sf):
    return _systems(spark, sf)


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D)) + f"SELECT {PLACE}, label FROM l")
def link_chunks(spark, sf):
    """Three chunks labelled alone and linked: the same as labelling all at once."""
    parts = [labelling.label(voxels(spark, sf).where(c), GRID, Scratch(spark)) for c in ("t < 20", "t >= 20 AND t < 40", "t >= 40")]
    linked = shuffled(Scratch(spark).save(sharing.link_chunks(parts, [20, 40], GRID, Scratch(spark))[0]))  # read three times
    first = linked.groupBy("label").agg(F.min(GRID.id()).alias("first"))
    ranks = consecutive(first, "first", Scratch(spark))
    return linked.join(first, "label").join(ranks, "first").select(*DIMS, F.col("rank").alias("label"))


@query(SQL["link_chunks"])
def link_arriving(spark, sf):
    """The same chunks one after the other, each joined to what is stored of those before."""
    scratch = Scratch(spark)
    parts = [shuffled(scratch.save(labelling.label(voxels(spark, sf).where(c), GRID, scratch).select(*DIMS, "label"))) for c in ("t < 20", "t >= 20 AND t < 40", "t >= 40")]
    links = linking.ChunkLinks(spark, scratch.folder("links"))
    for k, part in enumerate(parts):
        links.add(k, part)
    every = parts[0].withColumn("chunk", F.lit(0)).unionByName(parts[1].withColumn("chunk", F.lit(1))).unionByName(parts[2].withColumn("chunk", F.lit(2)))
    linked = shuffled(scratch.save(every.withColumnRenamed("label", "old").join(links.links(scratch), ["chunk", "old"]).select(*DIMS, F.col("new").alias("label"))))
    first = linked.groupBy("label").agg(F.min(GRID.id()).alias("first"))
    return linked.join(first, "label").join(consecutive(first, "first", scratch), "first").select(*DIMS, F.col("rank").alias("label"))


@query(
    q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_3D), "p AS (SELECT t, max(label) AS top FROM (SELECT *, label FROM l) GROUP BY t), s AS (SELECT t, coalesce(sum(top) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM p)")
    + f"SELECT {PLACE}, CAST(label + shift AS BIGINT) AS label FROM l JOIN s USING (t)"
)
def collect_parts(spark, sf):
    return readers.collect_parts(_labelled(spark, sf, dims=("z", "y", "x")), part="t").select(*DIMS, F.col("label").cast("long").alias("label"))


# --- erosion ----------------------------------------------------------------------------------


@query(q.with_(q.vox("v", "cloud", 12)) + f"SELECT {PLACE} FROM v WHERE (SELECT count(*) FROM v b WHERE b.t = v.t AND b.z = v.z AND abs(b.y - v.y) <= 1 AND abs(b.x - v.x) <= 1) = 9")
def binary_erode(spark, sf):
    return labelling.binary_erode(voxels(spark, sf, coarse=12)).select(*DIMS)


_BLOCKS = q.with_(
    q.vox("v", "cloud", 12), "m AS (SELECT t, z, y, x, CAST(1 + x // 5 + 3 * (y // 5) AS BIGINT) AS label FROM v)", "ys AS (SELECT max(y) + 1 AS ny FROM m)",
    "cells AS (SELECT s.t, s.z, CAST(yy.y AS INTEGER) AS y, CAST(xx.x AS INTEGER) AS x FROM (SELECT DISTINCT t, z FROM m) s, (SELECT unnest(range(0, (SELECT ny FROM ys))) AS y) yy, (SELECT unnest(range(0, 15)) AS x) xx)",
    "outside AS (SELECT c.t, c.z, c.y, c.x, m.label FROM cells c LEFT JOIN m USING (t, z, y, x))",
    "near AS (SELECT m.t, m.z, m.y, m.x, m.label, min((m.y - o.y) * (m.y - o.y) + (m.x - o.x) * (m.x - o.x)) AS d2 FROM m JOIN outside o ON o.t = m.t AND o.z = m.z AND o.label IS DISTINCT FROM m.label GROUP BY ALL)",
    "topo AS (SELECT *, sqrt(CAST(d2 AS DOUBLE)) / max(sqrt(CAST(d2 AS DOUBLE))) OVER (PARTITION BY t, z, label) AS topography FROM near)",
)


def _blocks(spark, sf):
    m = voxels(spark, sf, coarse=12).select(*DIMS, F.expr("CAST(1 + x DIV 5 + 3 * (y DIV 5) AS BIGINT)").alias("label"))
    return m, m.agg(F.max("y")).first()[0] + 1


@query(_BLOCKS + f"SELECT {PLACE}, label, {_rs('topography', 'topography')} FROM topo")
def topography(spark, sf):
    m, ny = _blocks(spark, sf)
    return erosion.topography(m, ny, 15).select(*DIMS, "label", _r("topography").alias("topography"))


@query(_BLOCKS + f"SELECT {PLACE}, label FROM topo WHERE topography > 0.5")
def weighted_erode(spark, sf):
    m, ny = _blocks(spark, sf)
    return erosion.weighted_erode(m, ny, 15, 0.5).select(*DIMS, "label")


# --- detection --------------------------------------------------------------------------------

THRESHOLDS = [5.0, 15.0, 35.0, 70.0, 115.0]


def _features_sql(*more: str) -> str:
    ctes = []
    for k, level in enumerate(THRESHOLDS):
        ctes += [q.vox(f"v{k}", "all", 1, f"max(value) >= {level}"), q.labelled(f"l{k}", f"v{k}", q.FACES_3D, min_size=2)]
    every = " UNION ALL ".join(f"SELECT t, z, y, x, vmax, label, {k} AS rank, CAST({level} AS DOUBLE) AS threshold FROM l{k}" for k, level in enumerate(THRESHOLDS))
    mean = lambda d: f"CASE WHEN sum(vmax - threshold) > 0 THEN sum({d} * (vmax - threshold)) / sum(vmax - threshold) ELSE avg({d}) END AS {d}c"
    return q.with_(
        *ctes, f"ev AS MATERIALIZED ({every})", "top AS (SELECT t, z, y, x, max(rank) AS top FROM ev GROUP BY ALL)", "gone AS (SELECT DISTINCT rank, label FROM ev JOIN top USING (t, z, y, x) WHERE top > rank)",
        "own AS MATERIALIZED (SELECT * FROM ev WHERE (rank, label) NOT IN (SELECT (rank, label) FROM gone))",
        f"ft AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY rank, min(((CAST(t AS BIGINT) * 5 + z) * 1048576 + y) * 15 + x)) AS feature, t, threshold, rank, label, count(*) AS size, max(vmax) AS peak, {mean('z')}, {mean('y')}, {mean('x')} FROM own GROUP BY t, threshold, rank, label)",
        *more,
    )


def _features(spark, sf):
    return detect.detect_features(voxels(spark, sf, "all"), "vmax", THRESHOLDS, 2, GRID, Scratch(spark))


@query(_features_sql() + "SELECT feature, t, threshold, size, peak, " + ", ".join(_rs(c, c, 4) for c in ("zc", "yc", "xc")) + " FROM ft")
def detect_features(spark, sf):
    f = _features(spark, sf)[0]
    return f.select("feature", "t", "threshold", "size", "peak", *(_r(c, 4).alias(c) for c in ("zc", "yc", "xc")))


#: Edges of each time step in order, best first; a step's k-th edge joins two parts unless both have a seed.
_FLOOD = (
    q.vox("va", "all"), "nd AS MATERIALIZED (SELECT t, z, y, x, ((CAST(t AS BIGINT) * 5 + z) * 1048576 + y) * 15 + x AS id, vmax AS v FROM va WHERE vmax > 5)",
    "ed AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY t ORDER BY w DESC, src, dst) AS rank FROM (SELECT a.t, a.id AS src, b.id AS dst, least(a.v, b.v) AS w FROM nd a, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dz, dy, dx), nd b WHERE b.t = a.t AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx))",
    "sd AS (SELECT ((CAST(o.t AS BIGINT) * 5 + z) * 1048576 + y) * 15 + x AS id, min(feature) AS feature FROM own o JOIN ft USING (rank, label) GROUP BY 1)",
    "fl(id, part, seed) USING KEY (id) AS (SELECT nd.id, nd.id, coalesce(sd.feature, 0) FROM nd LEFT JOIN sd USING (id) UNION ALL SELECT -1, 0, 0 UNION (WITH c AS (SELECT part + 1 AS i FROM recurring.fl WHERE id = -1 AND part < (SELECT max(rank) FROM ed)), "
    "m AS (SELECT a.part AS pa, b.part AS pb, greatest(a.seed, b.seed) AS seed FROM c JOIN ed ON ed.rank = c.i JOIN recurring.fl a ON a.id = ed.src JOIN recurring.fl b ON b.id = ed.dst WHERE a.part <> b.part AND (a.seed = 0 OR b.seed = 0)), "
    "u AS (SELECT pa AS p, pa, seed FROM m UNION ALL SELECT pb, pa, seed FROM m) SELECT f.id, u.pa, u.seed FROM u JOIN recurring.fl f ON f.part = u.p WHERE f.id >= 0 UNION ALL SELECT -1, i, 0 FROM c))",
)


@query(_features_sql(*_FLOOD) + "SELECT t, z, y, x, seed AS feature FROM fl JOIN nd USING (id) WHERE seed > 0")
def segment_watershed(spark, sf):
    f, members = _features(spark, sf)
    return detect.watershed(voxels(spark, sf, "all"), "vmax", members, 5.0, GRID, Scratch(spark))


#: Pairs in order; each round takes those that are first for both ends, and drops what shares an end with them.
_CHAINS = (
    "pr AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY d, a, b) AS k FROM (SELECT a.feature AS a, b.feature AS b, round(pow(a.zc - b.zc, 2) + pow(a.yc - b.yc, 2) + pow(a.xc - b.xc, 2), 9) AS d FROM ft a JOIN ft b ON b.t = a.t + 1) WHERE d <= 4.0)",
    "lk(k, a, b, s) USING KEY (k) AS (SELECT k, a, b, 0 FROM pr UNION (WITH o AS (SELECT * FROM recurring.lk WHERE s = 0), m AS (SELECT k, a, b FROM (SELECT *, min(k) OVER (PARTITION BY a) AS ka, min(k) OVER (PARTITION BY b) AS kb FROM o) WHERE k = ka AND k = kb) "
    "SELECT o.k, o.a, o.b, CASE WHEN o.k IN (SELECT k FROM m) THEN 1 ELSE 2 END FROM o WHERE o.a IN (SELECT a FROM m) OR o.b IN (SELECT b FROM m)))",
    "ch(feature, root) AS (SELECT feature, feature FROM ft WHERE feature NOT IN (SELECT b FROM lk WHERE s = 1) UNION ALL SELECT lk.b, ch.root FROM ch JOIN lk ON lk.a = ch.feature WHERE lk.s = 1)",
    "gr AS (SELECT feature, t, min(feature) OVER w AS first, count(*) OVER w AS steps, t - min(t) OVER w AS time_cell FROM ch JOIN ft USING (feature) WINDOW w AS (PARTITION BY root))",
)


@query(_features_sql(*_CHAINS) + "SELECT feature, t, CASE WHEN steps >= 2 THEN dense_rank() OVER (PARTITION BY steps >= 2 ORDER BY first) ELSE 0 END AS cell, time_cell FROM gr")
def link_features(spark, sf):
    f = _features(spark, sf)[0]
    return detect.link_features(f, 2.0, Scratch(spark), min_steps=2).select("feature", "t", "cell", "time_cell")


_LEAST = detect.Subnet(most=4, step=0.5, stop=0.1)


def _optimal(radius: float, most: int, levels: int) -> list[str]:
    """CTEs of the pairs of least total distance: all assignments of each subnet of up to `most` ends a side, one first end after the other; larger subnets try again within half the radius."""
    ctes, none = [f"e0 AS MATERIALIZED (SELECT a, b, CAST(round(d * 1e9) AS BIGINT) AS d FROM (SELECT a.feature AS a, b.feature AS b, round(pow(a.zc - b.zc, 2) + pow(a.yc - b.yc, 2) + pow(a.xc - b.xc, 2), 9) AS d FROM ft a JOIN ft b ON b.t = a.t + 1) WHERE d <= {radius * radius})"], "9223372036854775807"
    for k in range(levels):
        alone = round((radius * 0.5**k) ** 2 * 1e9)
        ctes += [
            f"n{k} AS MATERIALIZED (SELECT * FROM e{k} WHERE d <= {alone})",
            f"m{k} AS MATERIALIZED (SELECT 2 * a AS s, 2 * b + 1 AS e FROM n{k} UNION SELECT 2 * b + 1, 2 * a FROM n{k})",
            f"r{k}(id, c) USING KEY (id) AS (SELECT DISTINCT s, s FROM m{k} UNION SELECT m.e, min(r.c) FROM r{k} r JOIN m{k} m ON m.s = r.id JOIN recurring.r{k} o ON o.id = m.e WHERE r.c < o.c GROUP BY m.e)",
            f"w{k} AS MATERIALIZED (SELECT n.*, c AS net, dense_rank() OVER (PARTITION BY c ORDER BY a) AS i FROM n{k} n JOIN r{k} r ON r.id = 2 * n.a)",
            f"z{k} AS MATERIALIZED (SELECT net, max(i) AS na, greatest(count(DISTINCT a), count(DISTINCT b)) > {most} AS large FROM w{k} GROUP BY net)",
            f"o{k} AS MATERIALIZED (SELECT net, i, a, b, d FROM w{k} JOIN z{k} USING (net) WHERE NOT large UNION ALL SELECT DISTINCT net, i, a, {none}, {alone} FROM w{k} JOIN z{k} USING (net) WHERE NOT large)",
            f"q{k}(net, i, cost, picks) AS (SELECT net, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM z{k} WHERE NOT large UNION ALL SELECT q.net, o.i, q.cost + o.d, list_append(q.picks, o.b) FROM q{k} q JOIN o{k} o ON o.net = q.net AND o.i = q.i + 1 WHERE o.b = {none} OR NOT list_contains(q.picks, o.b))",
            f"p{k} AS MATERIALIZED (SELECT q.net, picks FROM q{k} q JOIN z{k} z ON z.net = q.net AND z.na = q.i QUALIFY row_number() OVER (PARTITION BY q.net ORDER BY cost, picks) = 1)",
            f"l{k}_ AS MATERIALIZED (SELECT DISTINCT w.a, picks[w.i] AS b FROM p{k} p JOIN w{k} w USING (net) WHERE picks[w.i] <> {none})",
            f"e{k + 1} AS MATERIALIZED (SELECT a, b, d FROM w{k} JOIN z{k} USING (net) WHERE large)",
        ]
    every = " UNION ALL ".join(f"SELECT a, b FROM l{k}_" for k in range(levels))
    return [*ctes, f"lk AS MATERIALIZED (SELECT a, b, 1 AS s FROM ({every}))"]


@query(_features_sql(*_optimal(2.0, 4, 4), *_CHAINS[2:]) + "SELECT feature, t, CASE WHEN steps >= 2 THEN dense_rank() OVER (PARTITION BY steps >= 2 ORDER BY first) ELSE 0 END AS cell, time_cell FROM gr")
def link_optimal(spark, sf):
    """Links of the least total distance, in subnets of up to four features a step."""
    f = _features(spark, sf)[0]
    return detect.link_features(f, 2.0, Scratch(spark), min_steps=2, subnet=_LEAST).select("feature", "t", "cell", "time_cell")


_SMOOTH_Y = "(SELECT max(y) + 1 FROM va)"


def _smooth_sql(sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    taps = f"tp AS (SELECT k, exp(-0.5 * k * k / {sigma * sigma}) / (SELECT sum(exp(-0.5 * j * j / {sigma * sigma})) FROM range({-reach}, {reach + 1}) r(j)) AS w FROM range({-reach}, {reach + 1}) s(k))"
    ctes, before = [q.vox("va", "all"), taps, "f0 AS (SELECT t, z, y, x, vmax AS v FROM va)"], "f0"
    for i, (d, n) in enumerate((("z", "5"), ("y", _SMOOTH_Y), ("x", "15"))):
        mirrored = f"((p + k) % (2 * {n}) + 2 * {n}) % (2 * {n})"
        ctes += [f"g{i} AS (SELECT p, CASE WHEN m < {n} THEN m ELSE 2 * {n} - 1 - m END AS o, sum(w) AS w FROM (SELECT p, {mirrored} AS m, w FROM range(0, {n}) r(p), tp) GROUP BY 1, 2)"]
        ctes += [f"f{i + 1} AS (SELECT {', '.join('CAST(g.p AS INTEGER) AS ' + c if c == d else 'f.' + c for c in DIMS)}, sum(f.v * g.w) AS v FROM {before} f JOIN g{i} g ON g.o = f.{d} GROUP BY 1, 2, 3, 4)"]
        before = f"f{i + 1}"
    return q.with_(*ctes) + f"SELECT {PLACE}, {_rs('v', 'vmax', 4)} FROM f3"


@query(_smooth_sql(0.8))
def smooth_field(spark, sf):
    v = voxels(spark, sf, "all")
    grid = Grid(y=v.agg(F.max("y")).first()[0] + 1)
    return _rounded(detect.smooth(v, "vmax", 0.8, grid), DIMS)


@query(
    _features_sql(
        "bx AS (SELECT feature, t, CAST(round(zc) + a AS INTEGER) AS z, CAST(round(yc) + b AS INTEGER) AS y, CAST(round(xc) + c AS INTEGER) AS x, zc, yc, xc FROM ft, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) r(b), (VALUES (-1), (0), (1)) s(c))",
        "bd AS (SELECT *, round(pow(z - zc, 2) + pow(y - yc, 2) + pow(x - xc, 2), 9) AS d FROM bx WHERE z BETWEEN 0 AND 4 AND y >= 0 AND x BETWEEN 0 AND 14)",
    )
    + f"SELECT {PLACE}, arg_min(feature, row(d, feature)) AS feature FROM bd GROUP BY 1, 2, 3, 4"
)
def box_seeds(spark, sf):
    return detect.box_seeds(_features(spark, sf)[0], 3, GRID)


# --- statistics -------------------------------------------------------------------------------

_FIELD = (
    "CAST(1500 AS DOUBLE) * z + 100 AS zg, CAST(100000 AS DOUBLE) - 12000 * z AS pfull, CAST(300 AS DOUBLE) - 9 * z AS ta, CAST(0.002 AS DOUBLE) AS hus, vmax / CAST(100000 AS DOUBLE) AS cli, vmax / CAST(200000 AS DOUBLE) AS clw, "
    "CAST(0.0001 AS DOUBLE) AS qg, CAST(0.00005 AS DOUBLE) AS qr, CAST(0.00002 AS DOUBLE) AS qs, vmax / CAST(50 AS DOUBLE) AS wa_phy, CAST(1500 AS DOUBLE) AS dzghalf, vmax / CAST(3600 AS DOUBLE) AS pr"
)


def _objects(spark, sf):
    """Voxels of systems with the fields that statistics are taken of."""
    field = voxels(spark, sf).select(*DIMS, *[F.expr(e) for e in _FIELD.split(", ")])
    return stats.derive(_systems(spark, sf).join(field, list(DIMS)))


_OBJECTS = _SYSTEMS[:-1] + (
    f", {q.vox('vc')}, ob0 AS (SELECT systems.*, {_FIELD} FROM systems JOIN vc USING (t, z, y, x)), ob1 AS (SELECT *, CAST(121000000 AS DOUBLE) AS area, dzghalf AS depth, {q.RHO} AS rho FROM ob0), "
    "ob AS (SELECT *, area * depth AS volume, (cli + qs + qg) * rho AS fwc, (cli + clw + qg + qr + qs) * rho AS twc, wa_phy AS w, wa_phy * rho AS cmf FROM ob1) "
)


def _rounded(df, keys, n=4):
    return df.select(*keys, *(_r(c, n).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns if c not in keys))


@query(_OBJECTS + f"SELECT system, t, {_rs('sum(volume)', 'cloud_volume', 4)}, {_rs('max(zg)', 'cloud_cth', 4)}, {_rs('min(zg)', 'cloud_cbh', 4)} FROM ob GROUP BY system, t")
def cloud_stats_time(spark, sf):
    return _rounded(stats.evaluate(_objects(spark, sf), ("system",), stats.cloud())["t"], ("system", "t"))


@query(
    _OBJECTS + f"SELECT system, t, z, {_rs('sum(area)', 'cloud_area', 4)}, {_rs('sum(fwc * volume) / 1e6', 'cloud_fw', 4)}, {_rs('sum(twc * volume) / 1e6', 'cloud_tw', 4)}, {_rs('avg(fwc)', 'cloud_fwc')}, {_rs('avg(twc)', 'cloud_twc')}, "
    f"{_rs('avg(rho)', 'cloud_rho_mu')}, {_rs('avg(pfull)', 'cloud_pressure', 4)} FROM ob GROUP BY system, t, z"
)
def cloud_stats_level(spark, sf):
    r = stats.evaluate(_objects(spark, sf), ("system",), stats.cloud())["tz"]
    return r.select("system", "t", "z", _r("cloud_area", 4).alias("cloud_area"), *(_r(F.col(c) / 1e6, 4).alias(c) for c in ("cloud_fw", "cloud_tw")), *(_r(c).alias(c) for c in ("cloud_fwc", "cloud_twc", "cloud_rho_mu")), _r("cloud_pressure", 4).alias("cloud_pressure"))


@query(
    _OBJECTS + ", px AS (SELECT system, t, y, x, sum(depth) AS d, sum(fwc * depth) AS f, sum(twc * depth) AS w, min(ta) AS tt, min(zg) AS cb, max(pr) AS pr FROM ob GROUP BY 1, 2, 3, 4) "
    f"SELECT system, t, {_rs('avg(cb)', 'cloud_cbh_mu')}, {_rs('sum(pr)', 'cloud_pr')}, {_rs('max(pr)', 'cloud_pr_max')} FROM px GROUP BY 1, 2"
)
def cloud_stats_second(spark, sf):
    return _rounded(stats.second(stats.evaluate(_objects(spark, sf), ("system",), stats.cloud()), ("system",), "cloud"), ("system", "t"), 6)


@query(_OBJECTS + f"SELECT system, t, y, x, {_rs('sum(depth)', 'cloud_depth')}, {_rs('sum(fwc * depth)', 'cloud_fwp')}, {_rs('sum(twc * depth)', 'cloud_twp')}, {_rs('min(ta)', 'cloud_tt')} FROM ob GROUP BY 1, 2, 3, 4")
def cloud_stats_pixel(spark, sf):
    r = stats.evaluate(_objects(spark, sf), ("system",), stats.cloud())["tyx"]
    return _rounded(r.select("system", "t", "y", "x", "cloud_depth", "cloud_fwp", "cloud_twp", "cloud_tt"), ("system", "t", "y", "x"), 6)


@query(
    _OBJECTS + f"SELECT system, u_tracks AS core, t, z, {_rs('sum(area)', 'core_area', 4)}, {_rs('avg(w)', 'core_mean_w')}, {_rs('max(w)', 'core_amax_w')}, {_rs('max(cmf)', 'core_cmf_max')}, {_rs('avg(cmf)', 'core_cmf_mu')}, {_rs('sum(cmf * area) / 1e6', 'core_cmt', 4)} "
    "FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4"
)
def core_stats(spark, sf):
    o = _objects(spark, sf).where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    r = stats.evaluate(o, ("system", "core"), stats.core())["tz"]
    return r.select("system", "core", "t", "z", _r("core_area", 4).alias("core_area"), *(_r(c).alias(c) for c in ("core_mean_w", "core_amax_w", "core_cmf_max", "core_cmf_mu")), _r(F.col("core_cmt") / 1e6, 4).alias("core_cmt"))


@query(_OBJECTS + f"SELECT system, u_tracks AS core, t, y, x, {_rs('max(w)', 'core_max_w')}, {_rs('arg_max(w, z)', 'core_top_w')}, {_rs('arg_max(cmf, z)', 'core_top_cmf')} FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4, 5")
def core_stats_pixel(spark, sf):
    o = _objects(spark, sf).where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    r = stats.evaluate(o, ("system", "core"), stats.core())["tyx"]
    return _rounded(r.select("system", "core", "t", "y", "x", "core_max_w", "core_top_w", "core_top_cmf"), ("system", "core", "t", "y", "x"), 6)


@query(_OBJECTS + f"SELECT system, t, {_rs('sum(qs)', 'cloud_qs')}, {_rs('sum(qg)', 'cloud_qg')}, {_rs('sum(qr)', 'cloud_qr')}, {_rs('min(ta)', 'cloud_tt')} FROM ob GROUP BY 1, 2")
def bulk_stats(spark, sf):
    return _rounded(stats.evaluate(_objects(spark, sf), ("system",), stats.bulk("cloud"))["t"], ("system", "t"), 6)


_TW = _OBJECTS + (
    ", tw AS (SELECT system, t, z, sum(twc * volume) AS tw FROM ob GROUP BY 1, 2, 3), base AS (SELECT system, avg(zb) AS abh FROM (SELECT system, t, arg_max(z, tw) AS zb FROM (SELECT system, t, z, round(tw / 1e6, 4) - z / 1e9 AS tw FROM tw) GROUP BY 1, 2) GROUP BY 1), "
    "an AS (SELECT ob.*, abh FROM ob JOIN base USING (system) WHERE z >= abh) "
)


@query(_TW + f"SELECT system, t, {_rs('sum(volume)', 'anvil_volume', 4)}, {_rs('max(zg)', 'anvil_cth', 4)}, {_rs('min(zg)', 'anvil_cbh', 4)} FROM an GROUP BY 1, 2")
def anvil_stats(spark, sf):
    """Statistics of what lies at and above a system's mean level of most water."""
    o = _objects(spark, sf).select("system", *DIMS, "zg", "rho", "fwc", "twc", "area", "depth", "volume", "div")
    o = shuffled(Scratch(spark).save(o))  # read twice
    tw = o.groupBy("system", "t", "z").agg(F.sum(F.col("twc") * F.col("volume")).alias("tw"))
    base = tw.groupBy("system", "t").agg(F.max_by("z", F.round(F.col("tw") / 1e6, 4) - F.col("z") / 1e9).alias("zb")).groupBy("system").agg(F.avg("zb").alias("abh"))
    return _rounded(stats.evaluate(pr.anvil_mask(o, base, ("system",), "z"), ("system",), stats.anvil())["t"], ("system", "t"))


@query(
    _OBJECTS + f", lv AS (SELECT u_tracks AS core, system, t, y, x, w, cmf FROM ob WHERE u_tracks > 0 AND z = 2) SELECT system, core, t, y, x, {_rs('max(w)', 'core_abh_w')}, {_rs('max(cmf)', 'core_abh_cmf')} FROM lv GROUP BY 1, 2, 3, 4, 5"
)
def core_at_level(spark, sf):
    o = _objects(spark, sf).where("u_tracks > 0").withColumnRenamed("u_tracks", "core").select("system", "core", *DIMS, "w", "cmf")
    o = shuffled(Scratch(spark).save(o))  # read twice
    keys = ("system", "core")
    return _rounded(stats.at_level(o, keys, o.select(*keys).distinct().withColumn("abh", F.lit(2))), (*keys, "t", "y", "x"), 6)


@query(q.with_(q.vox("v")) + "SELECT t, arg_min(y, k) AS y, arg_min(x, k) AS x, max(vmax) AS vmax FROM (SELECT *, row(-vmax, y, x) AS k FROM v) GROUP BY t")
def max_location(spark, sf):
    return environment.max_location(voxels(spark, sf).groupBy("t", "y", "x").agg(F.max("vmax").alias("vmax")), "vmax")


@query(
    _OBJECTS + ", px AS (SELECT system, t, y, x, max(CASE WHEN u_tracks > 0 THEN round(cmf, 6) END) AS f, round(sum(fwc * depth), 6) AS p FROM ob GROUP BY 1, 2, 3, 4) "
    "SELECT system, t, coalesce(arg_min(y, row(-f, y, x)) FILTER (f IS NOT NULL), arg_min(y, row(-p, y, x))) AS y, coalesce(arg_min(x, row(-f, y, x)) FILTER (f IS NOT NULL), arg_min(x, row(-p, y, x))) AS x FROM px GROUP BY 1, 2"
)
def cloud_centre(spark, sf):
    o = _objects(spark, sf)
    px = o.groupBy("system", "t", "y", "x").agg(F.max(F.when(F.col("u_tracks") > 0, F.round("cmf", 6))).alias("f"), F.round(F.sum(F.col("fwc") * F.col("depth")), 6).alias("p"))
    return environment.cloud_centre(px, "f", "p")


@query(q.with_(q.vox("v", "all")) + f"SELECT t, z, y // 2 AS y, x // 2 AS x, {_rs('avg(vmax)', 'vmax')} FROM v WHERE x < 14 GROUP BY 1, 2, 3, 4")
def coarsen_2x2(spark, sf):
    return _rounded(coarsen(voxels(spark, sf, "all"), ("t", "z"), ["vmax"], 2, x_size=15), ("t", "z", "y", "x"), 6)


# --- columns ----------------------------------------------------------------------------------

KEY = ("col",)
_C = "WITH " + q.COLUMNS + " "
_W = "(PARTITION BY col ORDER BY lev)"


@query(
    _C + f"SELECT col, lev, {_rs('pfull / (287.04 * ta)', 'dry')}, {_rs(f'{q.E_} / (461.4 * ta) + (pfull - {q.E_}) / (287.04 * ta)', 'moist')}, {_rs(q.RHO, 'total')}, "
    f"{_rs('pfull / (287.04 * ta * (1 + (461.4 / 287.04 - 1) * hus - (cli + clw + qg + qr + qs)))', 'legacy')} FROM cols"
)
def densities(spark, sf):
    c = columns(spark, sf)
    p, t, hus, qs = F.col("pfull"), F.col("ta"), F.col("hus"), [F.col(x) for x in ph.PROFILES["10km"]]
    return c.select("col", "lev", _r(ph.dry_density(p, t)).alias("dry"), _r(ph.moist_density(p, t, ph.vapour_pressure(p, hus))).alias("moist"), _r(ph.total_density(p, t, hus, qs)).alias("total"), _r(ph.legacy_density(p, t, hus, qs)).alias("legacy"))


@query(_C + f"SELECT col, lev, {_rs(q.E_, 'e', 4)}, {_rs(q.ALPHA, 'alpha')}, {_rs(q.ES_W, 'es_water', 4)}, {_rs(q.ES_I, 'es_ice', 4)}, {_rs(q.RH, 'rh')} FROM cols")
def relative_humidity(spark, sf):
    p, t, hus = F.col("pfull"), F.col("ta"), F.col("hus")
    return columns(spark, sf).select("col", "lev", _r(ph.vapour_pressure(p, hus), 4).alias("e"), _r(ph.mixed_phase(t)).alias("alpha"), _r(ph.saturation(t), 4).alias("es_water"), _r(ph.saturation(t, ice=True), 4).alias("es_ice"), _r(ph.relative_humidity(p, t, hus)).alias("rh"))


@query(_C + f"SELECT col, {_rs(f'sum((cli + qs + qg) * {q.RHO} * dzghalf)', 'iwp')}, {_rs(f'sum((cli + clw + qg + qr + qs) * {q.RHO} * dzghalf)', 'twp')}, {_rs(f'sum(hus * {q.RHO} * dzghalf)', 'wvp')} FROM cols GROUP BY col")
def column_water_path(spark, sf):
    c = columns(spark, sf).withColumn("rho", ph.total_density(F.col("pfull"), F.col("ta"), F.col("hus"), [F.col(x) for x in ph.PROFILES["10km"]]))
    path = lambda *v: _r(F.sum(ph.content(ph.total([F.col(x) for x in v]), F.col("rho")) * F.col("dzghalf")))
    return c.groupBy("col").agg(path("cli", "qs", "qg").alias("iwp"), path("cli", "clw", "qg", "qr", "qs").alias("twp"), path("hus").alias("wvp"))


@query(_C + f"SELECT lev, {_rs(f'sum(wa_phy * {q.RHO} * 121000000.0) / 1e12', 'transport', 4)}, {_rs(f'max(cli * wa_phy * {q.RHO})', 'ice_flux')} FROM cols GROUP BY lev")
def mass_flux_transport(spark, sf):
    rho = ph.total_density(F.col("pfull"), F.col("ta"), F.col("hus"), [F.col(x) for x in ph.PROFILES["10km"]])
    c = columns(spark, sf).select("lev", ph.mass_flux(F.col("wa_phy"), rho).alias("f"), ph.mass_flux(F.col("wa_phy"), rho, F.col("cli")).alias("i"))
    return c.groupBy("lev").agg(_r(F.sum(F.col("f") * 121000000.0) / 1e12, 4).alias("transport"), _r(F.max("i")).alias("ice_flux"))


@query(_C + f"SELECT col, lev, CASE WHEN count(ta) OVER w3 = 3 THEN round(avg(ta) OVER w3, 6) + 0.0 END AS smooth FROM cols WINDOW w3 AS (PARTITION BY col ORDER BY lev ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def rolling_level_mean(spark, sf):
    return columns(spark, sf).select("col", "lev", _r(pr.rolling_mean(KEY, "lev", F.col("ta"))).alias("smooth"))


@query(_C + f"SELECT col, lev, {_rs(q.derivative('zg', 'ta', _W), 'slope')} FROM cols")
def level_derivative(spark, sf):
    return columns(spark, sf).select("col", "lev", _r(pr.derivative(KEY, "zg", F.col("ta"))).alias("slope"))


@query(_C + f"SELECT col, lev, {_rs(q.gradient('zg', 'ta', _W), 'slope')} FROM cols")
def gradient_edge2(spark, sf):
    return columns(spark, sf).select("col", "lev", _r(pr.gradient(KEY, "lev", F.col("zg"), F.col("ta"))).alias("slope"))


@query(_C + f"SELECT col, lev, abs(lead(zg) OVER {_W} - zg) AS depth FROM cols")
def layer_depth(spark, sf):
    return columns(spark, sf).select("col", "lev", pr.layer_depth(KEY, "lev", F.col("zg")).alias("depth"))


@query(_C + f"SELECT col, lev, {_rs(f'(wa_phy + coalesce(lead(wa_phy) OVER {_W}, 2 * wa_phy - lag(wa_phy) OVER {_W})) / 2', 'w')} FROM cols")
def half_to_full_levels(spark, sf):
    return columns(spark, sf).select("col", "lev", _r(pr.half_to_full(KEY, "lev", F.col("wa_phy"))).alias("w"))


_TH = ", th AS (SELECT *, ta * pow(100000.0 / pfull, 0.2857) AS theta FROM cols) "


@query(_C[:-1] + _TH + f"SELECT col, lev, {_rs('ta / theta * (' + q.gradient('pfull', 'theta', _W) + ')', 's')} FROM th")
def static_stability(spark, sf):
    c = columns(spark, sf).withColumn("theta", ph.potential_temperature(F.col("pfull"), F.col("ta")))
    return c.select("col", "lev", _r(pr.static_stability(KEY, "lev", F.col("pfull"), F.col("ta"), F.col("theta"))).alias("s"))


@query(
    _C[:-1] + f", k AS (SELECT *, zg / 1000 AS km FROM cols), l AS (SELECT col, km, coalesce(-({q.gradient('km', 'ta', '(PARTITION BY col ORDER BY km)')}) <= 2, false) AS low FROM k), "
    "f AS (SELECT col, km, low AND NOT coalesce(lag(low) OVER (PARTITION BY col ORDER BY km), false) AS starts, bool_and(low) OVER (PARTITION BY col ORDER BY km RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS holds FROM l) "
    "SELECT col, min(km) FILTER (starts AND holds) AS tropopause FROM f GROUP BY col"
)
def tropopause(spark, sf):
    return pr.tropopause(columns(spark, sf), KEY)


@query(
    _C[:-1] + ", n AS (SELECT col, arg_min(ua, row(abs(zg - 0), lev)) AS u0, arg_min(va, row(abs(zg - 0), lev)) AS v0, arg_min(ua, row(abs(zg - 6000), lev)) AS u1, arg_min(va, row(abs(zg - 6000), lev)) AS v1 FROM cols GROUP BY col) "
    f"SELECT col, {_rs('sqrt(pow(u1 - u0, 2) + pow(v1 - v0, 2))', 'shear')} FROM n"
)
def wind_shear(spark, sf):
    return _rounded(pr.wind_shear(columns(spark, sf), KEY, 0.0, 6000.0), KEY, 6)


@query(_C + f"SELECT col, {_rs('arg_min(ta, row(abs(pfull - 75000), lev))', 'ta750')}, {_rs('arg_min(hus, row(abs(pfull - 75000), lev))', 'hus750')} FROM cols GROUP BY col")
def nearest_level(spark, sf):
    at = lambda v: _r(pr.nearest(F.col(v), F.col("pfull"), 75000.0, "lev"))
    return columns(spark, sf).groupBy("col").agg(at("ta").alias("ta750"), at("hus").alias("hus750"))


def _parcel_sql() -> str:
    """A parcel lifted in twelve midpoint steps a level, and the areas between it and its surroundings in ln p."""
    slope = lambda p, t: f"((287.04 * {t} + 2.501e6 * ({q.RD} / {q.RV} * {e(p, t)} / ({p} - {e(p, t)}))) / (1004.7 + 2.501e6 * 2.501e6 * ({q.RD} / {q.RV} * {e(p, t)} / ({p} - {e(p, t)})) * ({q.RD} / {q.RV}) / (287.04 * {t} * {t})) / {p})"
    e = lambda p, t: f"least(611.2 * exp(17.67 * ({t} - 273.15) / ({t} - 29.65)), 0.9 * {p})"
    return (
        "WITH RECURSIVE " + q.COLUMNS + f", lv AS MATERIALIZED (SELECT col, row_number() OVER (PARTITION BY col ORDER BY pfull DESC) - 1 AS k, pfull AS p, ta AS t, {q.RH} AS rh FROM cols), "
        "g0 AS (SELECT col, p AS p0, t AS t0, least(greatest(rh, 1e-4), 1.0) AS r0 FROM lv WHERE k = 0), g AS MATERIALIZED (SELECT *, 1 / (1 / (t0 - 55) - ln(r0) / 2840) + 55 AS tl, p0 * pow((1 / (1 / (t0 - 55) - ln(r0) / 2840) + 55) / t0, 1 / 0.2857) AS pl FROM g0), "
        "up(col, n, wet, pos, h) AS (SELECT col, 0, tl, pl, CAST(0 AS DOUBLE) FROM g UNION ALL SELECT col, n + 1, wet + h * " + slope("(pos + h / 2)", "mid") + ", pos + h, h FROM (SELECT up.col, n, wet, pos, CASE WHEN n % 12 = 0 THEN (least(lv.p, g.pl) - pos) / 12 ELSE h END AS h, "
        "wet + " + slope("pos", "wet") + " * (CASE WHEN n % 12 = 0 THEN (least(lv.p, g.pl) - pos) / 12 ELSE h END) / 2 AS mid FROM up JOIN g USING (col) JOIN lv ON lv.col = up.col AND lv.k = n // 12 + 1)), "
        "li AS (SELECT lv.col, k, p, t, CASE WHEN k = 0 THEN t WHEN p >= pl THEN t0 * pow(p / p0, 0.2857) ELSE wet END - t AS d FROM lv JOIN g USING (col) LEFT JOIN up ON up.col = lv.col AND up.n = lv.k * 12), "
        "sg AS (SELECT col, k, d AS a, lead(d) OVER w AS b, ln(p / lead(p) OVER w) AS dx, p FROM li WINDOW w AS (PARTITION BY col ORDER BY k)), sx AS (SELECT *, CASE WHEN a * b < 0 THEN a / (a - b) ELSE 0 END AS cr FROM sg WHERE b IS NOT NULL), "
        "ar AS (SELECT *, dx * CASE WHEN a >= 0 AND b >= 0 THEN (a + b) / 2 WHEN a > 0 THEN a * cr / 2 WHEN b > 0 THEN b * (1 - cr) / 2 ELSE 0 END AS plus, dx * CASE WHEN a <= 0 AND b <= 0 THEN (a + b) / 2 WHEN a < 0 THEN a * cr / 2 WHEN b < 0 THEN b * (1 - cr) / 2 ELSE 0 END AS minus, min(k) FILTER (a <= 0 AND b > 0) OVER (PARTITION BY col) AS first FROM sx), "
        "sm AS (SELECT col, 287.04 * sum(plus) AS cape, 287.04 * sum(CASE WHEN k <= first THEN minus ELSE 0 END) AS cin, min(CASE WHEN k = first THEN exp(ln(p) - cr * dx) END) AS lfc FROM ar GROUP BY col), nl AS (SELECT col, count(*) AS n FROM lv GROUP BY col) "
        f"SELECT g.col, CASE WHEN n >= 5 THEN round(cape, 3) + 0.0 END AS cape, CASE WHEN n >= 5 THEN round(cin, 3) + 0.0 END AS cin, CASE WHEN n >= 5 THEN round(least(lfc, CASE WHEN lfc IS NULL THEN NULL ELSE p0 END), 2) + 0.0 END AS lfc, CASE WHEN n >= 5 THEN round(pl, 2) + 0.0 END AS lcl FROM g JOIN nl USING (col) LEFT JOIN sm USING (col)"
    )


@query(_parcel_sql())
def cape_cin_columns(spark, sf):
    c = columns(spark, sf).withColumn("rh", ph.relative_humidity(F.col("pfull"), F.col("ta"), F.col("hus")))
    return cape_cin(c).select("col", *(_r(x, n).alias(x) for x, n in (("cape", 3), ("cin", 3), ("lfc", 2), ("lcl", 2))))


@query(_C + f"SELECT col, {_rs('1 / (1 / (ta - 55) - ln(rh) / 2840) + 55', 't_lcl', 4)}, {_rs('pfull * pow((1 / (1 / (ta - 55) - ln(rh) / 2840) + 55) / ta, 1 / 0.2857)', 'p_lcl', 2)} FROM (SELECT *, {q.RH} AS rh FROM cols WHERE lev = 1)")
def condensation_level(spark, sf):
    p, t = F.col("pfull"), F.col("ta")
    c = columns(spark, sf).where("lev = 1").withColumn("rh", ph.relative_humidity(p, t, F.col("hus")))
    return c.select("col", _r(ph.lcl_temperature(t, F.col("rh")), 4).alias("t_lcl"), _r(ph.lcl_pressure(p, t, F.col("rh")), 2).alias("p_lcl"))


_S = (
    ", s AS (SELECT col, lev, CASE WHEN count(cli) OVER w3 = 3 THEN avg(cli) OVER w3 END AS s FROM cols WINDOW w3 AS (PARTITION BY col ORDER BY lev ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), "
    f"d AS (SELECT col, lev, {q.derivative('lev', 's', _W)} AS d FROM s), "
)


@query(
    _C[:-1] + _S + f"p AS (SELECT *, lag(d) OVER {_W} AS b FROM d), f AS (SELECT col, lev, max(lev) FILTER (d > 1e-10 AND b <= 1e-10) OVER (PARTITION BY col) AS top, d <= -1e-10 AND b > -1e-10 AS fall FROM p) "
    "SELECT col, max(lev) FILTER (fall AND lev <= top) AS abh FROM f GROUP BY col"
)
def anvil_base(spark, sf):
    return pr.anvil_base(columns(spark, sf), KEY, "lev", "cli")


@query(
    _C[:-1] + _S + "p AS (SELECT col, lev, -d AS d, lead(-d) OVER (PARTITION BY col ORDER BY lev DESC) AS b FROM d), f AS (SELECT col, lev, min(lev) FILTER (d > 0 AND b <= 0) OVER (PARTITION BY col) AS top, d <= 0 AND b > 0 AS low FROM p) "
    "SELECT col, min(lev) FILTER (low AND lev >= top) AS abh FROM f GROUP BY col"
)
def anvil_base_old(spark, sf):
    return pr.anvil_base_old(columns(spark, sf), KEY, "lev", "cli")


@query(_C[:-1] + ", b AS (SELECT col, avg(lev) AS abh FROM cols WHERE cli > 0.00003 GROUP BY col) SELECT cols.col, lev, zg FROM cols JOIN b USING (col) WHERE lev >= abh")
def anvil_mask(spark, sf):
    c = columns(spark, sf)
    base = c.where("cli > 0.00003").groupBy("col").agg(F.avg("lev").alias("abh"))
    return pr.anvil_mask(c, base, KEY).select("col", "lev", "zg")


@query(
    _C[:-1] + ", s AS (SELECT col, lev, zg, lead(lev) OVER w AS z2, lead(zg) OVER w AS h2 FROM cols WINDOW w AS (PARTITION BY col ORDER BY lev)), "
    "a AS (SELECT *, max(CASE WHEN 2 >= lev AND 2 < z2 THEN zg + (2 - lev) / CAST(z2 - lev AS DOUBLE) * (h2 - zg) WHEN z2 IS NULL AND lev = 2 THEN zg END) OVER (PARTITION BY col) + 1000 AS goal FROM s) "
    f"SELECT col, {_rs('min(CASE WHEN goal >= least(zg, h2) AND goal <= greatest(zg, h2) THEN lev + (goal - zg) / (h2 - zg) * (z2 - lev) END)', 'shifted')} FROM a GROUP BY col"
)
def shift_level(spark, sf):
    """Level 2 moved up by a kilometre."""
    return _rounded(pr.shift_level(columns(spark, sf), KEY, F.lit(2.0), 1.0), KEY, 6)


_H = lambda n: f"CAST(floor({n}) AS BIGINT)"


_POINTS = "SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 3600 AS DOUBLE) / 10.0 - 180 AS lon, CAST((o_orderkey * 17) % 1790 AS DOUBLE) / 10.0 - 89.5 AS lat FROM orders"


def _healpix_sql(zoom: int, points: str = _POINTS) -> str:
    """CTEs up to px (id, pix): the pixels of points (id, lon, lat)."""
    n = 1 << zoom
    bits = lambda v, s: " + ".join(f"(({v} >> {k}) & 1) * {s << 2 * k}" for k in range(zoom))
    return (
        f"WITH p AS ({points}), a AS (SELECT id, sin(radians(lat)) AS z, (CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 90.0 AS tt FROM p), "
        f"b AS (SELECT *, abs(z) > 2.0 / 3 AS pole, {_H(f'{n} * (0.5 + tt) - {n} * z * 0.75')} AS jp, {_H(f'{n} * (0.5 + tt) + {n} * z * 0.75')} AS jm, least(3, {_H('tt')}) AS k FROM a), "
        f"c AS (SELECT *, jp >> {zoom} AS fp, jm >> {zoom} AS fm, least({n - 1}, {_H(f'(tt - k) * ({n} * sqrt(3 * (1 - abs(z))))')}) AS u, least({n - 1}, {_H(f'(1 - (tt - k)) * ({n} * sqrt(3 * (1 - abs(z))))')}) AS v FROM b), "
        f"d AS (SELECT id, CASE WHEN pole THEN CASE WHEN z >= 0 THEN k ELSE k + 8 END WHEN fp = fm THEN (fp & 3) + 4 WHEN fp < fm THEN fp & 3 ELSE (fm & 3) + 8 END AS face, "
        f"CASE WHEN pole THEN CASE WHEN z >= 0 THEN {n} - v - 1 ELSE u END ELSE jm & {n - 1} END AS ix, CASE WHEN pole THEN CASE WHEN z >= 0 THEN {n} - u - 1 ELSE v END ELSE {n} - (jp & {n - 1}) - 1 END AS iy FROM c), "
        f"px AS (SELECT id, CAST(face * {n * n} + {bits('ix', 1)} + {bits('iy', 2)} AS BIGINT) AS pix FROM d) "
    )


@query(_healpix_sql(6) + "SELECT id, pix FROM px")
def healpix_cells(spark, sf):
    o = table(spark, sf, "orders")
    lon, lat = ((F.col("o_orderkey") * 37) % 3600).cast("double") / F.lit(10.0) - 180, ((F.col("o_orderkey") * 17) % 1790).cast("double") / F.lit(10.0) - 89.5
    return o.select(F.col("o_orderkey").alias("id"), ph.healpix(lon, lat, 6).alias("pix"))


@query(_C + "SELECT col, CAST(round((lon + 180) / 0.25) AS BIGINT) AS ix, CAST(round((lat + 90) / 0.25) AS BIGINT) AS iy FROM cols WHERE lev = 1 AND lon BETWEEN -83 AND -30 AND lat BETWEEN -15 AND 10")
def regrid_snap(spark, sf):
    c = columns(spark, sf).where(F.col("lon").between(-83, -30) & F.col("lat").between(-15, 10) & (F.col("lev") == 1))
    return c.select("col", snap(F.col("lon"), 0.25, -180.0).alias("ix"), snap(F.col("lat"), 0.25, -90.0).alias("iy"))


@query(
    _healpix_sql(5, f"SELECT -id AS id, lon, lat FROM ({_POINTS}) UNION ALL SELECT iy * 1000 + ix, -180.0 + ix * CAST(0.5 AS DOUBLE), -90.0 + iy * CAST(0.5 AS DOUBLE) FROM range(194, 274) r(ix), range(150, 210) s(iy)")[:-1]
    + ", cells AS (SELECT pix, count(*) AS n, min(-id) AS first FROM px WHERE id < 0 GROUP BY 1) SELECT id // 1000 AS iy, id % 1000 AS ix, n, first FROM px JOIN cells USING (pix) WHERE id > 0"
)
def regrid_region(spark, sf):
    """The Amazon on half a degree, of HEALPix cells that orders fall into."""
    o = table(spark, sf, "orders")
    lon, lat = ((F.col("o_orderkey") * 37) % 3600).cast("double") / F.lit(10.0) - 180, ((F.col("o_orderkey") * 17) % 1790).cast("double") / F.lit(10.0) - 89.5
    cells = o.select(ph.healpix(lon, lat, 5).alias("cell"), F.col("o_orderkey").alias("id")).groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return regrid(cells, "amazon", 5, 0.5).select("iy", "ix", "n", "first")


# --- records ----------------------------------------------------------------------------------

_R = "WITH " + q.RECORDS + " "
_CENTRE = (
    "per AS (SELECT dcc, updraft, min(time) AS start, count(*) AS n, arg_min({'lon': lon, 'lat': lat, 'time': time}, {'t': time, 'r': row}) AS fst FROM rec GROUP BY 1, 2), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY dcc ORDER BY start, n DESC, updraft) AS k FROM per), "
    "centre AS (SELECT dcc, updraft, fst.lon AS lon, fst.lat AS lat, fst.time - INTERVAL 15 MINUTE AS time FROM best WHERE k = 1) "
)


@query(_R[:-1] + ", " + _CENTRE + "SELECT dcc, updraft, lon, lat, time FROM centre")
def storm_centre(spark, sf):
    return lineage.storm_centres(records(spark, sf))


_CAT = (
    "cat AS (SELECT dcc, min(time) AS initial_time, (epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9 + 0.25 AS lifetime, count(DISTINCT updraft) AS ncores, max(npix) AS npixels, "
    "arg_min(lon, {'t': time, 'r': row}) AS initial_lon, arg_min(lat, {'t': time, 'r': row}) AS initial_lat, count(*) AS rows FROM rec GROUP BY dcc) "
)


@query(_R[:-1] + ", " + _CAT + f"SELECT dcc, initial_time, {_rs('lifetime', 'lifetime')}, ncores, npixels, initial_lon, initial_lat, rows FROM cat")
def system_catalogue(spark, sf):
    return lineage.catalogue(records(spark, sf)).withColumn("lifetime", _r("lifetime"))


@query(
    _R[:-1] + ", " + _CAT + ", late AS (SELECT * FROM cat WHERE initial_time > TIMESTAMP '1992-06-01') SELECT 'not invalid' AS rule, dcc FROM late WHERE NOT rows < 4 AND lifetime < 20000 AND npixels < 300 "
    "UNION ALL SELECT 'valid', dcc FROM late WHERE ncores > 2 AND lifetime < 50000 AND npixels < 400 AND ncores < 5"
)
def filter_systems(spark, sf):
    cat = lineage.catalogue(records(spark, sf)).withColumn("invalid", F.col("rows") < 4).withColumn("valid", F.col("ncores") > 2)
    one = lineage.select_systems(cat, "invalid", 20000, 300, "1992-06-01").select(F.lit("not invalid").alias("rule"), "dcc")
    return one.unionByName(lineage.select_systems(cat, "valid", 50000, 400, "1992-06-01", max_cores=5).select(F.lit("valid").alias("rule"), "dcc"))


@query(
    _R[:-1] + ", o AS (SELECT dcc, npix, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dcc) AS n, lead(npix) OVER w AS nx FROM rec WINDOW w AS (PARTITION BY dcc ORDER BY time, row)), b AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS bin) "
    "SELECT dcc, bin, CASE WHEN n = 1 THEN NULL WHEN nx IS NULL THEN CAST(npix AS DOUBLE) ELSE round(npix + (CAST(bin AS DOUBLE) * (n - 1) / 20.0 - i) * (nx - npix), 6) + 0.0 END AS value "
    "FROM o JOIN b ON n = 1 OR (bin * (n - 1) >= 20 * i AND (bin * (n - 1) < 20 * (i + 1)))"
)
def lifetime_normalised(spark, sf):
    return lineage.lifetime_normalised(records(spark, sf), "dcc", ["time", "row"], "npix").withColumn("value", _r("value"))


_MAPS = ", m1 AS (SELECT DISTINCT dcc AS old, least(dcc, dcc // 2 + 1) AS new FROM rec), m2 AS (SELECT old, min(new) - 0 AS new FROM m1 WHERE old > new + 20 GROUP BY 1) "


def _maps(spark, sf):
    r = records(spark, sf)
    m1 = r.select(F.col("dcc").alias("old"), F.least(F.col("dcc"), F.expr("dcc DIV 2 + 1")).alias("new")).distinct()
    return r, m1, m1.where("old > new + 20")


@query(_R[:-1] + _MAPS + "SELECT m1.old, coalesce(m2.new, m1.new) AS new FROM m1 LEFT JOIN m2 ON m1.new = m2.old")
def link_map_compose(spark, sf):
    _, m1, m2 = _maps(spark, sf)
    return lineage.compose_links(m1, m2)


@query(_R[:-1] + _MAPS + "SELECT row, dcc + (SELECT min(old) - 1 FROM m2 WHERE old > 0) AS system, coalesce(m2.new, 0) AS linked FROM rec LEFT JOIN m2 ON m2.old = dcc + (SELECT min(old) - 1 FROM m2 WHERE old > 0)")
def apply_linking(spark, sf):
    r, _, m2 = _maps(spark, sf)
    return lineage.apply_linking(r.select("row", F.col("dcc").alias("system")), m2).select("row", "system", "linked")


@query(_R[:-1] + _MAPS + "SELECT row, updraft, CAST(0 AS BIGINT) AS cloud, coalesce(m2.new, 0) AS system FROM rec LEFT JOIN m2 ON updraft = m2.old UNION ALL SELECT row, 0, dcc, coalesce(m1.new, 0) FROM rec LEFT JOIN m1 ON dcc = m1.old")
def record_merge(spark, sf):
    r, m1, m2 = _maps(spark, sf)
    return lineage.merge_records(r.select("row", "updraft"), r.select("row", F.col("dcc").alias("cloud")), m2, m1).select("row", "updraft", "cloud", "system")


@query(
    _C[:-1] + ", d AS (SELECT DISTINCT col % 100 AS g, lon FROM cols), g AS (SELECT g, lon, coalesce(lead(lon) OVER (PARTITION BY g ORDER BY lon), min(lon) OVER (PARTITION BY g) + 360) AS nx FROM d), "
    "b AS (SELECT g, lon, nx FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(nx - lon, 9) DESC, lon) AS k FROM g) WHERE k = 1), s AS (SELECT g, CASE WHEN nx >= 180 THEN nx - 360 ELSE nx END AS lonn, CASE WHEN lon - nx < 0 THEN lon - nx + 360 ELSE lon - nx END AS span FROM b) "
    f"SELECT g, {_rs('lonn', 'lonn')}, {_rs('lonn + span', 'lonx')}, lonn + span > 180 AS crosses FROM s"
)
def lon_extent(spark, sf):
    return _rounded(environment.circular_extent(columns(spark, sf).select((F.col("col") % 100).alias("g"), "lon"), ("g",)), ("g",), 6)


_ENV = "WITH " + q.RECORDS + ", " + _CENTRE[:-1] + ", " + q.COLUMNS + ", pts AS (SELECT col, lon, lat, ta, ua, va FROM cols WHERE lev = 1), near AS (SELECT c.dcc, p.*, c.lon AS clon, c.lat AS clat, sqrt(pow(c.lon - p.lon, 2) + pow(c.lat - p.lat, 2)) AS distance FROM centre c JOIN pts p ON abs(c.lon - p.lon) < 2.05 AND abs(c.lat - p.lat) < 2.05) "


def _env(spark, sf):
    points = columns(spark, sf).where("lev = 1").select("col", "lon", "lat", "ta", F.col("ua").alias("u"), F.col("va").alias("v"))
    return points, lineage.storm_centres(records(spark, sf)).select("dcc", F.col("lon").alias("clon"), F.col("lat").alias("clat"))


@query(_ENV + f"SELECT dcc, count(*) AS n, {_rs('avg(ta)', 'ta')} FROM near WHERE distance < 2.05 GROUP BY dcc")
def environment_radius(spark, sf):
    return environment.interacting(*_env(spark, sf), 2.05).groupBy("dcc").agg(F.count("*").alias("n"), _r(F.avg("ta")).alias("ta"))


@query(_ENV + f"SELECT dcc, count(*) AS n, {_rs('avg(ta)', 'ta')} FROM near WHERE distance < 2.05 AND distance > 0 AND (clon - lon) * ua + (clat - lat) * va > 0 GROUP BY dcc")
def environment_ingested(spark, sf):
    return environment.ingested(*_env(spark, sf), 2.05).groupBy("dcc").agg(F.count("*").alias("n"), _r(F.avg("ta")).alias("ta"))


@query(
    _R[:-1] + ", st AS (SELECT dcc AS system, time AS t, CAST(npix % 7 + 1 AS DOUBLE) AS abh, CAST(npix % 5 + 1 AS DOUBLE) AS cth, npix % 2 = 0 AS core FROM rec), per AS (SELECT system, min(t) AS t0, max(t) AS t1, avg(abh) AS m FROM st GROUP BY 1), "
    "f AS (SELECT st.system, any_value(t0) AS t0, any_value(t1) AS t1, any_value(m) AS m, min(t) FILTER (cth <= m) AS a0, min(t) FILTER (core) AS c0 FROM st JOIN per USING (system) GROUP BY 1) "
    f"SELECT system, {_rs('(epoch_us(t1) - epoch_us(t0)) / 3.6e9', 'lifetime')}, {_rs('m', 'abh')}, (epoch_us(t1) - epoch_us(t0)) / 3.6e9 > 1000 AND coalesce(c0 <= a0, false) AS keep FROM f"
)
def anvil_filter(spark, sf):
    r = records(spark, sf).select(F.col("dcc").alias("system"), F.col("time").alias("t"), (F.col("npix") % 7 + 1).cast("double").alias("abh"), (F.col("npix") % 5 + 1).cast("double").alias("cth"), (F.col("npix") % 2 == 0).alias("core"))
    return _rounded(lineage.anvil_filter(r, 1000), ("system",), 6)


@query(_R[:-1] + ", r AS (SELECT dcc FROM rec GROUP BY 1 HAVING max(npix) < 470) SELECT dcc FROM r ORDER BY dcc OFFSET 100")
def remaining_systems(spark, sf):
    """Systems from place 100 on of those not done; done are, here, the ones that ever had 470 pixels."""
    r = records(spark, sf)
    return lineage.remaining(r.select("dcc"), r.where("npix >= 470").select("dcc").distinct(), "dcc", 100)


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS vmax FROM events GROUP BY 1, 2")
def events_stream_windows(spark, sf):
    return windows.counts(table(spark, sf, "events"))


@query("SELECT o_orderkey AS id, o_orderkey % 9 * 86400 + o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 50 AS seconds FROM orders")
def timedelta_parse(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", (k % 9).cast("string"), F.lit("days"), F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 50))
    return table(spark, sf, "orders").select(k.alias("id"), readers.timedelta_seconds(text).alias("seconds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["axis", "oracle_sql", "queries"]

from . import bundle_queries, more_queries, source_queries  # noqa: E402, F401  their queries register themselves here
