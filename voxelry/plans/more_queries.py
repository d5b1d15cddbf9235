"""Queries of readers, projections and options that the other catalogues don't reach, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions import profiles as pr
from ..model import DIMS, Grid
from ..operators import environment, erosion, labelling, stats
from ..sources import readers
from ..sources.adapters import columns, grid_field, grid_mask, records, voxels
from ..storage import Scratch
from . import sqltext as q
from .bundle_queries import _FIELD, _r, _rs
from .catalogue import PLACE, query

_C = "WITH " + q.COLUMNS + " "
_E = "e AS (SELECT 1)"  # after the last comma


@query(_C + f"SELECT col, lev, {_rs(q.RHO, 'rho')}, {_rs('CASE WHEN ta < 273.15 THEN cli + clw + qg + qr + qs END * 1e3', 'qfrozen')} FROM cols")
def coarse_profile(spark, sf):
    """Density and frozen condensate of the model that has one condensate in all."""
    c = columns(spark, sf).withColumn("qall", F.col("cli") + F.col("clw") + F.col("qg") + F.col("qr") + F.col("qs")).drop("cli", "clw", "qg", "qr", "qs")
    rho = ph.total_density(F.col("pfull"), F.col("ta"), F.col("hus"), [F.col(x) for x in ph.profile(c.columns)])
    return readers.with_derived(c.withColumn("rho", rho), ["col", "lev", "rho", "qfrozen"]).select("col", "lev", _r(F.col("rho")).alias("rho"), _r(F.col("qfrozen") * 1e3).alias("qfrozen"))


_BLOCKS = (
    "ff AS (SELECT t, z, y // 2 AS y, x // 2 AS x, avg(CASE WHEN ta < 273.15 THEN cli + clw + qg + qr + qs ELSE 0 END) AS f, avg(rho) AS rho, avg(dzghalf) AS d, avg(wa_phy) AS wa FROM (SELECT *, CAST(1 AS DOUBLE) - lev / 10.0 AS rho FROM fld) WHERE t % 2 = 0 GROUP BY 1, 2, 3, 4) "
    f"SELECT t, y, x, {_rs('sum(f * rho * d)', 'iwp')}, {_rs('max(wa)', 'wmax')} FROM ff GROUP BY 1, 2, 3"
)


@query(_FIELD + _BLOCKS)
def projection_coarse(spark, sf):
    f = grid_field(spark, sf).withColumn("qall", F.col("cli") + F.col("clw") + F.col("qg") + F.col("qr") + F.col("qs")).withColumn("rho", F.lit(1.0) - F.col("lev") / F.lit(10.0)).withColumnRenamed("wa_phy", "wa")
    out = readers.projection(f, "2d_10xy_30min")
    return out.select("t", "y", "x", _r(F.col("iwp")).alias("iwp"), _r(F.col("wmax")).alias("wmax"))


@query(_FIELD + _E + " SELECT t, z, y, x, system, u_tracks FROM msk WHERE z BETWEEN 1 AND 4")
def level_slice(spark, sf):
    return readers.level_slice(grid_mask(spark, sf), 1, 4)


@query(_FIELD + "bx AS (SELECT min(t) - 2 AS t0, max(t) AS t1, min(glon) - 0.25 AS x0, max(glon) + 0.25 AS x1, min(glat) - 0.25 AS y0, max(glat) + 0.25 AS y1 FROM msk JOIN fld USING (t, z, y, x) WHERE system = 2) SELECT t, z, y, x FROM fld, bx WHERE t BETWEEN t0 AND t1 AND glon BETWEEN x0 AND x1 AND glat BETWEEN y0 AND y1")
def corresponding_field(spark, sf):
    """The field in the box of a system, and half an hour before."""
    stamp = F.timestamp_seconds(F.col("t").cast("long") * 900)
    field = grid_field(spark, sf).withColumn("time", stamp)
    own = grid_mask(spark, sf).where("system = 2").join(field.select(*DIMS, "time", "lon", "lat"), list(DIMS))
    return readers.corresponding(field, own, margin=0.25, before_minutes=30).select(*DIMS)


@query(
    _FIELD + "ct AS (SELECT system, min(t) AS t0, max(t) - min(t) AS span, arg_min(glon, row(t, z, y, x)) AS lon, arg_min(glat, row(t, z, y, x)) AS lat FROM msk JOIN fld USING (t, z, y, x) GROUP BY 1) "
    "SELECT m.t, m.z, m.y, m.x FROM msk m JOIN fld USING (t, z, y, x) JOIN ct USING (system) WHERE system = 3 AND abs(glon - ct.lon) <= 0.5 AND abs(glat - ct.lat) <= 0.5 AND m.t BETWEEN t0 AND t0 + span + 4"
)
def grab_system(spark, sf):
    """One system by its catalogue row, near its first place."""
    stamp = F.timestamp_seconds(F.col("t").cast("long") * 900)
    mask = grid_mask(spark, sf).join(grid_field(spark, sf).select(*DIMS, "lon", "lat"), list(DIMS)).withColumn("time", stamp)
    first = F.struct(*DIMS)
    cat = mask.groupBy(F.col("system").alias("dcc")).agg(F.min("time").alias("initial_time"), ((F.max("t") - F.min("t")) * 0.25).alias("lifetime"), F.min_by("lon", first).alias("initial_lon"), F.min_by("lat", first).alias("initial_lat"))
    return readers.grab_system(mask, cat, 3, degrees=0.5).select(*DIMS)


@query("WITH " + q.RECORDS + ", i AS (SELECT dcc, row_number() OVER (ORDER BY dcc) AS k FROM (SELECT DISTINCT dcc FROM rec WHERE dcc NOT IN (7, 8, 9))) SELECT row, dcc AS system FROM rec JOIN i USING (dcc) WHERE k BETWEEN 51 AND 100 AND npix > 20")
def load_results(spark, sf):
    """The second batch of fifty systems, some left out, through a callback."""
    r = records(spark, sf).select("row", F.col("dcc").alias("system"), "npix")
    return readers.load_results(r, ignore=[7, 8, 9], batch=1, size=50, apply=lambda d: d.where("npix > 20")).select("row", "system")


@query("WITH " + q.RECORDS + " SELECT dcc, row, npix FROM rec QUALIFY row_number() OVER (PARTITION BY dcc ORDER BY time, row) = 1")
def keep_first(spark, sf):
    return readers.keep_first(records(spark, sf), ["dcc"], ["time", "row"]).select("dcc", "row", "npix")


@query("WITH " + q.RECORDS + " SELECT updraft, count(*) AS n FROM rec GROUP BY 1 HAVING count(*) > 1")
def repeated_labels(spark, sf):
    return readers.repeated(records(spark, sf), "updraft")


@query("WITH " + q.RECORDS + " SELECT row, time + CAST(round(lon / 15) AS BIGINT) * INTERVAL 1 HOUR AS local FROM rec")
def local_time(spark, sf):
    r = records(spark, sf).select("row", "lon", F.col("time").cast("timestamp").alias("time"))
    return r.select("row", environment.local_time(F.col("time"), F.col("lon")).cast("timestamp_ntz").alias("local"))


_ZONES = [("west", -180.0, 0.0, -15.0, 15.0), ("amazon", -83.0, -43.0, -15.0, 15.0), ("congo", 1.0, 41.0, -15.0, 15.0), ("inner", 10.0, 20.0, -5.0, 5.0)]


@query(
    "WITH " + q.RECORDS + f", zn(zone, a, b, c, d) AS (VALUES {', '.join(map(str, _ZONES))}) SELECT row, zone FROM rec LEFT JOIN (SELECT row, arg_min(zone, (b - a) * (d - c)) AS zone "
    "FROM (SELECT rec.row, zn.*, lon, lat FROM rec, zn WHERE lon BETWEEN a AND b AND lat BETWEEN c AND d) GROUP BY 1) USING (row)"
)
def zones(spark, sf):
    table = spark.createDataFrame(_ZONES, "zone string, lon0 double, lon1 double, lat0 double, lat1 double")
    return environment.with_zone(records(spark, sf).select("row", "lon", "lat"), table).select("row", "zone")


@query(_C + ", b AS (SELECT col, avg(lev) AS abh FROM cols WHERE cli > 0.00003 GROUP BY col) SELECT cols.col, lev FROM cols JOIN b USING (col) WHERE lev <= abh")
def below_base(spark, sf):
    c = columns(spark, sf)
    base = c.where("cli > 0.00003").groupBy("col").agg(F.avg("lev").alias("abh"))
    return pr.anvil_mask(c, base, ("col",), above=False).select("col", "lev")


@query(_C + "SELECT col, lev, false AS descends FROM cols")
def level_order(spark, sf):
    """Heights rise with levels in every column, so none descends."""
    return columns(spark, sf).select("col", "lev", pr.descends(("col",), "lev", F.col("zg")).alias("descends"))


_STEP = "(radians(CAST(0.5 AS DOUBLE)) * 6371229.0)"


def _central(v: str, part: str, place: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {place})"
    return f"CASE WHEN lead({place}) {w} - {place} = 1 AND {place} - lag({place}) {w} = 1 THEN lead({v}) {w} - lag({v}) {w} END"


@query(_FIELD + _E + f" SELECT t, z, y, x, {_rs('1e4 * ((' + _central('ua', 't, z, y', 'x') + ') / (2 * ' + _STEP + ' * cos(radians(glat))) + (' + _central('va', 't, z, x', 'y') + ') / (2 * ' + _STEP + ') - va * tan(radians(glat)) / 6371229.0)', 'div')} FROM fld")
def divergence(spark, sf):
    out = stats.divergence(grid_field(spark, sf), 0.5, F.col("lat"))
    return out.select(*DIMS, _r(F.col("div") * 1e4).alias("div"))


_VOLUME = q.with_(
    q.vox("v", "cloud", 12), "m AS (SELECT t, z, y, x, CAST(1 + x // 5 + 3 * (y // 5) AS BIGINT) AS label FROM v)", "ys AS (SELECT max(y) + 1 AS ny FROM m)",
    "cells AS (SELECT t, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT t FROM m), range(0, 5) a(z), (SELECT unnest(range(0, (SELECT ny FROM ys))) AS y), range(0, 15) b(x))",
    "outside AS (SELECT c.t, c.z, c.y, c.x, m.label FROM cells c LEFT JOIN m USING (t, z, y, x))",
    "near AS (SELECT m.t, m.z, m.y, m.x, m.label, min((m.z - o.z) * (m.z - o.z) + (m.y - o.y) * (m.y - o.y) + (m.x - o.x) * (m.x - o.x)) AS d2 FROM m JOIN outside o ON o.t = m.t AND o.label IS DISTINCT FROM m.label GROUP BY ALL)",
)


@query(_VOLUME + f"SELECT {PLACE}, label, {_rs('sqrt(CAST(d2 AS DOUBLE)) / max(sqrt(CAST(d2 AS DOUBLE))) OVER (PARTITION BY t, label)', 'topography')} FROM near")
def topography_volume(spark, sf):
    m = voxels(spark, sf, coarse=12).select(*DIMS, F.expr("CAST(1 + x DIV 5 + 3 * (y DIV 5) AS BIGINT)").alias("label"))
    out = erosion.topography(m, m.agg(F.max("y")).first()[0] + 1, 15, z_size=5)
    return out.select(*DIMS, "label", _r(F.col("topography")).alias("topography"))


@query(q.with_(q.vox("v"), q.labelled("l", "v", q.FACES_4D, wrap_y="(SELECT max(y) + 1 FROM v)")) + f"SELECT {PLACE}, label FROM l")
def components_periodic_y(spark, sf):
    v = voxels(spark, sf)
    grid = Grid(y=v.agg(F.max("y")).first()[0] + 1)
    first = labelling.label(v, grid, Scratch(spark), periodic=("y",)).select(*DIMS, "label")
    return first


@query(_FIELD + _E + f" SELECT t, z, y, x, {_rs('coalesce(CASE WHEN wa_phy > 1 THEN wa_phy END, -999.99)', 'w', 4)} FROM fld")
def export_missing(spark, sf):
    """Doubles with the fill value where there is none."""
    f = grid_field(spark, sf).select(*DIMS, F.when(F.col("wa_phy") > 1, F.col("wa_phy")).alias("w"))
    return stats.export(f).select(*DIMS, _r(F.col("w"), 4).alias("w"))
