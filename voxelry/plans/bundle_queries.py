"""Queries of whole statistics bundles, and the SQL that checks them, over columns laid out on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles, lineage
from ..sources.adapters import grid_field, grid_mask
from ..storage import Scratch, shuffled
from . import sqltext as q
from .catalogue import query

RADIUS, DEGREES = 1.2, 0.5
_W = "(PARTITION BY col ORDER BY lev)"
_AREA = "CAST(121000000 AS DOUBLE)"
#: Moves values that lie between two rounded ones, as means of short decimals do, to one side in either engine.
_SIDE = 0.0371


def _r(c, n: int = 6):
    return F.round(c + F.lit(_SIDE * 10**-n), n) + F.lit(0.0)


def _rs(e: str, name: str, n: int = 6) -> str:
    return f"round({e} + {_SIDE * 10**-n:.10f}, {n}) + 0.0 AS {name}"


# --- the field, the mask, objects and centres -------------------------------------------------

_FIELD = (
    "WITH " + q.COLUMNS + ", fld AS (SELECT *, CAST(col % 60 AS INTEGER) AS t, CAST(lev - 1 AS INTEGER) AS z, CAST((col // 60) // 15 AS INTEGER) AS y, CAST((col // 60) % 15 AS INTEGER) AS x, "
    "((col // 60) % 15) * CAST(0.5 AS DOUBLE) AS glon, ((col // 60) // 15) * CAST(0.5 AS DOUBLE) AS glat, cli * CAST(100 AS DOUBLE) AS pr FROM cols), "
    "msk AS (SELECT t, z, y, x, CAST(1 + (y // 3) * 5 + x // 3 AS BIGINT) AS system, CASE WHEN wa_phy > 1 AND t >= 2 + (1 + (y // 3) * 5 + x // 3) % 7 THEN CAST((1 + (y // 3) * 5 + x // 3) * 10 + t // 10 AS BIGINT) END AS u_tracks "
    "FROM fld WHERE clw >= 0.00002 AND (z > 3 OR (z IN (1, 2) AND wa_phy > 1.55) OR wa_phy > 3.45)), "
    "pu AS (SELECT system, u_tracks, min(t) AS start, count(*) AS n, arg_min(y, row(t, z, y, x)) AS y, arg_min(x, row(t, z, y, x)) AS x FROM msk WHERE u_tracks > 0 GROUP BY 1, 2), "
    "cen AS (SELECT system, start - 1 AS t, x * CAST(0.5 AS DOUBLE) AS clon, y * CAST(0.5 AS DOUBLE) AS clat FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY start, n DESC, u_tracks) AS k FROM pu) WHERE k = 1), "
    f"th AS (SELECT *, ta * pow(100000.0 / pfull, 0.2857) AS theta, {q.RH} AS rh, hus * {q.RHO} * {_AREA} * dzghalf AS tpwv FROM fld), "
    f"st AS (SELECT *, ta / theta * ({q.gradient('pfull', 'theta', _W)}) AS s FROM th), "
)


def _near(name: str, radius: float) -> str:
    d = "sqrt(pow(clon - glon, 2) + pow(clat - glat, 2))"
    return f"{name} AS (SELECT cen.system, p.t, p.y, p.x, clon, clat, glon, glat, {d} AS distance FROM cen JOIN (SELECT DISTINCT t, y, x, glon, glat FROM fld) p USING (t) WHERE {d} < {radius}), "


def _at(value: str, height: float) -> str:
    return f"arg_min({value}, row(abs(zg - {height}), z))"


def _shear(a: float, b: float) -> str:
    return f"sqrt(pow({_at('ua', b)} - {_at('ua', a)}, 2) + pow({_at('va', b)} - {_at('va', a)}, 2))"


_TROPO = (
    f"tk AS (SELECT col, t, y, x, zg / 1000 AS km, ta FROM fld), tl AS (SELECT col, t, y, x, km, coalesce(-({q.gradient('km', 'ta', '(PARTITION BY col ORDER BY km)')}) <= 2, false) AS low FROM tk), "
    "tf AS (SELECT col, t, y, x, km, low AND NOT coalesce(lag(low) OVER (PARTITION BY col ORDER BY km), false) AS starts, bool_and(low) OVER (PARTITION BY col ORDER BY km RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS holds FROM tl), "
    "tropo AS (SELECT t, y, x, min(km) FILTER (starts AND holds) AS tropopause FROM tf GROUP BY 1, 2, 3), "
)


def _central(v: str, part: str, place: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {place})"
    return f"CASE WHEN lead({place}) {w} - {place} = 1 AND {place} - lag({place}) {w} = 1 THEN lead({v}) {w} - lag({v}) {w} END"


_STEP = "(radians(CAST(0.5 AS DOUBLE)) * 6371229.0)"
_OBJECTS = (
    f"dv AS (SELECT *, ({_central('ua', 't, z, y', 'x')}) / (2 * {_STEP} * cos(radians(glat))) + ({_central('va', 't, z, x', 'y')}) / (2 * {_STEP}) - va * tan(radians(glat)) / 6371229.0 AS div FROM fld), "
    f"ob AS (SELECT dv.*, system, u_tracks, {_AREA} AS area, dzghalf AS depth, {_AREA} * dzghalf AS volume, {q.RHO} AS rho, (cli + qs + qg) * {q.RHO} AS fwc, (cli + clw + qg + qr + qs) * {q.RHO} AS twc, wa_phy AS w, wa_phy * {q.RHO} AS cmf FROM dv JOIN msk USING (t, z, y, x)), "
    "tw AS (SELECT system, t, z, sum(twc * volume) AS tw FROM ob GROUP BY 1, 2, 3), "
    "sm AS (SELECT system, t, z, CASE WHEN count(tw) OVER w3 = 3 THEN avg(tw) OVER w3 END AS s FROM tw WINDOW w3 AS (PARTITION BY system, t ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), "
    f"dd AS (SELECT system, t, z, {q.derivative('z', 's', '(PARTITION BY system, t ORDER BY z)')} AS d FROM sm), "
    "po AS (SELECT system, t, z, -d AS d, lead(-d) OVER (PARTITION BY system, t ORDER BY z DESC) AS b FROM dd), "
    "fo AS (SELECT system, t, z, min(z) FILTER (d > 0 AND b <= 0) OVER (PARTITION BY system, t) AS top, d <= 0 AND b > 0 AS low FROM po), "
    "base AS (SELECT system, avg(abh) AS abh FROM (SELECT system, t, min(z) FILTER (low AND z >= top) AS abh FROM fo GROUP BY 1, 2) GROUP BY 1 HAVING avg(abh) IS NOT NULL), "
    "pn AS (SELECT system, t, z, d, lag(d) OVER (PARTITION BY system, t ORDER BY z) AS b FROM dd), "
    "fn AS (SELECT system, t, z, max(z) FILTER (d > 1e-10 AND b <= 1e-10) OVER (PARTITION BY system, t) AS top, d <= -1e-10 AND b > -1e-10 AS fall FROM pn), "
    "newer AS (SELECT system, avg(abh) AS abh FROM (SELECT system, t, max(z) FILTER (fall AND z <= top) AS abh FROM fn GROUP BY 1, 2) GROUP BY 1 HAVING avg(abh) IS NOT NULL), "
    "an AS (SELECT ob.* FROM ob JOIN base USING (system) WHERE z >= abh), nn AS (SELECT ob.* FROM ob JOIN newer USING (system) WHERE z >= abh), "
    f"{_near('met', RADIUS)}ep AS (SELECT system, z, avg(pfull) AS p FROM met JOIN fld USING (t, y, x) GROUP BY 1, 2), "
    "lv AS (SELECT system, CAST(arg_min(z, row(abs(p - 40000.0), z)) AS DOUBLE) AS abh FROM ep GROUP BY 1), al AS (SELECT ob.* FROM ob JOIN lv USING (system) WHERE z >= abh) "
)
_ALL = _FIELD + _TROPO + _OBJECTS


def _geometry_t(n: str) -> str:
    return f"{_rs('sum(volume) / 1e6', n + '_volume', 3)}, {_rs('max(zg)', n + '_cth')}, {_rs('min(zg)', n + '_cbh')}"


def _level(n: str) -> str:
    return (
        f"{_rs('sum(area) / 1e6', n + '_area', 3)}, {_rs('sum(fwc * volume) / 1e6', n + '_fw', 3)}, {_rs('sum(twc * volume) / 1e6', n + '_tw', 3)}, {_rs('avg(fwc) * 1e3', n + '_fwc')}, "
        f"{_rs('avg(twc) * 1e3', n + '_twc')}, {_rs('avg(rho)', n + '_rho_mu')}, {_rs('avg(div) * 1e4', n + '_div_mu')}"
    )


def _pixel(n: str) -> str:
    return f"{_rs('sum(depth)', n + '_depth')}, {_rs('sum(fwc * depth)', n + '_fwp')}, {_rs('sum(twc * depth)', n + '_twp')}"


_SCALE = {"volume": (1e-6, 3), "area": (1e-6, 3), "fw": (1e-6, 3), "tw": (1e-6, 3), "fwc": (1e3, 6), "twc": (1e3, 6), "div_mu": (1e4, 6), "div_max": (1e4, 6), "cmt": (1e-6, 3), "tpwv": (1e-6, 3), "S": (1e4, 6)}


def _shown(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Keys and results, scaled to where rounding tells results apart."""
    out = []
    for n in names:
        scale, digits = next((v for k, v in _SCALE.items() if n.endswith("_" + k)), (1.0, 6))
        value = F.col(n) * scale if scale >= 1 else F.col(n) / (1 / scale)
        out.append(_r(value if scale != 1 else F.col(n).cast("double"), digits).alias(n))
    return df.select(*keys, *out)


def _laid(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Mask and field; the field is written once, as all grains read it."""
    field = shuffled(Scratch(spark).save(grid_field(spark, sf).drop("col", "lev")))
    return grid_mask(spark, sf, field), field


def _centres(mask: DataFrame) -> DataFrame:
    at = bundles.first_updrafts(mask).select("system", "t", (F.col("x") * 0.5).alias("clon"), (F.col("y") * 0.5).alias("clat"))
    return shuffled(Scratch(mask.sparkSession).save(at))


def _everything(spark, sf) -> bundles.Tables:
    mask, field = _laid(spark, sf)
    return bundles.system_statistics(mask, field, _centres(mask), RADIUS, degrees=DEGREES)


def _environment(spark, sf) -> bundles.Tables:
    """The grains of _everything() that are of the environment alone."""
    mask, field = _laid(spark, sf)
    return bundles.environment(field, _centres(mask), RADIUS)


@query(_FIELD + _near("met", RADIUS) + f"e AS (SELECT 1) SELECT met.system, z, {_rs('avg(zg)', 'env_zg')}, {_rs('avg(ta)', 'env_T')}, {_rs('avg(pfull)', 'env_p')}, {_rs('avg(rh)', 'env_rh')}, {_rs('avg(s) * 1e4', 'env_S')} FROM met JOIN st USING (t, y, x) GROUP BY 1, 2")
def environment_profile(spark, sf):
    return _shown(_environment(spark, sf)["z"], ["system", "z"], ["env_zg", "env_T", "env_p", "env_rh", "env_S"])


@query(
    _ALL + f", es AS (SELECT met.system, sum(tpwv) AS tpwv FROM met JOIN st USING (t, y, x) GROUP BY 1), sc AS (SELECT t, y, x, {_shear(0, 2000)} AS low, {_shear(0, 6000)} AS deep FROM fld GROUP BY 1, 2, 3), "
    "ew AS (SELECT met.system, avg(low) AS low, avg(deep) AS deep FROM met JOIN sc USING (t, y, x) GROUP BY 1), keys AS (SELECT system FROM es UNION SELECT system FROM base) "
    f"SELECT keys.system, {_rs('es.tpwv / 1e6', 'env_tpwv', 3)}, {_rs('low', 'env_low_shear')}, {_rs('deep', 'env_deep_shear')}, {_rs('base.abh', 'ABH')}, {_rs('lv.abh', 'anvil_l400_ABH')} "
    "FROM keys LEFT JOIN es USING (system) LEFT JOIN ew USING (system) LEFT JOIN base USING (system) LEFT JOIN lv USING (system)"
)
def system_totals(spark, sf):
    return _shown(_everything(spark, sf)[""], ["system"], ["env_tpwv", "env_low_shear", "env_deep_shear", "ABH", "anvil_l400_ABH"])


@query(_FIELD + _TROPO + _near("met", RADIUS) + "e AS (SELECT 1) SELECT met.system, y, x, tropopause AS env_tropo FROM met JOIN tropo USING (t, y, x)")
def environment_tropopause(spark, sf):
    return _environment(spark, sf)["yx"]


@query(
    _ALL + f", c AS (SELECT system, t, {_geometry_t('cloud')} FROM ob GROUP BY 1, 2), a AS (SELECT system, t, {_geometry_t('anvil')} FROM an GROUP BY 1, 2), px AS (SELECT system, t, y, x, max(pr) AS pr, min(zg) AS cb FROM ob GROUP BY 1, 2, 3, 4), "
    f"p AS (SELECT system, t, {_rs('sum(pr)', 'cloud_pr')}, {_rs('max(pr)', 'cloud_pr_max')}, {_rs('avg(cb)', 'cloud_cbh_mu')} FROM px GROUP BY 1, 2) SELECT * FROM c JOIN p USING (system, t) LEFT JOIN a USING (system, t)"
)
def system_time(spark, sf):
    names = [f"{n}_{k}" for n in ("cloud", "anvil") for k in ("volume", "cth", "cbh")] + ["cloud_pr", "cloud_pr_max", "cloud_cbh_mu"]
    return _shown(_everything(spark, sf)["t"], ["system", "t"], names)


@query(
    _ALL + f", c AS (SELECT system, t, z, {_level('cloud')}, {_rs('avg(pfull)', 'cloud_pressure')} FROM ob GROUP BY 1, 2, 3), a AS (SELECT system, t, z, {_level('anvil')}, {_rs('max(div) * 1e4', 'anvil_div_max')} FROM an GROUP BY 1, 2, 3), "
    f"l AS (SELECT system, t, z, {_rs('sum(area) / 1e6', 'anvil_l400_area', 3)} FROM al GROUP BY 1, 2, 3) SELECT * FROM c LEFT JOIN a USING (system, t, z) LEFT JOIN l USING (system, t, z)"
)
def system_level(spark, sf):
    names = [f"{n}_{k}" for n in ("cloud", "anvil") for k in ("area", "fw", "tw", "fwc", "twc", "rho_mu", "div_mu")] + ["cloud_pressure", "anvil_div_max", "anvil_l400_area"]
    return _shown(_everything(spark, sf)["tz"], ["system", "t", "z"], names)


@query(
    _ALL + f", c AS (SELECT system, t, y, x, {_pixel('cloud')}, {_rs('min(ta)', 'cloud_tt')} FROM ob GROUP BY 1, 2, 3, 4), a AS (SELECT system, t, y, x, {_pixel('anvil')} FROM an GROUP BY 1, 2, 3, 4), "
    f"l AS (SELECT system, t, y, x, {_rs('sum(fwc * depth)', 'anvil_l400_fwp')}, {_rs('sum(twc * depth)', 'anvil_l400_twp')} FROM al GROUP BY 1, 2, 3, 4) SELECT * FROM c LEFT JOIN a USING (system, t, y, x) LEFT JOIN l USING (system, t, y, x)"
)
def system_pixel(spark, sf):
    names = [f"{n}_{k}" for n in ("cloud", "anvil") for k in ("depth", "fwp", "twp")] + ["cloud_tt", "anvil_l400_fwp", "anvil_l400_twp"]
    return _shown(_everything(spark, sf)["tyx"], ["system", "t", "y", "x"], names)


@query(
    _ALL + f", c AS (SELECT system, u_tracks AS core, t, {_geometry_t('core')} FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3), px AS (SELECT system, u_tracks AS core, t, y, x, max(pr) AS pr FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4, 5), "
    f"p AS (SELECT system, core, t, {_rs('sum(pr)', 'core_pr')}, {_rs('max(pr)', 'core_pr_max')} FROM px GROUP BY 1, 2, 3) SELECT * FROM c JOIN p USING (system, core, t)"
)
def system_core_time(spark, sf):
    return _shown(_everything(spark, sf)["core_t"], ["system", "core", "t"], ["core_volume", "core_cth", "core_cbh", "core_pr", "core_pr_max"])


@query(
    _ALL + f"SELECT system, u_tracks AS core, t, z, {_level('core')}, {_rs('avg(w)', 'core_mean_w')}, {_rs('max(w)', 'core_amax_w')}, {_rs('max(cmf)', 'core_cmf_max')}, {_rs('avg(cmf)', 'core_cmf_mu')}, {_rs('sum(cmf * area) / 1e6', 'core_cmt', 3)} FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4"
)
def system_core_level(spark, sf):
    names = [f"core_{k}" for k in ("area", "fw", "tw", "fwc", "twc", "rho_mu", "div_mu", "mean_w", "amax_w", "cmf_max", "cmf_mu", "cmt")]
    return _shown(_everything(spark, sf)["core_tz"], ["system", "core", "t", "z"], names)


@query(
    _ALL + f", c AS (SELECT system, u_tracks AS core, t, y, x, {_rs('max(w)', 'core_max_w')}, {_rs('arg_max(w, z)', 'core_top_w')}, {_rs('arg_max(cmf, z)', 'core_top_cmf')} FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4, 5), "
    f"b AS (SELECT system, u_tracks AS core, t, y, x, {_rs('max(w)', 'core_abh_w')}, {_rs('max(cmf)', 'core_abh_cmf')} FROM ob JOIN newer USING (system) WHERE u_tracks > 0 AND z = abh GROUP BY 1, 2, 3, 4, 5) SELECT * FROM c LEFT JOIN b USING (system, core, t, y, x)"
)
def cloudy_core_pixel(spark, sf):
    out = bundles.cloudy_statistics(*_laid(spark, sf))["core_tyx"]
    return _shown(out, ["system", "core", "t", "y", "x"], ["core_max_w", "core_top_w", "core_top_cmf", "core_abh_w", "core_abh_cmf"])


@query(_ALL + f", c AS (SELECT system, t, {_geometry_t('cloud')} FROM ob GROUP BY 1, 2), a AS (SELECT system, t, {_geometry_t('anvil')} FROM nn GROUP BY 1, 2) SELECT * FROM c LEFT JOIN a USING (system, t)")
def cloudy_time(spark, sf):
    out = bundles.cloudy_statistics(*_laid(spark, sf))["t"]
    return _shown(out, ["system", "t"], [f"{n}_{k}" for n in ("cloud", "anvil") for k in ("volume", "cth", "cbh")])


_LV = lambda c, p: f"arg_min({c}, row(abs(pfull - {p}), z))"


@query(
    _FIELD + _TROPO + _near("met", 2.4)
    + f"cl AS (SELECT t, y, x, {_LV('ua', 75000)} AS u, {_LV('va', 75000)} AS v, sum(tpwv) AS tpwv, sum(ta) AS sta, count(ta) AS nta, sum(rh) AS srh, count(rh) AS nrh, {_LV('ta', 75000)} AS t750, {_LV('ta', 90000)} AS t900, {_LV('rh', 75000)} AS r750, {_LV('rh', 90000)} AS r900, "
    f"{_shear(0, 2000)} AS low, {_shear(2000, 6000)} AS mid, {_shear(6000, 10000)} AS high FROM st GROUP BY 1, 2, 3), "
    f"i AS (SELECT met.system, {_rs('sum(sta) / sum(nta)', 'T_in1.2')[:-len(' AS T_in1.2')]} AS t_all, {_rs('sum(srh) / sum(nrh)', 'x')[:-len(' AS x')]} AS r_all, {_rs('sum(tpwv) / 1e6', 'x', 3)[:-len(' AS x')]} AS wv, {_rs('avg(t750)', 't750')}, {_rs('avg(t900)', 't900')}, {_rs('avg(r750)', 'r750')}, {_rs('avg(r900)', 'r900')}, {_rs('avg(low)', 'low')}, {_rs('avg(mid)', 'mid')} "
    "FROM met JOIN cl USING (t, y, x) WHERE distance < 1.2 AND distance > 0 AND (clon - glon) * u + (clat - glat) * v > 0 GROUP BY 1), "
    f"o AS (SELECT met.system, {_rs('avg(ta)', 'ta')}, {_rs('avg(rh)', 'rh')}, {_rs('avg(ua)', 'ua')}, {_rs('avg(va)', 'va')}, {_rs('avg(s) * 1e4', 's')} FROM met JOIN st USING (t, y, x) WHERE pfull BETWEEN 10000 AND 60000 GROUP BY 1), "
    f"h AS (SELECT met.system, {_rs('avg(high)', 'high')}, {_rs('avg(tropopause)', 'tropo')} FROM met JOIN cl USING (t, y, x) JOIN tropo USING (t, y, x) GROUP BY 1) "
    "SELECT system, t_all, r_all, wv, t750, t900, r750, r900, low, mid, ta, rh, ua, va, s, high, tropo FROM i FULL JOIN o USING (system) FULL JOIN h USING (system)"
)
def flow_environment(spark, sf):
    mask, field = _laid(spark, sf)
    e = bundles.flow_environment(field, _centres(mask), [1.2])
    inner = {"T_in1.2": "t_all", "rh_in1.2": "r_all", "T_750_in1.2": "t750", "T_900_in1.2": "t900", "rh_750_in1.2": "r750", "rh_900_in1.2": "r900", "low_shear_in1.2": "low", "mid_shear_in1.2": "mid"}
    outer = {f"{n}_around1.2": a for n, a in (("T", "ta"), ("rh", "rh"), ("ua", "ua"), ("va", "va"), ("high_shear", "high"), ("tropo", "tropo"))}
    return e.select("system", *(_r(F.col(f"`{n}`")).alias(a) for n, a in (inner | outer).items()), _r(F.col("`tpwv_in1.2`") / 1e6, 3).alias("wv"), _r(F.col("`S_around1.2`") * 1e4).alias("s"))


@query(
    _FIELD + "f0 AS (SELECT system, min(t) AS t FROM msk GROUP BY 1), pr_ AS (SELECT DISTINCT system, y, x FROM msk EXCEPT SELECT system, y, x FROM msk JOIN f0 USING (system, t)) "
    f"SELECT pr_.system, z, {_rs('avg(ua)', 'environment_ua')}, {_rs('avg(va)', 'environment_va')}, {_rs('avg(100 * rh)', 'environment_rh')} FROM pr_ JOIN f0 USING (system) JOIN th USING (t, y, x) GROUP BY 1, 2"
)
def footprint_environment(spark, sf):
    out = bundles.footprint_environment(*_laid(spark, sf))["z"]
    return _shown(out, ["system", "z"], ["environment_ua", "environment_va", "environment_rh"])


@query(
    _ALL + f", w AS (SELECT system, t, {_rs('max(a) / 1e6', 'cloud_max_area', 3)} FROM (SELECT system, t, z, sum(area) AS a FROM ob GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    f"c AS (SELECT system, t, {_rs('sum(volume) / 1e6', 'cloud_volume', 3)}, {_rs('max(zg)', 'c_th')}, {_rs('min(zg)', 'c_bh')}, {_rs('sum(pr)', 'cloud_pr')}, {_rs('sum(qs)', 'cloud_qs')}, {_rs('sum(qg)', 'cloud_qg')}, {_rs('sum(qr)', 'cloud_qr')}, {_rs('min(ta)', 'ctt')} FROM ob GROUP BY 1, 2) SELECT * FROM c JOIN w USING (system, t)"
)
def bulk_time(spark, sf):
    out = bundles.bulk_statistics(*_laid(spark, sf))["t"]
    return _shown(out, ["system", "t"], ["cloud_volume", "c_th", "c_bh", "cloud_pr", "cloud_qs", "cloud_qg", "cloud_qr", "ctt"]).join(out.select("system", "t", _r(F.col("cloud_max_area") / 1e6, 3).alias("cloud_max_area")), ["system", "t"])


@query(
    _ALL + f"SELECT system, u_tracks AS core, t, z, {_rs('avg(rho)', 'core_rho')}, {_rs('avg(pfull)', 'core_pres')}, {_rs('avg(w)', 'core_mean_w')}, {_rs('sum(area) / 1e6', 'core_area', 3)}, {_rs('sum(pr)', 'core_pr')}, {_rs('sum(qs)', 'core_qs')}, {_rs('sum(qg)', 'core_qg')}, {_rs('sum(qr)', 'core_qr')} FROM ob WHERE u_tracks > 0 GROUP BY 1, 2, 3, 4"
)
def bulk_core_level(spark, sf):
    out = bundles.bulk_statistics(*_laid(spark, sf))["core_tz"]
    return _shown(out, ["system", "core", "t", "z"], [f"core_{k}" for k in ("rho", "pres", "mean_w", "area", "pr", "qs", "qg", "qr")])


@query(
    _ALL + f", c AS (SELECT system, t, z, {_rs('avg(cmf) FILTER (w > 1)', 'cloud_cmf_mu')}, {_rs('max(cmf) FILTER (w > 1)', 'cloud_cmf_max')}, {_rs('sum(cmf * area) FILTER (w > 1) / 1e6', 'cloud_cmt', 3)} FROM ob GROUP BY 1, 2, 3), "
    f"a AS (SELECT system, t, z, {_rs('avg(cmf) FILTER (w > 1)', 'anvil_cmf_mu')}, {_rs('max(cmf) FILTER (w > 1)', 'anvil_cmf_max')}, {_rs('sum(cmf * area) FILTER (w > 1) / 1e6', 'anvil_cmt', 3)} FROM an GROUP BY 1, 2, 3) SELECT * FROM c LEFT JOIN a USING (system, t, z)"
)
def older_level(spark, sf):
    out = bundles.older_statistics(*_laid(spark, sf))["tz"]
    return _shown(out, ["system", "t", "z"], [f"{n}_{k}" for n in ("cloud", "anvil") for k in ("cmf_mu", "cmf_max", "cmt")])


@query(
    _ALL + f", c AS (SELECT system, t, y, x, {_rs('sum(cli * rho * depth)', 'cloud_iwp')}, {_rs('sum(qs * rho * depth)', 'cloud_swp')}, {_rs('sum(qg * rho * depth)', 'cloud_gwp')} FROM ob GROUP BY 1, 2, 3, 4), "
    f"a AS (SELECT system, t, y, x, {_rs('sum(cli * rho * depth)', 'anvil_iwp')} FROM an GROUP BY 1, 2, 3, 4) SELECT * FROM c LEFT JOIN a USING (system, t, y, x)"
)
def older_pixel(spark, sf):
    out = bundles.older_statistics(*_laid(spark, sf))["tyx"]
    return _shown(out, ["system", "t", "y", "x"], ["cloud_iwp", "cloud_swp", "cloud_gwp", "anvil_iwp"])


_FILTER = (
    "pc AS (SELECT system, t, z, sum(cli + clw) AS tw FROM msk JOIN fld USING (t, z, y, x) WHERE system IN (SELECT system FROM msk GROUP BY 1 HAVING count(DISTINCT z) >= 3) GROUP BY 1, 2, 3), "
    "ps AS (SELECT system, t, z, CASE WHEN count(tw) OVER w3 = 3 THEN avg(tw) OVER w3 END AS s FROM pc WINDOW w3 AS (PARTITION BY system, t ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), "
    f"pd AS (SELECT system, t, z, {q.derivative('z', 's', '(PARTITION BY system, t ORDER BY z)')} AS d FROM ps), pb AS (SELECT *, lag(d) OVER (PARTITION BY system, t ORDER BY z) AS b FROM pd), "
    "pf AS (SELECT system, t, z, max(z) FILTER (d > 1e-10 AND b <= 1e-10) OVER (PARTITION BY system, t) AS top, d <= -1e-10 AND b > -1e-10 AS fall FROM pb), "
    "pg AS (SELECT system, t, max(z) FILTER (fall AND z <= top) AS abh FROM pf GROUP BY 1, 2), pt AS (SELECT system, t, max(z) AS cth, coalesce(bool_or(u_tracks > 0), false) AS core FROM msk GROUP BY 1, 2), "
)


@query(_FIELD + _FILTER + "e AS (SELECT 1) SELECT pt.system, pt.t, abh, cth, core FROM pt LEFT JOIN pg USING (system, t)")
def define_filter(spark, sf):
    return bundles.define_filter(*_laid(spark, sf))


@query(
    _FIELD + _FILTER + "kp AS (SELECT system, avg(abh) AS m FROM pg WHERE abh IS NOT NULL GROUP BY 1 HAVING (max(t) - min(t)) * 0.25 > 0.5) "
    "SELECT t, z, y, x, system, u_tracks, CASE WHEN z >= m THEN system END AS anvil FROM msk JOIN kp USING (system)"
)
def apply_filter(spark, sf):
    """Systems defined, filtered by lifetime, and cut at their anvil base, from mask to mask."""
    mask, field = _laid(spark, sf)
    steps = bundles.define_filter(mask, field)
    timed = steps.withColumn("t", F.timestamp_seconds(F.col("t").cast("long") * 900))
    return bundles.apply_filter(mask, lineage.anvil_filter(timed, 0.5, core_first=False).where("keep"))
