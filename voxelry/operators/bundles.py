"""Whole statistics of systems: environment, cloud, anvil and cores in one call, and bundles by name.

A bundle takes a mask (t, z, y, x, system, u_tracks), a field table and the storm centres, and gives a
table for each grain: a table's columns are all results with those keys. Nothing loops over systems.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions import profiles as pr
from ..model import DIMS
from ..storage import Scratch, shuffled
from . import stats
from .environment import within

COLUMN = ("t", "y", "x")
Tables = dict[str, DataFrame]


def merge(tables: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """One table of all results: outer joins on the keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def first_updrafts(mask: DataFrame, before: int = 1) -> DataFrame:
    """system, t, y, x: the first voxel of each system's first updraft, `before` steps earlier.

    First is the earliest start; of equal ones the one with most voxels, then the smallest number.
    """
    per = mask.where("u_tracks > 0").groupBy("system", "u_tracks").agg(F.min("t").alias("start"), F.count("*").alias("n"), F.min_by(F.struct("y", "x"), F.struct(*DIMS)).alias("at"))
    best = per.groupBy("system").agg(F.min_by(F.struct("start", "at"), F.struct("start", (-F.col("n")).alias("n"), "u_tracks")).alias("b"))
    return best.select("system", (F.col("b.start") - before).alias("t"), "b.at.y", "b.at.x")


# --- environments -----------------------------------------------------------------------------


def shears(field: DataFrame, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """t, y, x and a shear for each name: the length of the wind's difference between two heights (km), at their nearest levels."""
    heights = sorted({h for span in spans.values() for h in span})
    wind = F.struct(F.col("ua").alias("u"), F.col("va").alias("v"))
    at = field.groupBy(*COLUMN).agg(*(pr.nearest(wind, F.col("zg"), 1000.0 * h, "z").alias(f"_{i}") for i, h in enumerate(heights)))
    part = lambda a, b, c: F.pow(F.col(f"_{heights.index(b)}.{c}") - F.col(f"_{heights.index(a)}.{c}"), 2)
    return at.select(*COLUMN, *(F.sqrt(part(a, b, "u") + part(a, b, "v")).alias(n) for n, (a, b) in spans.items()))


def thermal(field: DataFrame, dxy: float = 11000.0) -> DataFrame:
    """The field with rh (that of `hur`, in percent, where there is one), tpwv (kg of vapour in the cell) and S."""
    p, t, q = F.col("pfull"), F.col("ta"), F.col("hus")
    rho = ph.total_density(p, t, q, [F.col(c) for c in ph.profile(field.columns)])
    rh = F.col("hur") / 100 if "hur" in field.columns else ph.relative_humidity(p, t, q)
    theta = field.withColumn("_theta", ph.potential_temperature(p, t))
    out = theta.withColumn("S", pr.static_stability(COLUMN, "z", p, t, F.col("_theta"))).drop("_theta")
    return out.withColumn("rh", rh).withColumn("tpwv", ph.content(q, rho) * F.lit(dxy * dxy) * F.col("dzghalf"))


def around(field: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """system and the columns (t, y, x, lon, lat) nearer than `radius` degrees to its centre (system, t, clon, clat), at its time."""
    return within(_steps(field.select(*COLUMN, "lon", "lat"), centres).distinct(), centres, radius, on=("t",))


def _steps(field: DataFrame, some: DataFrame) -> DataFrame:
    """Only the field's steps that occur in `some`: a row a step is broadcast, so that no others move."""
    return field.join(F.broadcast(some.select("t").distinct()), "t", "left_semi")


def _met(field: DataFrame, pairs: DataFrame) -> DataFrame:
    """Only the field's columns that some pair names: what comes after reads no others."""
    return _steps(field, pairs).join(pairs.select(*COLUMN).distinct(), list(COLUMN), "left_semi")


def environment(field: DataFrame, centres: DataFrame, radius: float, dxy: float = 11000.0, n: str = "env") -> Tables:
    """Of the field within the radius at the centre's time: profiles by level, totals and shears of the system, tropopause by pixel."""
    scratch = Scratch(field.sparkSession)
    pairs = shuffled(scratch.save(around(field, centres, radius).select("system", *COLUMN)))
    near = shuffled(scratch.save(_met(field, pairs)))  # each is read several times
    rows = thermal(near, dxy).join(pairs, list(COLUMN))
    mean = lambda c, name: F.avg(c).alias(f"{n}_{name}")
    level = rows.groupBy("system", "z").agg(mean("zg", "zg"), mean("ta", "T"), mean("pfull", "p"), mean("rh", "rh"), mean("S", "S"))
    total = rows.groupBy("system").agg(F.sum("tpwv").alias(f"{n}_tpwv"))
    wind = shears(near, {"low": (0, 2), "deep": (0, 6)}).join(pairs, list(COLUMN)).groupBy("system").agg(mean("low", "low_shear"), mean("deep", "deep_shear"))
    tropo = pr.tropopause(near, COLUMN).join(pairs, list(COLUMN)).select("system", "y", "x", F.col("tropopause").alias(f"{n}_tropo"))
    return {"z": level, "": total.join(wind, "system"), "yx": tropo}


def flow_environment(field: DataFrame, centres: DataFrame, radii: list[float], dxy: float = 11000.0, inflow: float = 75000.0, convection: bool = False) -> DataFrame:
    """One row a system: means upwind of it (`_in<radius>`) and around it (`_around<radius>`, twice the radius), for each radius.

    Upwind are columns within the radius whose wind at the level nearest `inflow` blows towards the
    centre: temperature and humidity (all levels, and at 750 and 900 hPa), the sum of vapour, shears
    below 6 km and, with convection, CAPE, CIN, LFC and LCL. Around it: levels from 600 to 100 hPa of
    temperature, humidity, wind and stability, the shear above 6 km and the tropopause.
    """
    out, scratch = [], Scratch(field.sparkSession)
    for radius in radii:
        name = f"{radius:g}"
        wide = shuffled(scratch.save(around(field, centres, 2 * radius)))
        near = shuffled(scratch.save(_met(field, wide)))  # each is read several times
        deep = thermal(near, dxy)
        level = lambda c, p: pr.nearest(F.col(c), F.col("pfull"), p, "z")
        column = near.groupBy(*COLUMN).agg(level("ua", inflow).alias("_u"), level("va", inflow).alias("_v"))
        towards = (F.col("clon") - F.col("lon")) * F.col("_u") + (F.col("clat") - F.col("lat")) * F.col("_v")
        upwind = wide.where(F.col("distance") < radius).join(column, list(COLUMN)).where((F.col("distance") > 0) & (towards > 0)).select("system", *COLUMN)
        pairs = wide.select("system", *COLUMN)
        flat = deep.groupBy(*COLUMN).agg(F.sum("tpwv").alias("tpwv"), F.sum("ta").alias("_ta"), F.count("ta").alias("_nta"), F.sum("rh").alias("_rh"), F.count("rh").alias("_nrh"), *(level(c, p).alias(f"{n}_{p // 100:.0f}") for n, c in (("T", "ta"), ("rh", "rh")) for p in (75000.0, 90000.0)))
        flat = flat.join(shears(near, {"low_shear": (0, 2), "mid_shear": (2, 6)}), list(COLUMN))
        names = ["T_750", "T_900", "rh_750", "rh_900", "low_shear", "mid_shear"]
        if convection:
            flat = flat.join(_convection(deep), list(COLUMN), "left")
            names += ["cape", "cin", "lfc", "lcl"]
        inner = flat.join(upwind, list(COLUMN)).groupBy("system").agg(
            (F.sum("_ta") / F.sum("_nta")).alias(f"T_in{name}"), (F.sum("_rh") / F.sum("_nrh")).alias(f"rh_in{name}"), F.sum("tpwv").alias(f"tpwv_in{name}"), *(F.avg(c).alias(f"{c}_in{name}") for c in names)
        )
        layer = deep.where(F.col("pfull").between(10000, 60000)).join(pairs, list(COLUMN)).groupBy("system").agg(*(F.avg(c).alias(f"{n}_around{name}") for n, c in (("T", "ta"), ("rh", "rh"), ("ua", "ua"), ("va", "va"), ("S", "S"))))
        top = shears(near, {"high_shear": (6, 10)}).join(pr.tropopause(near, COLUMN), list(COLUMN)).join(pairs, list(COLUMN)).groupBy("system").agg(F.avg("high_shear").alias(f"high_shear_around{name}"), F.avg("tropopause").alias(f"tropo_around{name}"))
        out += [inner, layer, top]
    return merge(out, ("system",))


def _convection(deep: DataFrame) -> DataFrame:
    from ..functions.convection import cape_cin

    keyed = deep.withColumn("_column", F.struct(*COLUMN))
    number = keyed.select("_column").distinct().withColumn("_id", F.xxhash64("_column"))
    found = cape_cin(keyed.withColumn("_id", F.xxhash64("_column")), "_id")
    return number.join(found, "_id").select("_column.*", "cape", "cin", "lfc", "lcl")


def footprint_environment(mask: DataFrame, field: DataFrame, n: str = "environment") -> Tables:
    """Of the pixels that a system reaches later but not at its first time, at that time: wind and humidity by level, and ts of the system."""
    first = mask.groupBy("system").agg(F.min("t").alias("t"))
    pixels = mask.select("system", "y", "x").distinct()
    initial = mask.join(first, ["system", "t"], "left_semi").select("system", "y", "x").distinct()
    pairs = pixels.join(initial, ["system", "y", "x"], "left_anti").join(first, "system")
    rows = field.join(pairs, list(COLUMN)).withColumn("rh", 100 * ph.relative_humidity(F.col("pfull"), F.col("ta"), F.col("hus")))
    out = {"z": rows.groupBy("system", "z").agg(*(F.avg(c).alias(f"{n}_{c}") for c in ("ua", "va", "rh")))}
    if "ts" in field.columns:
        out[""] = rows.select("system", *COLUMN, "ts").distinct().groupBy("system").agg(F.avg("ts").alias(f"{n}_ts"))
    return out


# --- objects ----------------------------------------------------------------------------------


def anvil_levels(water: DataFrame, n: str = "cloud", older: bool = True) -> DataFrame:
    """system and abh: the mean over time of the anvil's base level of each time's water profile."""
    rule = pr.anvil_base_old if older else pr.anvil_base
    per_time = rule(water.select("system", "t", F.col("z").alias("lev"), F.col(f"{n}_tw").alias("tw")), ("system", "t"))
    return per_time.groupBy("system").agg(F.avg("abh").alias("abh")).where("abh IS NOT NULL")


def cloud_top_level(mask: DataFrame) -> DataFrame:
    """system, t, top and core of every step in which a system is: its highest level, and whether it has an updraft then."""
    return mask.groupBy("system", "t").agg(F.max("z").alias("top"), F.coalesce(F.max(F.col("u_tracks") > 0), F.lit(False)).alias("core"))


def define_filter(mask: DataFrame, field: DataFrame, min_levels: int = 3) -> DataFrame:
    """system, t, abh, cth and core of every step: the anvil base of the cloud's condensate profile, the top level, and whether there is a core.

    Systems with fewer than min_levels levels have no base.
    """
    rows = mask.join(field.select(*DIMS, (F.col("cli") + F.col("clw")).alias("_cl")), list(DIMS))
    profile = rows.groupBy("system", "t", "z").agg(F.sum("_cl").alias("tw")).withColumnRenamed("z", "lev")
    tall = mask.groupBy("system").agg(F.countDistinct("z").alias("n")).where(F.col("n") >= min_levels).select("system")
    base = pr.anvil_base(profile.join(tall, "system", "left_semi"), ("system", "t"))
    top = cloud_top_level(mask)
    return top.join(base, ["system", "t"], "left").select("system", "t", "abh", F.col("top").alias("cth"), "core")


def apply_filter(mask: DataFrame, kept: DataFrame) -> DataFrame:
    """The mask of the systems in `kept` (system, abh), with `anvil`: the system's number at and above its base, else null."""
    return mask.join(kept.select("system", F.col("abh").alias("_abh")), "system").withColumn("anvil", F.when(F.col("z") >= F.col("_abh"), F.col("system"))).drop("_abh")


def sensitivity(n: str) -> list[stats.Output]:
    return [(f"{n}_area", "tz", F.sum("area")), (f"{n}_fwp", "tyx", F.sum(F.col("fwc") * F.col("depth"))), (f"{n}_twp", "tyx", F.sum(F.col("twc") * F.col("depth")))]


def condensate_paths(n: str) -> list[stats.Output]:
    """Paths of single condensates by pixel: cloud ice, snow and graupel."""
    return [(f"{n}_{out}", "tyx", F.sum(F.col(q) * F.col("rho") * F.col("depth"))) for out, q in (("iwp", "cli"), ("swp", "qs"), ("gwp", "qg"))]


def dynamic(n: str, least: float = 1.0) -> list[stats.Output]:
    """Mass fluxes of voxels that rise faster than `least` m/s."""
    rising = lambda c: F.when(F.col("w") > least, c)
    return [(f"{n}_cmf_mu", "tz", F.avg(rising(F.col("cmf")))), (f"{n}_cmf_max", "tz", F.max(rising(F.col("cmf")))), (f"{n}_cmt", "tz", F.sum(rising(F.col("cmf") * F.col("area"))))]


def _grains(parts: list[tuple[tuple[str, ...], Tables]], prefix: str = "") -> Tables:
    """Tables of several bundles with the same object keys, merged by grain."""
    out: dict[str, list[DataFrame]] = {}
    keys: dict[str, tuple[str, ...]] = {}
    for own, tables in parts:
        for grain, table in tables.items():
            out.setdefault(prefix + grain, []).append(table)
            keys[prefix + grain] = (*own, *(c for c in (stats.GRAINS[grain] if grain in stats.GRAINS else tuple(grain))))
    return {g: merge(t, keys[g]) for g, t in out.items()}


def _objects(mask: DataFrame, field: DataFrame, dxy: float, degrees: float | None) -> DataFrame:
    """The voxels of the mask with what bundles take of the field, written once for all grains; derived quantities come after reading."""
    if degrees is not None and "div" not in field.columns and "lat" in field.columns and {"ua", "va"} <= set(field.columns):
        field = stats.divergence(field, degrees, F.col("lat"))
    read = {*DIMS, "zg", "pfull", "ta", "hus", "dzghalf", "wa", "wa_phy", "pr", "div", *(q for profile in ph.PROFILES.values() for q in profile)}
    rows = field.select(*(c for c in field.columns if c in read)).join(mask.select(*DIMS, "system", "u_tracks", *(c for c in ("anvil",) if c in mask.columns)), list(DIMS))
    return stats.derive(shuffled(Scratch(field.sparkSession).save(rows)), dxy)


def _with_second(tables: Tables, keys: tuple[str, ...], n: str) -> Tables:
    return tables | {"t": merge([tables["t"], stats.second(tables, keys, n)], (*keys, "t"))}


def system_statistics(mask: DataFrame, field: DataFrame, centres: DataFrame, radius: float, dxy: float = 11000.0, degrees: float | None = 0.1, pressure: float = 40000.0) -> Tables:
    """Environment, cloud, anvil (by its base level, and by the level nearest `pressure` as a check) and cores of every system.

    Grains: "" (system), "z", "yx" (environment), "t", "tz", "tyx" (cloud and anvil), "core_t",
    "core_tz", "core_tyx". A result that an object has no voxels for is null; stats.export() fills.
    """
    key = ("system",)
    env = environment(field, centres, radius, dxy)
    objects = _objects(mask, field, dxy, degrees)
    cloud = _with_second(stats.evaluate(objects, key, stats.cloud()), key, "cloud")
    base = anvil_levels(cloud["tz"])
    anvil = stats.evaluate(pr.anvil_mask(objects, base, key, "z"), key, stats.anvil())
    check = env["z"].groupBy("system").agg(F.min_by("z", F.struct(F.abs(F.col("env_p") - pressure).alias("d"), "z")).cast("double").alias("abh"))
    name = f"anvil_l{pressure / 100:.0f}"
    other = stats.evaluate(pr.anvil_mask(objects, check, key, "z"), key, sensitivity(name))
    cores = objects.where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    core = _with_second(stats.evaluate(cores, (*key, "core"), stats.core()), (*key, "core"), "core")
    levels = merge([base.withColumnRenamed("abh", "ABH"), check.withColumnRenamed("abh", f"{name}_ABH")], key)
    return _grains([(key, env), (key, {"": levels}), (key, cloud), (key, anvil), (key, other)]) | _grains([((*key, "core"), core)], "core_")


def cloudy_statistics(mask: DataFrame, field: DataFrame, dxy: float = 11000.0) -> Tables:
    """Cloud, anvil and cores, the anvil by the newer base rule, with the cores' speed and flux at the base level."""
    key = ("system",)
    objects = _objects(mask, field, dxy, None)
    cloud = stats.evaluate(objects, key, [*stats.geometry("cloud"), *stats.water("cloud"), ("cloud_pressure", "tz", F.avg("pfull")), ("cloud_prc", "tyx", F.max("pr"))])
    cloud = _with_second(cloud, key, "cloud")
    base = anvil_levels(cloud["tz"], older=False)
    anvil = stats.evaluate(pr.anvil_mask(objects, base, key, "z"), key, [*stats.geometry("anvil"), *stats.water("anvil")])
    cores = objects.where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    core = stats.evaluate(cores, (*key, "core"), stats.core())
    at_base = stats.at_level(cores, key, base, by=("core",))
    core = _with_second(core, (*key, "core"), "core")
    core["tyx"] = merge([core["tyx"], at_base], (*key, "core", "t", "y", "x"))
    return _grains([(key, cloud), (key, {"": base.withColumnRenamed("abh", "ABH")}), (key, anvil)]) | _grains([((*key, "core"), core)], "core_")


def flow_statistics(mask: DataFrame, field: DataFrame, centres: DataFrame, radii: list[float], dxy: float = 11000.0, derive: tuple[str, ...] = ("cloud", "environmental"), convection: bool = True) -> Tables:
    """cloudy_statistics() and flow_environment(), or one of them."""
    out = cloudy_statistics(mask, field, dxy) if "cloud" in derive else {}
    if "environmental" in derive:
        env = flow_environment(field, centres, radii, dxy, convection=convection)
        out[""] = merge([out[""], env], ("system",)) if "" in out else env
    return out


def bulk_statistics(mask: DataFrame, field: DataFrame, dxy: float = 11000.0) -> Tables:
    """The bulk outputs of cloud, anvil (the mask's own, if it has one) and cores."""
    objects = _objects(mask, field, dxy, None)

    def shape(n: str, short: str) -> list[stats.Output]:
        return [(f"{n}_depth", "tyx", F.sum("depth")), (f"{n}_volume", "t", F.sum("volume")), (f"{short}th", "t", F.max("zg")), (f"{short}bh", "t", F.min("zg"))]

    def flow(n: str) -> list[stats.Output]:
        return [(f"{n}_rho", "tz", F.avg("rho")), (f"{n}_pres", "tz", F.avg("pfull")), (f"{n}_mean_w", "tz", F.avg("w")), (f"{n}_area", "tz", F.sum("area")), (f"{n}_max_w", "tyx", F.max("w"))]

    def rain(n: str, grain: str) -> list[stats.Output]:
        return [(f"{n}_{q}", grain, F.sum(q)) for q in ("pr", "qs", "qg", "qr")]

    def widest(rows: DataFrame, keys: tuple[str, ...], n: str) -> DataFrame:
        return rows.groupBy(*keys, "t", "z").agg(F.sum("area").alias("_a")).groupBy(*keys, "t").agg(F.max("_a").alias(f"{n}_max_area"))

    key = ("system",)
    cloud = stats.evaluate(objects, key, [*shape("cloud", "c_"), *rain("cloud", "t"), ("ctt", "t", F.min("ta"))])
    cloud["t"] = merge([cloud["t"], widest(objects, key, "cloud")], ("system", "t"))
    parts = [(key, cloud)]
    if "anvil" in mask.columns:
        inside = objects.where("anvil > 0")
        anvil = stats.evaluate(inside, key, [*shape("anvil", "a_"), *flow("anvil"), ("att", "tyx", F.min("ta"))])
        anvil["t"] = merge([anvil["t"], widest(inside, key, "anvil")], ("system", "t"))
        parts.append((key, anvil))
    cores = objects.where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    core = stats.evaluate(cores, (*key, "core"), [*shape("core", "c_"), *flow("core"), *rain("core", "tz")])
    return _grains(parts) | _grains([((*key, "core"), core)], "core_")


def older_statistics(mask: DataFrame, field: DataFrame, dxy: float = 11000.0, least: float = 1.0) -> Tables:
    """The older outputs of cloud, anvil and cores: geometry, paths of single condensates, and fluxes of rising voxels."""
    key = ("system",)
    objects = _objects(mask, field, dxy, None)
    cloud = stats.evaluate(objects, key, [*stats.geometry("cloud"), *stats.water("cloud"), *condensate_paths("cloud"), *dynamic("cloud", least)])
    base = anvil_levels(cloud["tz"])
    anvil = stats.evaluate(pr.anvil_mask(objects, base, key, "z"), key, [*stats.geometry("anvil"), *stats.water("anvil"), *condensate_paths("anvil"), *dynamic("anvil", least)])
    cores = objects.where("u_tracks > 0").withColumnRenamed("u_tracks", "core")
    core = stats.evaluate(cores, (*key, "core"), [*stats.geometry("core"), *stats.water("core"), *condensate_paths("core"), *dynamic("core", least)])
    env = footprint_environment(mask, field)
    return _grains([(key, cloud), (key, anvil), (key, env)]) | _grains([((*key, "core"), core)], "core_")


# --- by name ----------------------------------------------------------------------------------

#: Bundles that a configuration can name, and which of mask, field and centres they take.
BUNDLES: dict[str, tuple[Callable[..., Tables], bool]] = {
    "system": (system_statistics, True), "flow": (flow_statistics, True), "cloudy": (cloudy_statistics, False), "bulk": (bulk_statistics, False), "older": (older_statistics, False),
}


def largest_slice(mask: DataFrame) -> DataFrame:
    """system and size: the most pixels that it has in one level of one step."""
    return mask.groupBy("system", "t", "z").agg(F.count("*").alias("n")).groupBy("system").agg(F.max("n").alias("size"))


def compute(results: dict[str, dict], mask: DataFrame, field: DataFrame, centres: DataFrame | None = None, max_size: int | None = None) -> dict[str, Tables]:
    """The bundles of a configuration, name: {function, parameters}. Systems with more than max_size pixels in a slice are left out."""
    if unknown := sorted({r["function"] for r in results.values()} - set(BUNDLES)):
        raise ValueError(f"unknown statistics {unknown}; there are {sorted(BUNDLES)}")
    if max_size is not None:
        mask = mask.join(largest_slice(mask).where(F.col("size") <= max_size).select("system"), "system", "left_semi")
    out = {}
    for name, how in results.items():
        function, placed = BUNDLES[how["function"]]
        parameters = how.get("parameters") or {}
        out[name] = function(mask, field, centres, **parameters) if placed else function(mask, field, **parameters)
    return out
