"""Operators along the levels of a column: one window sort a call, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def _w(keys: Keys, z: str | Column, descending: bool = False):
    order = (F.col(z) if isinstance(z, str) else z)
    return Window.partitionBy(*keys).orderBy(order.desc() if descending else order)


def rolling_mean(keys: Keys, z: str, value: Column) -> Column:
    """Centred mean of three levels; null at both ends and next to nulls."""
    w = _w(keys, z).rowsBetween(-1, 1)
    return F.when(F.count(value).over(w) == 3, F.avg(value).over(w))


def _three(x: Column, f: Column, w) -> tuple:
    return F.lag(x).over(w), x, F.lead(x).over(w), F.lag(f).over(w), f, F.lead(f).over(w)


def _interior(hs: Column, hd: Column, before: Column, here: Column, after: Column) -> Column:
    return (hs * hs * after + (hd * hd - hs * hs) * here - hd * hd * before) / (hs * hd * (hs + hd))


def derivative(keys: Keys, x: str, f: Column) -> Column:
    """df/dx on uneven levels: second order inside, one-sided at the ends; null for a single level."""
    w = _w(keys, x)
    x0, x1, x2, f0, f1, f2 = _three(F.col(x), f, w)
    return F.when(x0.isNull(), (f2 - f1) / (x2 - x1)).when(x2.isNull(), (f1 - f0) / (x1 - x0)).otherwise(_interior(x1 - x0, x2 - x1, f0, f1, f2))


def gradient(keys: Keys, order: str, x: Column, f: Column, descending: bool = False) -> Column:
    """df/dx of second order up to the ends, along ascending (or descending) `order`; null below three levels."""
    w = _w(keys, order, descending)
    lag, lead = (lambda c, n=1: F.lag(c, n).over(w)), (lambda c, n=1: F.lead(c, n).over(w))
    d1, d2 = lead(x) - x, lead(x, 2) - lead(x)
    first = -(2 * d1 + d2) / (d1 * (d1 + d2)) * f + (d1 + d2) / (d1 * d2) * lead(f) - d1 / (d2 * (d1 + d2)) * lead(f, 2)
    e1, e2 = lag(x) - lag(x, 2), x - lag(x)
    last = e2 / (e1 * (e1 + e2)) * lag(f, 2) - (e2 + e1) / (e1 * e2) * lag(f) + (2 * e2 + e1) / (e2 * (e1 + e2)) * f
    inside = _interior(x - lag(x), lead(x) - x, lag(f), f, lead(f))
    number, count = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(count < 3, F.lit(None).cast("double")).when(number == 1, first).when(number == count, last).otherwise(inside)


def layer_depth(keys: Keys, z: str, height: Column) -> Column:
    """Distance to the next level; null at the last."""
    return F.abs(F.lead(height).over(_w(keys, z)) - height)


def half_to_full(keys: Keys, z: str, half: Column) -> Column:
    """Mean of the half levels around a full one (this and the next); the last is extrapolated from the two before it."""
    w = _w(keys, z)
    after, before = F.lead(half).over(w), F.lag(half).over(w)
    return (half + F.coalesce(after, 2 * half - before)) / 2


def nearest(value: Column, coordinate: Column, to: float, tie: str) -> Column:
    """Aggregate: the value at the level nearest `to`; of equally near ones that with the smallest `tie`."""
    return F.min_by(value, F.struct(F.abs(coordinate - to).alias("d"), F.col(tie)))


def wind_shear(df: DataFrame, keys: Keys, low: float, high: float, u: str = "ua", v: str = "va", height: str = "zg", z: str = "lev") -> DataFrame:
    """keys and `shear`: the length of the wind's difference between the levels nearest two heights (m)."""
    at = lambda to: nearest(F.struct(F.col(u).alias("u"), F.col(v).alias("v")), F.col(height), to, z)
    two = df.groupBy(*keys).agg(at(low).alias("a"), at(high).alias("b"))
    return two.select(*keys, F.sqrt(F.pow(F.col("b.u") - F.col("a.u"), 2) + F.pow(F.col("b.v") - F.col("a.v"), 2)).alias("shear"))


def static_stability(keys: Keys, z: str, p: Column, t: Column, theta: Column) -> Column:
    """(T / theta) * dtheta/dp with the levels in order of altitude."""
    return t / theta * gradient(keys, z, p, theta)


def tropopause(df: DataFrame, keys: Keys, height: str = "zg", t: str = "ta") -> DataFrame:
    """keys and `tropopause` (km): the lowest start of a run of lapse rates of at most 2 K/km that holds for 2 km; null without one."""
    km = df.withColumn("_km", F.col(height) / 1000)
    lapse = km.withColumn("_lapse", -gradient(keys, "_km", F.col("_km"), F.col(t)))
    w = _w(keys, "_km")
    flagged = lapse.withColumn("_low", F.coalesce(F.col("_lapse") <= 2, F.lit(False)).cast("int"))
    flagged = flagged.withColumn("_starts", (F.col("_low") == 1) & (F.coalesce(F.lag("_low").over(w), F.lit(0)) == 0)).withColumn("_holds", F.min("_low").over(w.rangeBetween(0, 2)) == 1)
    return flagged.groupBy(*keys).agg(F.min(F.when(F.col("_starts") & F.col("_holds"), F.col("_km"))).alias("tropopause"))


def anvil_base(df: DataFrame, keys: Keys, z: str = "lev", value: str = "tw", pressure: bool = False) -> DataFrame:
    """keys and `abh`: below the last rise of the smoothed profile, the last level where it falls off; null without.

    On model levels the profile is smoothed over three and only changes of sign count; on pressure
    levels every level with the sign does.
    """
    smooth = F.col(value) if pressure else rolling_mean(keys, z, F.col(value))
    d = df.withColumn("_s", smooth).withColumn("_d", derivative(keys, z, F.col("_s")))
    before = F.lag("_d").over(_w(keys, z))
    rise, fall = F.col("_d") > 1e-10, F.col("_d") <= -1e-10
    if not pressure:
        rise, fall = rise & (before <= 1e-10), fall & (before > -1e-10)
    flagged = d.withColumn("_rise", rise).withColumn("_fall", fall)
    last = Window.partitionBy(*keys)
    top = F.max(F.when(F.col("_rise"), F.col(z))).over(last)
    return flagged.withColumn("_top", top).groupBy(*keys).agg(F.max(F.when(F.col("_fall") & (F.col(z) <= F.col("_top")), F.col(z))).alias("abh"))


def anvil_base_old(df: DataFrame, keys: Keys, z: str = "lev", value: str = "tw") -> DataFrame:
    """keys and `abh` by the older rule: from the top, the first level where the reversed slope ends, then the next where it begins."""
    d = df.withColumn("_s", rolling_mean(keys, z, F.col(value))).withColumn("_d", -derivative(keys, z, F.col("_s")))
    after = F.lead("_d").over(_w(keys, z, descending=True))
    flagged = d.withColumn("_max", (F.col("_d") > 0) & (after <= 0)).withColumn("_min", (F.col("_d") <= 0) & (after > 0))
    top = F.min(F.when(F.col("_max"), F.col(z))).over(Window.partitionBy(*keys))
    return flagged.withColumn("_top", top).groupBy(*keys).agg(F.min(F.when(F.col("_min") & (F.col(z) >= F.col("_top")), F.col(z))).alias("abh"))


def anvil_mask(df: DataFrame, base: DataFrame, keys: Keys, z: str = "lev", above: bool = True) -> DataFrame:
    """Rows of df at levels from the base on (above: z >= base; else z <= base); null bases have none."""
    joined = df.join(base.select(*keys, F.col("abh").alias("_abh")), list(keys))
    return joined.where(F.col(z) >= F.col("_abh") if above else F.col(z) <= F.col("_abh")).drop("_abh")


def shift_level(df: DataFrame, keys: Keys, level: Column, km: float, z: str = "lev", height: str = "zg") -> DataFrame:
    """keys and `shifted`: the fractional level that lies `km` above the height of `level`, linearly between levels."""
    w = _w(keys, z)
    d = df.withColumn("_level", level).withColumn("_z2", F.lead(z).over(w)).withColumn("_h2", F.lead(height).over(w))
    part = (F.col("_level") - F.col(z)) / (F.col("_z2") - F.col(z))
    at = F.when((F.col("_level") >= F.col(z)) & (F.col("_level") < F.col("_z2")), F.col(height) + part * (F.col("_h2") - F.col(height))).when(F.col("_z2").isNull() & (F.col("_level") == F.col(z)), F.col(height))
    d = d.withColumn("_to", F.max(at).over(Window.partitionBy(*keys)) + 1000 * km)
    back = (F.col("_to") - F.col(height)) / (F.col("_h2") - F.col(height))
    inside = (F.col("_to") >= F.least(height, "_h2")) & (F.col("_to") <= F.greatest(height, "_h2"))
    return d.groupBy(*keys).agg(F.min(F.when(inside, F.col(z) + back * (F.col("_z2") - F.col(z)))).alias("shifted"))


def descends(keys: Keys, z: str, height: Column) -> Column:
    """Aggregate-free orientation test: whether heights fall with ascending z."""
    w = Window.partitionBy(*keys)
    return F.max_by(height, z).over(w) < F.min_by(height, z).over(w)
