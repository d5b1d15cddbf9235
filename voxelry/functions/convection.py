"""CAPE, CIN, LFC and LCL of columns: a pseudo-adiabatic parcel from the lowest level.

Formulas: Bolton (1980) for the lifting condensation level and saturation, the pseudo-adiabatic
lapse rate in pressure, integrated by midpoint steps. Columns of a batch are lifted side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship, tidied
from ..storage import partitions
from .physics import EPS, KAPPA, RD, RV

LV, CP = 2.501e6, 1004.7


def _saturation(t: np.ndarray) -> np.ndarray:
    return 611.2 * np.exp(17.67 * (t - 273.15) / (t - 29.65))


def _slope(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """dT/dp of a saturated parcel."""
    e = np.minimum(_saturation(t), 0.9 * p)
    r = EPS * e / (p - e)
    return (RD * t + LV * r) / (CP + LV * LV * r * EPS / (RD * t * t)) / p


def parcel(p: np.ndarray, t: np.ndarray, rh: np.ndarray, steps: int = 12) -> np.ndarray:
    """Parcel temperatures (columns, levels), lifted from level 0; pressures fall along a row, NaN beyond its end."""
    rh0 = np.clip(rh[:, 0], 1e-4, 1.0)
    t_lcl = 1 / (1 / (t[:, 0] - 55) - np.log(rh0) / 2840) + 55
    p_lcl = p[:, 0] * (t_lcl / t[:, 0]) ** (1 / KAPPA)
    out = np.full_like(t, np.nan)
    out[:, 0] = t[:, 0]
    wet, at = t_lcl.copy(), p_lcl.copy()
    for k in range(1, t.shape[1]):
        dry = t[:, 0] * (p[:, k] / p[:, 0]) ** KAPPA
        to = np.minimum(p[:, k], p_lcl)
        h = (to - at) / steps
        for _ in range(steps):
            mid = wet + _slope(at, wet) * h / 2
            wet = wet + _slope(at + h / 2, mid) * h
            at = at + h
        at = np.where(np.isnan(to), at, to)
        out[:, k] = np.where(p[:, k] >= p_lcl, dry, wet)
    return out


def instability(p: np.ndarray, t: np.ndarray, rh: np.ndarray) -> tuple[np.ndarray, ...]:
    """(CAPE, CIN, LFC pressure, LCL pressure) of each column by the trapezoidal rule in ln p; NaN below five levels."""
    lifted = parcel(p, t, rh)
    d = lifted - t
    n = np.isfinite(d).sum(axis=1)
    dx = np.log(p[:, :-1] / p[:, 1:])
    a, b = d[:, :-1], d[:, 1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        cross = np.where((a * b) < 0, a / (a - b), 0.0)
        plus = np.where((a >= 0) & (b >= 0), (a + b) / 2, np.where(a > 0, a * cross / 2, np.where(b > 0, b * (1 - cross) / 2, 0.0))) * dx
        minus = np.where((a <= 0) & (b <= 0), (a + b) / 2, np.where(a < 0, a * cross / 2, np.where(b < 0, b * (1 - cross) / 2, 0.0))) * dx
    rises = (a <= 0) & (b > 0)
    first = np.where(rises.any(axis=1), rises.argmax(axis=1), -1)
    rows = np.arange(len(p))
    x = np.log(p[rows, np.maximum(first, 0)]) - np.where(first >= 0, cross[rows, np.maximum(first, 0)] * dx[rows, np.maximum(first, 0)], 0)
    lfc = np.where(first >= 0, np.minimum(np.exp(x), p[:, 0]), np.nan)
    below = np.arange(dx.shape[1])[None] <= first[:, None]
    rh0 = np.clip(rh[:, 0], 1e-4, 1.0)
    lcl = p[:, 0] * ((1 / (1 / (t[:, 0] - 55) - np.log(rh0) / 2840) + 55) / t[:, 0]) ** (1 / KAPPA)
    out = RD * np.nansum(plus, axis=1), RD * np.nansum(np.where(below, minus, 0), axis=1), lfc, lcl
    return tuple(np.where(n < 5, np.nan, v) for v in out)


def cape_cin(df: DataFrame, key: str = "col", p: str = "pfull", t: str = "ta", rh: str = "rh") -> DataFrame:
    """key, cape, cin, lfc and lcl of each column; null below five finite levels. Columns are dealt into batches by key."""
    spark = df.sparkSession
    ship(spark)
    dealt = df.select(F.col(key).alias("key"), F.col(p).alias("p"), F.col(t).alias("t"), F.col(rh).alias("rh"), F.pmod(F.xxhash64(key), F.lit(4 * partitions(spark))).alias("part"))

    def run(part, table):
        key_, p_, t_, rh_ = (table[c].to_numpy() for c in ("key", "p", "t", "rh"))
        good = np.isfinite(p_) & np.isfinite(t_) & np.isfinite(rh_)
        unique = np.unique(key_)
        order = np.lexsort((-p_[good], key_[good]))
        k, p_, t_, rh_ = (a[good][order] for a in (key_, p_, t_, rh_))
        row = np.searchsorted(unique, k)
        place = np.arange(len(k)) - np.searchsorted(row, row)
        shape = (len(unique), max(2, int(place.max()) + 1 if len(place) else 2))
        grids = [np.full(shape, np.nan) for _ in range(3)]
        for g, v in zip(grids, (p_, t_, rh_), strict=True):
            g[row, place] = v
        out = instability(*grids)
        return pa.table([pa.array(unique), *(pa.array(v, from_pandas=True) for v in out)], names=["key", "cape", "cin", "lfc", "lcl"])

    out = dealt.groupBy("part").applyInArrow(tidied(run), "key long, cape double, cin double, lfc double, lcl double")
    return out.withColumnRenamed("key", key)


__all__ = ["RV", "cape_cin", "instability", "parcel"]
