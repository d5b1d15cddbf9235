"""Moist-air formulas as column expressions. SI units; mixing ratios in kg/kg."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RD, RV = 287.04, 461.4
EPS = RD / RV
P0, KAPPA = 100000.0, 0.2857
#: Condensates of the two model profiles.
PROFILES = {"10km": ("cli", "clw", "qg", "qr", "qs"), "5km": ("qall",)}


def profile(columns: list[str]) -> tuple[str, ...]:
    """The condensate columns of a table: those of the profile that it has."""
    return next((q for q in PROFILES.values() if set(q) <= set(columns)), ())


def total(quantities: list[Column]) -> Column:
    """Sum that skips nulls; null if all are null."""
    some = reduce(lambda a, b: a | b, (q.isNotNull() for q in quantities))
    return F.when(some, reduce(lambda a, b: a + b, (F.coalesce(q, F.lit(0.0)) for q in quantities)))


def dry_density(p: Column, t: Column) -> Column:
    return p / (RD * t)


def vapour_pressure(p: Column, q: Column) -> Column:
    return p * q / (EPS * (1 + q * (1 / EPS - 1)))


def moist_density(p: Column, t: Column, e: Column) -> Column:
    return e / (RV * t) + (p - e) / (RD * t)


def total_density(p: Column, t: Column, hus: Column, condensates: list[Column]) -> Column:
    return dry_density(p, t) / (1 - hus - total(condensates))


def legacy_density(p: Column, t: Column, hus: Column, condensates: list[Column]) -> Column:
    return p / (RD * t * (1 + (RV / RD - 1) * hus - total(condensates)))


def content(q: Column, rho: Column) -> Column:
    return q * rho


def mixed_phase(t: Column) -> Column:
    """Weight of liquid water: 0 below 250.16 K, 1 above 273.16 K."""
    return F.when(t <= 250.16, F.lit(0.0)).when(t >= 273.16, F.lit(1.0)).otherwise(F.pow((t - 250.16) / 23.0, F.lit(2.0)))


def saturation(t: Column, ice: bool = False) -> Column:
    b, c = (22.587, -0.7) if ice else (17.502, 32.19)
    return 611.2 * F.exp(b * (t - 273.16) / (t - c))


def mixed_saturation(t: Column) -> Column:
    a = mixed_phase(t)
    return a * saturation(t) + (1 - a) * saturation(t, ice=True)


def relative_humidity(p: Column, t: Column, q: Column) -> Column:
    return vapour_pressure(p, q) / mixed_saturation(t)


def mass_flux(w: Column, rho: Column, mass: Column | None = None) -> Column:
    flux = w * rho
    return flux if mass is None else mass * flux


def potential_temperature(p: Column, t: Column) -> Column:
    return t * F.pow(P0 / p, F.lit(KAPPA))


def frozen(qall: Column, t: Column) -> Column:
    """Condensate below freezing; null elsewhere."""
    return F.when(t < 273.15, qall)


def lcl_temperature(t: Column, rh: Column) -> Column:
    """Temperature at the lifting condensation level (Bolton 1980, eq. 22); rh as a fraction."""
    return 1 / (1 / (t - 55) - F.log(rh) / 2840) + 55


def lcl_pressure(p: Column, t: Column, rh: Column) -> Column:
    return p * F.pow(lcl_temperature(t, rh) / t, F.lit(1 / KAPPA))


def healpix(lon: Column, lat: Column, zoom: int) -> Column:
    """Nested pixel number at 2**zoom subdivisions (Górski et al. 2005); degrees."""
    n = 1 << zoom
    whole = lambda c: F.floor(c).cast("long")
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    z, tt = F.sin(F.radians(lat)), F.pmod(lon, F.lit(360.0)) / 90.0
    za = F.abs(z)
    jp, jm = whole(n * (0.5 + tt) - n * z * 0.75), whole(n * (0.5 + tt) + n * z * 0.75)
    fp, fm = F.shiftright(jp, zoom), F.shiftright(jm, zoom)
    low = F.lit(n - 1).cast("long")
    face_e = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp.bitwiseAND(F.lit(3))).otherwise(fm.bitwiseAND(F.lit(3)) + 8)
    ix_e, iy_e = jm.bitwiseAND(low), n - jp.bitwiseAND(low) - 1
    quarter = F.least(F.lit(3).cast("long"), whole(tt))
    tp, tmp = tt - quarter, n * F.sqrt(3 * (1 - za))
    a, b = F.least(low, whole(tp * tmp)), F.least(low, whole((1 - tp) * tmp))
    north = z >= 0
    pole = za > 2 / 3
    face = F.when(pole, F.when(north, quarter).otherwise(quarter + 8)).otherwise(face_e)
    ix = F.when(pole, F.when(north, n - b - 1).otherwise(a)).otherwise(ix_e)
    iy = F.when(pole, F.when(north, n - a - 1).otherwise(b)).otherwise(iy_e)
    mixed = reduce(lambda x, y: x + y, (bit(ix, k) * (1 << 2 * k) + bit(iy, k) * (2 << 2 * k) for k in range(zoom)), F.lit(0).cast("long"))
    return face * (n * n) + mixed
