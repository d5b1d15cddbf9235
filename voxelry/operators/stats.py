"""Per-object statistics: tables of outputs, evaluated at four grains with one aggregation each.

A bundle lists (name, grain, aggregate). Grains add keys to the object's: "tz" (time and level), "tyx"
(time and pixel), "t" (time) and "" (the object). Objects, cores and systems are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as ph

GRAINS = {"tz": ("t", "z"), "tyx": ("t", "y", "x"), "t": ("t",), "tzyx": ("t", "z", "y", "x"), "": ()}
Output = tuple[str, str, Column]
MISSING = -999.99
#: Rows along y that one block of divergence() spans.
BLOCK = 64


def derive(field: DataFrame, dxy: float = 11000.0) -> DataFrame:
    """The field table with area, depth, volume, fwc, twc, rho, cmf and pr (null where it has none) for either model profile."""
    names = field.columns
    quantities = ph.profile(names)
    rho = ph.total_density(F.col("pfull"), F.col("ta"), F.col("hus"), [F.col(q) for q in quantities])
    ice = [F.col(q) for q in ("cli", "qs", "qg") if q in names] or [ph.frozen(F.col("qall"), F.col("ta"))]
    w = F.col("wa_phy" if "wa_phy" in names else "wa")
    out = field.withColumn("area", F.lit(dxy * dxy)).withColumn("depth", F.col("dzghalf")).withColumn("volume", F.col("area") * F.col("depth"))
    out = out.withColumn("rho", rho).withColumn("fwc", ph.total(ice) * F.col("rho")).withColumn("twc", ph.total([F.col(q) for q in quantities]) * F.col("rho"))
    out = out.withColumn("w", w).withColumn("cmf", ph.mass_flux(F.col("w"), F.col("rho")))
    for missing in ("pr", "div"):
        if missing not in names:
            out = out.withColumn(missing, F.lit(None).cast("double"))
    return out


def geometry(n: str) -> list[Output]:
    return [
        (f"{n}_area", "tz", F.sum("area")), (f"{n}_depth", "tyx", F.sum("depth")), (f"{n}_volume", "t", F.sum("volume")), (f"{n}_cth", "t", F.max("zg")), (f"{n}_cbh", "t", F.min("zg")),
    ]


def water(n: str, paths: bool = True) -> list[Output]:
    out = [
        (f"{n}_fw", "tz", F.sum(F.col("fwc") * F.col("volume"))), (f"{n}_tw", "tz", F.sum(F.col("twc") * F.col("volume"))),
        (f"{n}_fwc", "tz", F.avg("fwc")), (f"{n}_twc", "tz", F.avg("twc")), (f"{n}_rho_mu", "tz", F.avg("rho")),
    ]
    return out + [(f"{n}_fwp", "tyx", F.sum(F.col("fwc") * F.col("depth"))), (f"{n}_twp", "tyx", F.sum(F.col("twc") * F.col("depth")))] * paths


def cloud(n: str = "cloud") -> list[Output]:
    return [*geometry(n), *water(n), (f"{n}_div_mu", "tz", F.avg("div")), (f"{n}_pressure", "tz", F.avg("pfull")), (f"{n}_tt", "tyx", F.min("ta")), (f"{n}_cb", "tyx", F.min("zg")), (f"{n}_prc", "tyx", F.max("pr"))]


def anvil(n: str = "anvil") -> list[Output]:
    return [*geometry(n), *water(n), (f"{n}_div_mu", "tz", F.avg("div")), (f"{n}_div_max", "tz", F.max("div"))]


def core(n: str = "core") -> list[Output]:
    return [
        *geometry(n), *water(n, paths=False), (f"{n}_max_w", "tyx", F.max("w")), (f"{n}_mean_w", "tz", F.avg("w")), (f"{n}_amax_w", "tz", F.max("w")), (f"{n}_div_mu", "tz", F.avg("div")),
        (f"{n}_cmf_max", "tz", F.max("cmf")), (f"{n}_cmf_mu", "tz", F.avg("cmf")), (f"{n}_cmt", "tz", F.sum(F.col("cmf") * F.col("area"))), (f"{n}_prc", "tyx", F.max("pr")),
        (f"{n}_top_w", "tyx", F.max_by("w", "z")), (f"{n}_top_cmf", "tyx", F.max_by("cmf", "z")),
    ]


def bulk(n: str) -> list[Output]:
    return [
        (f"{n}_rho", "tz", F.avg("rho")), (f"{n}_pres", "tz", F.avg("pfull")), (f"{n}_max_w", "tyx", F.max("w")), (f"{n}_mean_w", "tz", F.avg("w")), (f"{n}_area", "tz", F.sum("area")),
        (f"{n}_qs", "t", F.sum("qs")), (f"{n}_qg", "t", F.sum("qg")), (f"{n}_qr", "t", F.sum("qr")), (f"{n}_tt", "t", F.min("ta")),
    ]


def evaluate(objects: DataFrame, keys: tuple[str, ...], outputs: list[Output]) -> dict[str, DataFrame]:
    """A table of results for each grain that the outputs have."""
    return {g: objects.groupBy(*keys, *GRAINS[g]).agg(*(a.alias(n) for n, grain, a in outputs if grain == g)) for g in dict.fromkeys(g for _, g, _ in outputs)}


def second(results: dict[str, DataFrame], keys: tuple[str, ...], n: str) -> DataFrame:
    """Results by time that are taken of pixels' results: mean base height, total and greatest precipitation."""
    pixel = results["tyx"]
    wanted = [F.sum(f"{n}_prc").alias(f"{n}_pr"), F.max(f"{n}_prc").alias(f"{n}_pr_max")]
    if f"{n}_cb" in pixel.columns:
        wanted.append(F.avg(f"{n}_cb").alias(f"{n}_cbh_mu"))
    return pixel.groupBy(*keys, "t").agg(*wanted)


def at_level(objects: DataFrame, keys: tuple[str, ...], level: DataFrame, n: str = "core", by: tuple[str, ...] = ()) -> DataFrame:
    """keys, by, t, y, x with w and cmf at each object's level (keys, abh); rows only where the object has that level."""
    return objects.join(level, list(keys)).where("z = abh").groupBy(*keys, *by, "t", "y", "x").agg(F.max("w").alias(f"{n}_abh_w"), F.max("cmf").alias(f"{n}_abh_cmf"))


def export(df: DataFrame) -> DataFrame:
    """Nulls of doubles as the fill value, for files that want one."""
    return df.na.fill(MISSING, [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"])


def divergence(field: DataFrame, grid_degrees: float, lat: Column, radius: float = 6371229.0) -> DataFrame:
    """The field with `div`, du/dx + dv/dy on the sphere by central differences; null where a neighbour is missing.

    Rows are dealt to blocks, with copies of the first and last row of a block to the one next to it: one shuffle serves both directions, and no column of the grid is sorted whole.
    """
    home = F.floor(F.col("y") / BLOCK)
    copies = F.array_compact(F.array(*(F.when(there != home, there) for there in (F.floor((F.col("y") + d) / BLOCK) for d in (-1, 1)))))
    field = field.withColumn("_block", F.explode(F.concat(F.array(home), copies))).repartition("t", "z", "_block")
    row, column = Window.partitionBy("t", "z", "_block", "y").orderBy("x"), Window.partitionBy("t", "z", "_block", "x").orderBy("y")
    step = F.radians(F.lit(grid_degrees)) * radius

    def central(v: str, w, place: str) -> Column:
        near = (F.lead(place).over(w) - F.col(place) == 1) & (F.col(place) - F.lag(place).over(w) == 1)
        return F.when(near, F.lead(v).over(w) - F.lag(v).over(w))

    phi = F.radians(lat)
    out = field.withColumn("div", central("ua", row, "x") / (2 * step * F.cos(phi)) + central("va", column, "y") / (2 * step) - F.col("va") * F.tan(phi) / radius)
    return out.where(F.col("_block").eqNullSafe(home)).drop("_block")
