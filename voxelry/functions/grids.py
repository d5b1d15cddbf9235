"""Regular grids with a fixed origin, regions, and block means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cover import cover, within
from .physics import healpix

ORIGIN = (-180.0, -90.0)
#: Regions by name, fixed values: lonmin, lonmax, latmin, latmax.
REGIONS = {
    "amazon": (-83, -43, -15, 15),
    "congo": (1, 41, -15, 15),
    "tropics": (-180, 180, -15, 15),
    "global": (-180, 180, -90, 90),
    "anatomy_example": (-78, -70, 9, 15),
    "anatomy_example_large": (-80, -68, 7, 17),
    "tcr_amazon": (280, 325, -15, 10),
    "tcr_congo": (0, 35, -12, 24),
    "tcr_warm pool": (90, 160, -15, 15),
    "atlantic": (-50, 0, -10, 15),
}


def region_box(region: str | tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box of a named region, or the box itself; KeyError for an unknown name."""
    return REGIONS[region] if isinstance(region, str) else region


def axis(low: float, high: float, step: float, origin: float) -> tuple[int, int]:
    """First and last + 1 index k of the grid points origin + k * step that cover low..high."""
    return math.floor(round((low - origin) / step, 6)), math.ceil(round((high - origin) / step, 6))


def grid_points(spark: SparkSession, region: tuple[float, float, float, float], step: float) -> DataFrame:
    """iy, ix, lat, lon of a region (lonmin, lonmax, latmin, latmax); a region's points are those of the whole grid."""
    x0, x1 = axis(region[0], region[1], step, ORIGIN[0])
    y0, y1 = axis(region[2], region[3], step, ORIGIN[1])
    ys = spark.range(y0, y1).withColumnRenamed("id", "iy")
    return ys.withColumn("ix", F.explode(F.sequence(F.lit(x0), F.lit(x1 - 1)))).select("iy", F.col("ix").cast("long").alias("ix"), (ORIGIN[1] + F.col("iy") * F.lit(step)).alias("lat"), (ORIGIN[0] + F.col("ix") * F.lit(step)).alias("lon"))


def region_cells(cells: DataFrame, region: str | tuple[float, float, float, float], zoom: int, step: float = 0.1, cell: str = "cell", most: int = 64) -> DataFrame:
    """The rows of cells that a region's grid can lie in, and few others: for a table whose cell numbers are stored, as the ranges reach its scan."""
    x0, x1, y0, y1 = region_box(region)
    return cells.where(within(F.col(f"`{cell}`"), cover((x0 - step, x1 + step, y0 - step, y1 + step), zoom, most)))


def regrid(cells: DataFrame, region: str | tuple[float, float, float, float], zoom: int, step: float = 0.1, cell: str = "cell") -> DataFrame:
    """Values of HEALPix cells (nested numbers at 2**zoom subdivisions) on a region's grid: iy, ix, lat, lon and the other columns.

    Every grid point takes the cell that it lies in; points whose cell has no rows are left out. An
    equi-join on cell numbers; region_cells() keeps a table's scan from reading other cells.
    """
    points = grid_points(cells.sparkSession, region_box(region), step).withColumn(cell, healpix(F.col("lon"), F.col("lat"), zoom))
    return points.join(cells, cell).drop(cell)


def snap(value: Column, step: float, origin: float = 0.0) -> Column:
    """Index of the grid point nearest a coordinate."""
    return F.round((value - origin) / step).cast("long")


def coarsen(df: DataFrame, keys: tuple[str, ...], values: list[str], by: int = 2, y_size: int | None = None, x_size: int | None = None) -> DataFrame:
    """Means of by x by blocks; incomplete blocks at a given size's end are trimmed."""
    out = df
    for d, size in (("y", y_size), ("x", x_size)):
        if size is not None:
            out = out.where(F.col(d) < size // by * by)
    block = lambda d: F.floor(F.col(d) / by).cast("int").alias(d)
    return out.groupBy(*keys, block("y"), block("x")).agg(*(F.avg(v).alias(v) for v in values))
