"""Storm environments: radius and direction joins around centres, and where extremes lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(points: DataFrame, centres: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (lon, lat) and centres (clon, clat) less than `radius` degrees apart, planar, with equal columns `on`.

    Both sides meet on cells as wide as the radius: a centre asks its own and the eight around it,
    so the join is an equi-join at any radius, and the points, of which there are more, move once.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    there = points.withColumn("_cx", cell("lon")).withColumn("_cy", cell("lat"))
    asked = centres.withColumn("_dx", around).withColumn("_dy", around).withColumn("_cx", cell("clon") + F.col("_dx")).withColumn("_cy", cell("clat") + F.col("_dy")).drop("_dx", "_dy")
    return there.join(asked, [*on, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", F.sqrt(F.pow(F.col("clon") - F.col("lon"), 2) + F.pow(F.col("clat") - F.col("lat"), 2))).where(F.col("distance") < radius)


def interacting(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    return within(points, centres, radius)


def ingested(points: DataFrame, centres: DataFrame, radius: float, u: str = "u", v: str = "v") -> DataFrame:
    """The pairs whose wind blows from the point towards the centre; a point at the centre has no direction."""
    towards = (F.col("clon") - F.col("lon")) * F.col(u) + (F.col("clat") - F.col("lat")) * F.col(v)
    return within(points, centres, radius).where((F.col("distance") > 0) & (towards > 0))


def max_location(field: DataFrame, value: str, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """keys, y, x and the value of the greatest; of equal ones the first in (y, x) order."""
    best = F.min_by(F.struct("y", "x", F.col(value).alias("v")), F.struct((-F.col(value)).alias("a"), "y", "x"))
    return field.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.y", "b.x", F.col("b.v").alias(value))


def cloud_centre(field: DataFrame, flux: str, path: str, keys: tuple[str, ...] = ("system", "t")) -> DataFrame:
    """keys, y, x: where the flux is greatest while there is any, else where the path is."""
    at = lambda v: F.min_by(F.struct("y", "x"), F.struct((-F.col(v)).alias("a"), "y", "x"))
    out = field.groupBy(*keys).agg(F.min_by(F.when(F.col(flux).isNotNull(), F.struct("y", "x")), F.when(F.col(flux).isNotNull(), F.struct((-F.col(flux)).alias("a"), "y", "x"))).alias("f"), at(path).alias("p"))
    return out.select(*keys, F.coalesce("f.y", "p.y").alias("y"), F.coalesce("f.x", "p.x").alias("x"))


def circular_extent(df: DataFrame, keys: tuple[str, ...], lon: str = "lon") -> DataFrame:
    """keys, lonn, lonx and crosses: the least arc of longitudes that holds all, from its west end; lonx beyond 180 crosses it."""
    distinct = df.select(*keys, F.col(lon).alias("lon")).distinct()
    w = Window.partitionBy(*keys).orderBy("lon")
    whole = Window.partitionBy(*keys)
    gaps = distinct.withColumn("next", F.coalesce(F.lead("lon").over(w), F.min("lon").over(whole) + 360)).withColumn("gap", F.col("next") - F.col("lon"))
    best = gaps.groupBy(*keys).agg(F.min_by(F.struct("lon", "next"), F.struct((-F.round("gap", 9)).alias("a"), "lon")).alias("b"))
    start = F.when(F.col("b.next") >= 180, F.col("b.next") - 360).otherwise(F.col("b.next"))
    span = F.pmod(F.col("b.lon") - F.col("b.next"), F.lit(360.0))
    return best.select(*keys, start.alias("lonn"), (start + span).alias("lonx"), (start + span > 180).alias("crosses"))


def transect(centre: DataFrame, wind: DataFrame, field: DataFrame, y_size: int, x_size: int, value: str, keys: tuple[str, ...] = ("system", "t")) -> DataFrame:
    """keys, z, step and the value along the mean wind's line through the centre, to the grid's edges; bilinear, null without all four corners."""
    line = centre.join(wind, list(keys)).withColumn("speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).where("speed > 0")
    far = y_size + x_size
    steps = line.withColumn("step", F.explode(F.sequence(F.lit(-far), F.lit(far)))).withColumn("py", F.col("y") + F.col("step") * F.col("v") / F.col("speed")).withColumn("px", F.col("x") + F.col("step") * F.col("u") / F.col("speed"))
    steps = steps.where(F.col("py").between(0, y_size - 1) & F.col("px").between(0, x_size - 1))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    four = steps.withColumn("c", corner).withColumn("fy", F.col("py") - F.floor("py")).withColumn("fx", F.col("px") - F.floor("px"))
    weight = F.when(F.col("c.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("c.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    four = four.withColumn("weight", weight).where("weight > 0").select(*keys, "step", "weight", (F.floor("py") + F.col("c.a")).cast("int").alias("y"), (F.floor("px") + F.col("c.b")).cast("int").alias("x"))
    met = four.join(field.select("t", "z", "y", "x", F.col(value).alias("_v")), ["t", "y", "x"])
    out = met.groupBy(*keys, "z", "step").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("_v")).alias(value))
    return out.select(*keys, "z", "step", F.when(F.col("w") > 1 - 1e-9, F.col(value)).alias(value))


def with_zone(points: DataFrame, zones: DataFrame, cell: float = 5.0) -> DataFrame:
    """The points (lon, lat) with `zone`: the name of the smallest box that holds them, of zones (zone, lon0, lon1, lat0, lat1); null without one.

    Both sides meet on cells of `cell` degrees, into which a box is expanded.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    boxes = zones.withColumn("_cx", F.explode(F.sequence(at(F.col("lon0")), at(F.col("lon1"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("lat0")), at(F.col("lat1")))))
    numbered = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cx", at(F.col("lon"))).withColumn("_cy", at(F.col("lat")))
    met = numbered.select("_id", "lon", "lat", "_cx", "_cy").join(boxes, ["_cx", "_cy"]).where("lon BETWEEN lon0 AND lon1 AND lat BETWEEN lat0 AND lat1")
    best = met.groupBy("_id").agg(F.min_by("zone", F.struct(((F.col("lon1") - F.col("lon0")) * (F.col("lat1") - F.col("lat0"))).alias("area"), "zone")).alias("zone"))
    return numbered.join(best, "_id", "left").drop("_id", "_cx", "_cy")


def local_time(utc: Column, lon: Column, zone: Column | None = None) -> Column:
    """Local time of a zone name where it is known, else by 15 degrees an hour."""
    by_sun = F.timestamp_seconds(F.unix_timestamp(utc) + F.round(lon / 15).cast("long") * 3600)
    return by_sun if zone is None else F.coalesce(F.from_utc_timestamp(utc, zone), by_sun)
