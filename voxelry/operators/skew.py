"""Joins whose left side may hold a great share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are treated as heavy, at most; each has more than a 4096th of the rows.
HEAVY = 4096


def lookup(left: DataFrame, right: DataFrame, on: list[str], per_key: DataFrame, how: str = "inner", least: int = 1000) -> DataFrame:
    """left joined (inner or left) with right, which has each key once.

    per_key: the keys and how many rows of left each has, `n`; a written table, as it is read more
    than once. Keys with more than `least` rows and a 4096th of all rows are at most 4096: their rows of right are
    broadcast, so that their rows of left stay where they are. All others are shuffled.
    """
    limit = max(least, int(per_key.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = per_key.where(F.col("n") > limit).select(*on)
    if not heavy.head(1):
        return left.join(right, on, how)
    hot = left.join(F.broadcast(right.join(F.broadcast(heavy), on, "left_semi")), on, "inner")
    rest = left.join(F.broadcast(heavy), on, "left_anti").join(right, on, how)
    if how == "left":  # heavy keys that right hasn't
        rest = rest.unionByName(left.join(F.broadcast(heavy.join(right, on, "left_anti")), on, "left_semi"), allowMissingColumns=True)
    return hot.unionByName(rest)
