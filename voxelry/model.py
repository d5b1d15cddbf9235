"""Grids, keys and column names that all operators share.

A field, mask or system table holds one row a voxel, keyed by integer places (t, z, y, x); missing
rows are background. Labels are BIGINT from 1. Joins are on these integers, never on coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = ("t", "z", "y", "x")


@dataclass(frozen=True)
class Grid:
    """Sizes of the dimensions (an upper bound will do for those that aren't periodic)."""

    z: int = 5
    y: int = 1 << 20
    x: int = 15
    t: int = 60

    def size(self, dim: str) -> int:
        return getattr(self, dim)

    def id(self, prefix: str = "") -> Column:
        """The voxel's place in C order, a BIGINT."""
        c = lambda d: F.col(prefix + d).cast("long")
        return ((c("t") * self.z + c("z")) * self.y + c("y")) * self.x + c("x")
