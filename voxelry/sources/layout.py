"""Tables laid out along a space-filling curve, so that boxes of places skip most of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DIMS

#: Bytes of a row group, about; a box reads those whose places can lie in it.
GROUP = 1 << 20
#: Rows of a file, about.
ROWS = 1 << 22


def morton(columns: list[Column], bits: int = 15) -> Column:
    """The place of integer coordinates on the Z-order curve: their low bits in turn, the first column's the highest. Four columns of 15 bits fill a long."""
    if bits * len(columns) > 62:
        raise ValueError("the curve's numbers don't fit a long")
    last = len(columns) - 1
    bit = lambda c, k: F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1))
    parts = [F.shiftleft(bit(c, k), k * len(columns) + last - i) for i, c in enumerate(columns) for k in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def save_along_curve(df: DataFrame, path: str, dims: tuple[str, ...] = DIMS, bits: int = 15, rows: int = ROWS, group: int = GROUP) -> None:
    """Writes a table of voxels as Parquet in the order of the curve over `dims`, in place of an earlier one.

    Rows are dealt by ranges of the curve and sorted there, so each file and each row group is a compact block of space and time, and its least and greatest
    places tell Spark's reader whether a box needs it. Coordinates count by their low `bits` bits; null ones come first. No rows: an empty table.
    """
    curve = morton([F.col(d) for d in dims], bits)
    parts = max(1, -(-df.count() // rows))
    # the curve alone would part ties by chance; the places settle them
    keys = [curve, *(F.col(d) for d in dims)]
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group).option("parquet.block.size.row.check.min", 1000).option("parquet.page.size", 1 << 16).parquet(path)
