"""Distance topography of labels and erosion by it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DIMS
from ..ship import ship, tidied
from ..storage import partitions

#: Voxels of the rows of the grid that one group of a task holds, about.
GROUP = 1 << 19
#: No distance is known.
FAR = -1


def envelope(run: np.ndarray, at: np.ndarray, height: np.ndarray, asked_run: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """At each asked place of a run the least of height + (place - at)**2 over the run's parabolas, FAR where it has none.

    run, at: ascending. The parabolas that are lowest somewhere are found from left to right: a new one drives out those that it
    undercuts before they begin, so each comes and goes once. All runs take a step together.
    """
    out = np.full(len(asked), FAR, np.int64)
    if not len(at):
        return out
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    size = np.diff(np.append(head, len(run)))
    low, begins = np.zeros(len(run), np.int64), np.full(len(run), -np.inf)  # of each run's stack: parabolas, and from where they are lowest
    top = np.full(len(head), -1)
    lift = height + at * at
    for step in range(int(size.max())):
        live = np.flatnonzero(size > step)
        q = head[live] + step
        start = np.full(len(live), -np.inf)
        open_ = np.arange(len(live))
        while len(open_):
            open_ = open_[top[live[open_]] >= 0]
            place = head[live[open_]] + top[live[open_]]
            v = low[place]
            crossing = (lift[q[open_]] - lift[v]) / (2.0 * (at[q[open_]] - at[v]))
            gone = crossing <= begins[place]
            start[open_] = crossing
            top[live[open_[gone]]] -= 1
            open_ = open_[gone]
        start[top[live] < 0] = -np.inf
        top[live] += 1
        low[head[live] + top[live]], begins[head[live] + top[live]] = q, start
    held = np.arange(len(run)) - np.repeat(head, size) <= np.repeat(top, size)
    names, wide = run[head], float(max(at.max(), asked.max()) + 4)
    number = np.searchsorted(names, asked_run)
    there = (number < len(names)) & (names[np.minimum(number, len(names) - 1)] == asked_run)
    keys = np.repeat(np.arange(len(head)), size)[held] * wide + np.clip(begins[held], -2, wide - 3)
    best = low[held][np.maximum(np.searchsorted(keys, number[there] * wide + asked[there], "right") - 1, 0)]
    out[there] = height[best] + (asked[there] - at[best]) ** 2
    return out


def _pass(df: DataFrame, keys: list[str], along: str, size: int, parts: int) -> DataFrame:
    """`d2` after the axis `along`: the least of the squared distance to the end of the voxel's run, and others' d2 plus the squared way there.

    Runs lie in one row of the grid, many rows in a group; the work is linear in their voxels.
    """

    def run(key, t: pa.Table) -> pa.Table:
        columns = {c: t[c].to_numpy() for c in (*keys, "label", along)}
        d2 = t["d2"].fill_null(FAR).to_numpy()
        order = np.lexsort([columns[c] for c in (along, "label", *keys)])
        columns, d2 = {c: v[order] for c, v in columns.items()}, d2[order]
        place = columns[along].astype(np.int64)
        fresh = np.ones(len(order), bool)
        fresh[1:] = place[1:] > place[:-1] + 1
        for c in (*keys, "label"):
            fresh[1:] |= columns[c][1:] != columns[c][:-1]
        number = np.cumsum(fresh) - 1
        first, last = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(order)) - 1
        before, behind = np.flatnonzero(place[first] > 0), np.flatnonzero(place[last] < size - 1)
        known = np.flatnonzero(d2 >= 0)
        whose = np.concatenate([before, number[known], behind])  # what isn't of the label, next to a run, has no distance
        where = np.concatenate([place[first[before]] - 1, place[known], place[last[behind]] + 1])
        height = np.concatenate([np.zeros(len(before), np.int64), d2[known], np.zeros(len(behind), np.int64)])
        sort = np.lexsort([height, where, whose])
        once = np.ones(len(sort), bool)  # voxels that repeat
        once[1:] = (where[sort][1:] != where[sort][:-1]) | (whose[sort][1:] != whose[sort][:-1])
        sort = sort[once]
        found = envelope(whose[sort], where[sort], height[sort], number, place)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return t.drop_columns(["part"]).set_column(t.schema.get_field_index("d2"), "d2", pa.array(found[back], mask=found[back] < 0))

    dealt = df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(tidied(run), df.schema)


def topography(mask: DataFrame, y_size: int, x_size: int, column: str = "label", z_size: int | None = None) -> DataFrame:
    """Each voxel's distance to the nearest pixel not of its label, over the label's greatest one: in its slice, or with z_size in its volume.

    The outside of the grid is no such pixel. A label that fills the whole slice has no distance
    (null). One pass along each axis. Rows with a null place or label are left out; voxels that repeat stay and have the same distance. No rows: none.
    """
    ship(mask.sparkSession)
    sizes = {"x": x_size, "y": y_size} | ({"z": z_size} if z_size is not None else {})
    fixed = [d for d in ("t", "z") if d not in sizes]
    out = mask.select(*DIMS, F.col(column).alias("label")).dropna().withColumn("d2", F.lit(None).cast("long"))
    parts = max(partitions(mask.sparkSession), -(-mask.count() // GROUP))
    for along, size in sizes.items():
        out = _pass(out, fixed + [d for d in sizes if d != along], along, size, parts)
    out = out.withColumn("distance", F.sqrt(F.col("d2").cast("double"))).drop("d2")
    top = F.max("distance").over(Window.partitionBy(*fixed, "label"))
    return out.withColumn("topography", F.col("distance") / top).withColumnRenamed("label", column)


def weighted_erode(mask: DataFrame, y_size: int, x_size: int, value: float = 0.5, column: str = "label", z_size: int | None = None) -> DataFrame:
    """Voxels whose topography exceeds `value`; labels without a distance have none."""
    return topography(mask, y_size, x_size, column, z_size).where(F.col("topography") > value).select("t", "z", "y", "x", column)

