"""One-to-one linking by least total distance, subnet by subnet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship, tidied
from ..storage import Scratch, partitions
from .graph import components

#: Squared distances are compared in units of this many parts of a step squared.
UNIT = 10 ** 9
#: Candidate pairs that one group of a task solves, about.
GROUP = 1 << 18


def _shortest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column of each row in an assignment of least cost, and potentials: rows are added one by one along a shortest augmenting path."""
    n = len(cost)
    u, v = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    row = np.full(n + 1, -1)  # of each column; the last is the one a path begins at
    for i in range(n):
        row[n], j = i, n
        low, before, done = np.full(n, np.iinfo(np.int64).max), np.full(n, n), np.zeros(n + 1, bool)
        while row[j] >= 0:
            done[j] = True
            free = np.flatnonzero(~done[:n])
            reduced = cost[row[j], free] - u[row[j]] - v[free]
            better = reduced < low[free]
            low[free[better]], before[free[better]] = reduced[better], j
            k = free[np.argmin(low[free])]
            step = low[k]
            u[row[done]] += step
            v[done] -= step
            low[free] -= step
            j = k
        while j != n:
            row[j], j = row[before[j]], before[j]
    column = np.empty(n, np.int64)
    column[row[:n]] = np.arange(n)
    return column, u[:n], v[:n]


def _first_of_the_best(column: np.ndarray, tight: np.ndarray, rows: int) -> np.ndarray:
    """Of all assignments along tight edges the one whose first rows have the smallest columns; one row after the other moves on if the rest can follow."""
    column = column.copy()
    free = np.ones(len(column), bool)  # columns that aren't settled
    for i in range(rows):
        for j in np.flatnonzero(tight[i] & free).tolist():
            if j >= column[i]:
                break
            owner = np.empty_like(column)
            owner[column] = np.arange(len(column))
            # whoever has j looks, along tight edges, for the column that i gives up
            goal, start, came, queue = column[i], int(owner[j]), {}, [int(owner[j])]
            while queue and goal not in came:
                r = queue.pop(0)
                for c in np.flatnonzero(tight[r] & free).tolist():
                    if c not in came and c != j:
                        came[c] = r
                        if owner[c] != i:
                            queue.append(int(owner[c]))
            if goal in came:
                c = goal
                while True:
                    r = came[c]
                    column[r], c = c, column[r]
                    if r == start:
                        break
                column[i] = j
                break
        free[column[i]] = False
    return column


def solve(a: np.ndarray, b: np.ndarray, d: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of the candidates with costs d, each end once, of the least sum, where every a without a partner costs `alone`.

    Of several the one that gives the smallest a its smallest b (none comes last), then the next a.
    """
    rows, i = np.unique(a, return_inverse=True)
    columns, j = np.unique(b, return_inverse=True)
    n, m = len(rows), len(columns)
    if n == m == 1:
        return rows, columns
    big = (n + 1) * max(int(alone), int(d.max())) + 1
    cost = np.full((n + m, n + m), big, np.int64)
    cost[i, j] = d
    cost[np.arange(n), m + np.arange(n)] = alone  # each a may stay alone
    cost[n:] = 0  # and each b
    column, u, v = _shortest(cost)
    column = _first_of_the_best(column, cost == u[:, None] + v, n)
    taken = column[:n] < m
    return rows[taken], columns[column[:n][taken]]


def _groups(key, table: pa.Table) -> pa.Table:
    table = table.sort_by([("subnet", "ascending")])
    net, a, b, d = (table[c].to_numpy() for c in ("subnet", "a", "b", "d"))
    alone = table["alone"][0].as_py()
    bounds = np.flatnonzero(np.append(True, net[1:] != net[:-1])).tolist() + [len(net)]
    found = [solve(a[lo:hi], b[lo:hi], d[lo:hi], alone) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return pa.table([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], names=["a", "b"])


def least_total(pairs: DataFrame, radius: float, scratch: Scratch, most: int = 30, step: float = 0.95, stop: float = 0.2) -> DataFrame:
    """(a, b): of the candidate pairs (a, b, d), d a squared distance, those of the least total, each a and each b once.

    An a without partner costs the radius squared, so a pair is taken unless that spoils others. Pairs farther than the radius,
    with a null or repeated, don't change the result. Candidates that share an end are a subnet; each is solved by itself, many
    in a task. In a subnet of more than `most` ends on one side the radius shrinks by the factor `step`, and what falls
    apart is solved with it; ValueError if one is still too large below `stop` times the radius, as it can't be told apart.
    Distances are compared to a billionth; of equal totals see solve(). No rows: none.
    """
    ship(pairs.sparkSession)
    cost = F.round(F.col("d") * UNIT).cast("long")
    open_ = scratch.save(pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.min(cost).alias("d")))
    taken, now = None, radius
    while True:
        alone = round(now * now * UNIT)
        # both ends of a pair may be features of neighbouring steps: even numbers are first ends, odd ones second
        near = open_.where(F.col("d") <= alone)
        found = components(near.select((F.col("a") * 2).alias("src"), (F.col("b") * 2 + 1).alias("dst")), scratch)
        named = scratch.save(near.join(found.where("node % 2 = 0").select(F.expr("node div 2").alias("a"), F.col("component").alias("subnet")), "a"))
        sizes = named.groupBy("subnet").agg(F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.count("*").alias("n"))
        sizes = scratch.save(sizes.select("subnet", "n", (F.greatest("na", "nb") > most).alias("large")))
        small = named.join(sizes.where("NOT large").select("subnet"), "subnet")
        parts = max(partitions(pairs.sparkSession), -(-int(sizes.where("NOT large").agg(F.sum("n")).first()[0] or 0) // GROUP))
        dealt = small.select("subnet", "a", "b", "d", F.lit(alone).cast("long").alias("alone"), F.pmod(F.xxhash64("subnet"), F.lit(parts)).cast("int").alias("part"))
        solved = scratch.save(dealt.groupBy("part").applyInArrow(tidied(_groups), "a long, b long"))
        taken = solved if taken is None else taken.unionByName(solved)
        if not sizes.where("large").head(1):
            return taken
        now *= step
        if now < stop * radius:
            raise ValueError(f"a subnet of more than {most} features is left within {now / step:g}, near the least radius")
        open_ = named.join(sizes.where("large").select("subnet"), "subnet").select("a", "b", "d")
