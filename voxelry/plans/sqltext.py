"""Pieces of the SQL that checks queries."""

from __future__ import annotations

from itertools import product

from ..sources.adapters import FIRST_STEP, MASKS, TYPES

_Z = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(TYPES)) + " END"
FACES_4D = [tuple(s if i == d else 0 for i in range(4)) for d in range(4) for s in (-1, 1)]
FACES_3D = [o for o in FACES_4D if o[0] == 0]
FACES_2D = [o for o in FACES_3D if o[1] == 0]
FULL_3D = [(0, *o) for o in product((-1, 0, 1), repeat=3) if any(o)]


def vox(name: str, mask: str = "cloud", coarse: int = 1, where: str = "true") -> str:
    return (
        f"{name} AS (SELECT CAST(floor((floor(epoch_us(ts) / 43200000000.0) - {FIRST_STEP}) / {coarse}) AS INTEGER) AS t, CAST({_Z} AS INTEGER) AS z, "
        f"CAST(user_id // 15 AS INTEGER) AS y, CAST(user_id % 15 AS INTEGER) AS x, max(value) AS vmax, count(*) AS n FROM events WHERE {MASKS[mask]} GROUP BY 1, 2, 3, 4 HAVING {where})"
    )


def labelled(name: str, source: str, offsets: list[tuple], periodic: bool = False, min_size: int = 1, wrap_y: str | None = None) -> str:
    """CTEs that give `source`'s voxels the number of their component as label: the smallest id spreads to neighbours until it is settled."""
    steps = ", ".join(map(str, offsets))
    x = "(a.x + o.dx + 15) % 15" if periodic else "a.x + o.dx"
    y = f"(a.y + o.dy + {wrap_y}) % {wrap_y}" if wrap_y else "a.y + o.dy"
    return (
        f"{name}_i AS MATERIALIZED (SELECT *, ((CAST(t AS BIGINT) * 5 + z) * 1048576 + y) * 15 + x AS id FROM {source}), {name}_o(dt, dz, dy, dx) AS (VALUES {steps}), "
        f"{name}_e AS MATERIALIZED (SELECT a.id AS s, b.id AS d FROM {name}_i a, {name}_o o, {name}_i b WHERE b.t = a.t + o.dt AND b.z = a.z + o.dz AND b.y = {y} AND b.x = {x}), "
        f"{name}_r(id, c) USING KEY (id) AS (SELECT id, id FROM {name}_i UNION SELECT e.d, min(r.c) FROM {name}_r r JOIN {name}_e e ON e.s = r.id JOIN recurring.{name}_r k ON k.id = e.d WHERE r.c < k.c GROUP BY e.d), "
        f"{name}_c AS (SELECT id, c FROM {name}_r QUALIFY count(*) OVER (PARTITION BY c) >= {min_size}), "
        f"{name} AS MATERIALIZED (SELECT i.t, i.z, i.y, i.x, i.vmax, i.n, dense_rank() OVER (ORDER BY c.c) AS label FROM {name}_i i JOIN {name}_c c USING (id))"
    )


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


COLUMNS = (
    "c0 AS (SELECT l_orderkey AS col, l_linenumber AS lev, max(l_quantity) AS a, max(l_discount) + 0.0 AS b, max(l_tax) + 0.0 AS c, max(l_extendedprice) AS d, CAST(l_linenumber AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), "
    "cols AS (SELECT col, lev, CAST(1500 AS DOUBLE) * (v - 1) + 100 AS zg, CAST(100000 AS DOUBLE) - 12000 * (v - 1) AS pfull, CAST(300 AS DOUBLE) - 9 * (v - 1) + (a - 25) / CAST(10 AS DOUBLE) AS ta, "
    "CAST(0.002 AS DOUBLE) + b / CAST(20 AS DOUBLE) AS hus, c / CAST(1000 AS DOUBLE) AS cli, b / CAST(1000 AS DOUBLE) AS clw, CAST(0.0001 AS DOUBLE) * v AS qg, CAST(0.00005 AS DOUBLE) * v AS qr, CAST(0.00002 AS DOUBLE) * v AS qs, "
    "a - CAST(25 AS DOUBLE) AS ua, d / CAST(4000 AS DOUBLE) - 12 AS va, a / CAST(10 AS DOUBLE) - 1 AS wa_phy, CAST(1500 AS DOUBLE) AS dzghalf, "
    "CAST((col * 37) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - 180 AS lon, CAST((col * 17) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) - 15 AS lat FROM c0)"
)
RECORDS = (
    "rec AS (SELECT o_custkey AS dcc, o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS updraft, o_orderdate AS time, "
    "CAST((o_orderkey * 37) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - 180 AS lon, CAST((o_orderkey * 17) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) - 15 AS lat, "
    "CAST(floor(o_totalprice / 1000) AS BIGINT) AS npix, o_orderkey AS row FROM orders)"
)
#: Formulas of functions/physics.py over COLUMNS.
RD, RV = 287.04, 461.4
E_ = f"(pfull * hus / (({RD} / {RV}) * (1 + hus * (1 / ({RD} / {RV}) - 1))))"
ALPHA = "(CASE WHEN ta <= 250.16 THEN 0.0 WHEN ta >= 273.16 THEN 1.0 ELSE pow((ta - 250.16) / 23.0, 2) END)"
ES_W = "(611.2 * exp(17.502 * (ta - 273.16) / (ta - 32.19)))"
ES_I = "(611.2 * exp(22.587 * (ta - 273.16) / (ta + 0.7)))"
RH = f"({E_} / ({ALPHA} * {ES_W} + (1 - {ALPHA}) * {ES_I}))"
RHO = f"(pfull / ({RD} * ta) / (1 - hus - (cli + clw + qg + qr + qs)))"


def gradient(x: str, f: str, w: str) -> str:
    """Second-order derivative along window w, as functions/profiles.py has it."""
    lag, lead = (lambda c, n=1: f"lag({c}, {n}) OVER {w}"), (lambda c, n=1: f"lead({c}, {n}) OVER {w}")
    d1, d2 = f"({lead(x)} - {x})", f"({lead(x, 2)} - {lead(x)})"
    e1, e2 = f"({lag(x)} - {lag(x, 2)})", f"({x} - {lag(x)})"
    first = f"(-(2 * {d1} + {d2}) / ({d1} * ({d1} + {d2})) * {f} + ({d1} + {d2}) / ({d1} * {d2}) * {lead(f)} - {d1} / ({d2} * ({d1} + {d2})) * {lead(f, 2)})"
    last = f"({e2} / ({e1} * ({e1} + {e2})) * {lag(f, 2)} - ({e2} + {e1}) / ({e1} * {e2}) * {lag(f)} + (2 * {e2} + {e1}) / ({e2} * ({e1} + {e2})) * {f})"
    return f"CASE WHEN count(*) OVER (PARTITION BY col) < 3 THEN NULL WHEN row_number() OVER {w} = 1 THEN {first} WHEN row_number() OVER {w} = count(*) OVER (PARTITION BY col) THEN {last} ELSE {interior(x, f, w)} END"


def interior(x: str, f: str, w: str) -> str:
    hs, hd = f"({x} - lag({x}) OVER {w})", f"(lead({x}) OVER {w} - {x})"
    return f"(({hs} * {hs} * lead({f}) OVER {w} + ({hd} * {hd} - {hs} * {hs}) * {f} - {hd} * {hd} * lag({f}) OVER {w}) / ({hs} * {hd} * ({hs} + {hd})))"


def derivative(x: str, f: str, w: str) -> str:
    return (
        f"CASE WHEN lag({x}) OVER {w} IS NULL THEN (lead({f}) OVER {w} - {f}) / (lead({x}) OVER {w} - {x}) "
        f"WHEN lead({x}) OVER {w} IS NULL THEN ({f} - lag({f}) OVER {w}) / ({x} - lag({x}) OVER {w}) ELSE {interior(x, f, w)} END"
    )
