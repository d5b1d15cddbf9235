"""Boxes of longitude and latitude as ranges of nested HEALPix cells, which scans can be filtered by."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ring and place along it at which each of the twelve base cells ends, fixed by the scheme (Górski et al. 2005).
RING = np.repeat([2, 3, 4], 4)
ALONG = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def centres(cells: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude (0 to 360) and latitude of the centres of nested cells at 2**zoom subdivisions."""
    n = 1 << zoom
    face, inside = cells >> 2 * zoom, cells & ((1 << 2 * zoom) - 1)
    ix = sum(((inside >> 2 * k) & 1) << k for k in range(zoom)) + np.zeros_like(cells)
    iy = sum(((inside >> 2 * k + 1) & 1) << k for k in range(zoom)) + np.zeros_like(cells)
    ring = RING[face] * n - ix - iy - 1
    north, south = ring < n, ring > 3 * n
    width = np.where(north, ring, np.where(south, 4 * n - ring, n))
    z = np.where(north, 1 - width**2 / (3 * n * n), np.where(south, width**2 / (3 * n * n) - 1, (2 * n - ring) * 2 / (3 * n)))
    shift = np.where(north | south, 0, (ring - n) & 1)
    place = (ALONG[face] * width + ix - iy + 1 + shift) // 2
    place = np.where(place > 4 * n, place - 4 * n, np.where(place < 1, place + 4 * n, place))
    return (place - (shift + 1) / 2) * 90 / width, np.degrees(np.arcsin(z))


def radius(zoom: int) -> float:
    """Degrees from a cell's centre to its farthest corner, at most."""
    n = 1 << zoom
    a, b = (2 / 3, math.pi / (4 * n)), (1 - (1 - 1 / n) ** 2 / 3, 0.0)
    dot = math.sqrt((1 - a[0] ** 2) * (1 - b[0] ** 2)) * math.cos(a[1] - b[1]) + a[0] * b[0]
    return math.degrees(math.acos(min(1.0, dot)))


def _meets(cells: np.ndarray, zoom: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which cells' circles meet a box (lonmin, lonmax, latmin, latmax); longitudes go round."""
    lon, lat = centres(cells, zoom)
    r = radius(zoom) + 1e-9
    near = (lat >= box[2] - r) & (lat <= box[3] + r)
    polar = np.abs(lat) + r >= 90
    margin = np.degrees(np.arcsin(np.minimum(1.0, math.sin(math.radians(min(r, 90.0))) / np.maximum(np.cos(np.radians(lat)), 1e-12))))
    width = box[1] - box[0] + 2 * margin
    return near & (polar | (width >= 360) | ((lon - box[0] + margin) % 360 <= width))


def cover(box: tuple[float, float, float, float], zoom: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges (first, last) of cells at 2**zoom subdivisions that hold all points of a box, `most` at most; ascending, apart.

    Cells are divided level by level, and those whose circle misses the box are dropped, as long as the rest makes no more ranges. A box that is
    turned round (lonmin > lonmax) or empty has none.
    """
    if box[0] > box[1] or box[2] > box[3]:
        return []
    now, best = np.arange(12), [(0, (12 << 2 * zoom) - 1)]
    for level in range(zoom + 1):
        now = now[_meets(now, level, box)]
        if not len(now):
            return []
        first = np.flatnonzero(np.append(True, np.diff(now) > 1))
        if len(first) > most:
            break
        last = np.append(first[1:], len(now)) - 1
        best = [(int(a), int(b)) for a, b in zip(now[first] << 2 * (zoom - level), ((now[last] + 1) << 2 * (zoom - level)) - 1, strict=True)]
        now = (now[:, None] * 4 + np.arange(4)).ravel()
    return best


def within(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a cell lies in one of the ranges: comparisons with constants, which reach the scan."""
    out = F.lit(False)
    for k, (low, high) in enumerate(ranges):
        one = (cell >= low) & (cell <= high)
        out = one if not k else out | one
    return out
