"""Zones as arrays that every task holds, sorted by grid cell: a line is tested in the row it is in and sent nowhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import geo

#: Side of a grid cell in degrees, segments that are looked at together, and tests that are made at a time.
CELL = 0.02
SEGMENTS, TESTS = 4096, 1 << 20


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` of each run, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _distance_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """As :func:`geo.segment_distance_m`."""
    metres = geo.metres_per_degree()
    east = metres * np.cos(np.radians(lat))
    ax, ay, bx, by = (lon1 - lon) * east, (lat1 - lat) * metres, (lon2 - lon) * east, (lat2 - lat) * metres
    at_a, at_b = ax * (ax - bx) + ay * (ay - by), bx * (bx - ax) + by * (by - ay)
    span = np.hypot(bx - ax, by - ay)
    to_line = np.abs(ax * by - ay * bx) / np.where(span == 0, 1.0, span)
    return np.where(at_a <= 0, np.hypot(ax, ay), np.where(at_b <= 0, np.hypot(bx, by), to_line))


class ZoneIndex:
    """``lat, lon, radius_m`` of zones, and for each cell that a zone's box touches the zones that do: 32 bytes for a zone and cell."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius_m: np.ndarray):
        up = radius_m / geo.metres_per_degree() * 1.001
        side = up / np.cos(np.radians(lat))
        low, left = np.floor((lat - up) / CELL).astype(np.int64), np.floor((lon - side) / CELL).astype(np.int64)
        tall, wide = np.floor((lat + up) / CELL).astype(np.int64) - low + 1, np.floor((lon + side) / CELL).astype(np.int64) - left + 1
        row_zone = np.repeat(np.arange(len(lat)), tall)
        rows = _runs(low, tall)
        zone = np.repeat(row_zone, wide[row_zone])
        cell = self._key(np.repeat(rows, wide[row_zone]), _runs(left[row_zone], wide[row_zone]))
        order = np.argsort(cell, kind="stable")
        self.cells, self.first, self.count = np.unique(cell[order], return_index=True, return_counts=True)
        zone = zone[order]
        self.lat, self.lon, self.radius_m = lat[zone], lon[zone], radius_m[zone]

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (1 << 32) + b

    def _passed(self, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(segment, cell)`` of the cells that segments pass, row by row of the grid, with a margin for rounding."""
        lo, hi, west, east = np.minimum(lat1, lat2), np.maximum(lat1, lat2), np.minimum(lon1, lon2), np.maximum(lon1, lon2)
        first = np.floor(lo / CELL).astype(np.int64)
        tall = np.floor(hi / CELL).astype(np.int64) - first + 1
        s, a = np.repeat(np.arange(len(lo)), tall), _runs(first, tall)
        rise = (lat2 - lat1)[s]
        # A segment that hardly changes its latitude is taken to be as long in the row as it is.
        steep = np.abs(rise) > 1e-6

        def lon_at(lat: np.ndarray) -> np.ndarray:
            return lon1[s] + (lat - lat1[s]) / np.where(steep, rise, 1.0) * (lon2 - lon1)[s]

        at, to = lon_at(np.maximum(lo[s], a * CELL)), lon_at(np.minimum(hi[s], (a + 1) * CELL))
        left = np.floor((np.where(steep, np.minimum(at, to), west[s]) - 1e-5) / CELL).astype(np.int64)
        wide = np.floor((np.where(steep, np.maximum(at, to), east[s]) + 1e-5) / CELL).astype(np.int64) - left + 1
        return np.repeat(s, wide), self._key(np.repeat(a, wide), _runs(left, wide))

    def _any(self, line: list[np.ndarray]) -> np.ndarray:
        hit = np.zeros(len(line[0]), bool)
        if not len(self.cells):
            return hit
        s, cell = self._passed(*line)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        there = self.cells[at] == cell
        s, first, left = s[there], self.first[at[there]], self.count[at[there]]
        step = 1
        # Every segment tests some zones of each of its cells, those that met none test more.
        while len(s):
            n = np.minimum(left, step)
            one, z = np.repeat(s, n), _runs(first, n)
            near = _distance_m(*[c[one] for c in line], self.lat[z], self.lon[z]) <= self.radius_m[z]
            hit[one[near]] = True
            more = (left > step) & ~hit[s]
            s, first, left = s[more], first[more] + step, left[more] - step
            step = max(1, min(2 * step, TESTS // max(1, len(s))))
        return hit

    def any_near(self, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
        """Whether a segment comes within the radius of some zone; false where an end is not known."""
        out = np.zeros(len(lat1), bool)
        known = np.flatnonzero(np.isfinite(lat1) & np.isfinite(lon1) & np.isfinite(lat2) & np.isfinite(lon2))
        for part in np.split(known, range(SEGMENTS, len(known), SEGMENTS)):
            out[part] = self._any([c[part] for c in (lat1, lon1, lat2, lon2)])
        return out


def crosses(zones: DataFrame) -> Callable[..., Column]:
    """A test for lines: ``test(lat, lon, lat, lon, ...)`` of the points of a line in order, two at least, is whether it comes within the radius
    of some zone (``lat, lon, radius_m``). The zones are sent to every executor, some 50 bytes each."""
    known = zones.select(*[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "radius_m")]).na.drop().toArrow()
    held = zones.sparkSession.sparkContext.broadcast(ZoneIndex(*[known[c].to_numpy().copy() for c in ("lat", "lon", "radius_m")]))

    @F.pandas_udf("boolean")
    def test(*points: pd.Series) -> pd.Series:
        at = [p.to_numpy(dtype=float, na_value=np.nan) for p in points]
        hit = np.zeros(len(at[0]), bool)
        for k in range(0, len(at) - 2, 2):
            rest = np.flatnonzero(~hit)
            hit[rest] = held.value.any_near(*[c[rest] for c in at[k:k + 4]])
        return pd.Series(hit)

    return test
