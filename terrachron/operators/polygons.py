"""Polygons as WKB, by Arrow functions; projection by plain expressions.

Geometries are polygons and multipolygons of either byte order, with or without
Z, M and SRID; only x and y count. Null, empty and other geometries measure 0
and clean to null.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructType

Ring = np.ndarray


def parse(wkb: bytes | None) -> list[list[Ring]]:
    """Polygons, each a list of closed rings of shape (n, 2)."""
    return _geometry(bytes(wkb), 0)[0] if wkb else []


def _geometry(data: bytes, at: int) -> tuple[list[list[Ring]], int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5 + (4 if code & 0x20000000 else 0)
    base = (code & 0x0FFFFFFF) % 1000
    kind = (code & 0x0FFFFFFF) // 1000
    width = 2 + (1 if code & 0x80000000 or kind in (1, 3) else 0) + (1 if code & 0x40000000 or kind in (2, 3) else 0)
    if base not in (3, 6):
        return [], len(data)
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if base == 6:
        found = []
        for _ in range(n):
            part, at = _geometry(data, at)
            found += part
        return found, at
    rings = []
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", data, at)
        rings.append(np.frombuffer(data, order + "f8", m * width, at + 4).reshape(m, width)[:, :2].astype(float))
        at += 4 + 8 * m * width
    return [rings] if rings else [], at


def dump(polygons: list[list[Ring]]) -> bytes | None:
    """A multipolygon, little endian; None for no polygon."""
    if not polygons:
        return None
    out = [struct.pack("<BII", 1, 6, len(polygons))]
    for rings in polygons:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        out += [struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings]
    return b"".join(out)


def ring_area(r: Ring) -> float:
    if len(r) < 3:
        return 0.0
    p = r - r[0]
    return abs(float(np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1]))) / 2


def ring_length(r: Ring) -> float:
    return float(np.hypot(*np.diff(r, axis=0).T).sum()) if len(r) > 1 else 0.0


def snapped(r: Ring, grid: float) -> Ring | None:
    """The ring on the grid, without repeated neighbours; None if no area is left."""
    p = np.rint(r / grid) * grid
    p = p[np.r_[True, (np.diff(p, axis=0) != 0).any(axis=1)]]
    return p if len(p) > 3 and ring_area(p) > 0 else None


def cut(r: Ring, axis: int, bound: float, sign: int) -> Ring:
    """The part of a closed ring with sign * (p[axis] - bound) >= 0."""
    out = []
    for a, b in zip(r[:-1], r[1:]):
        da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
        if da >= 0:
            out.append(a)
        if (da < 0) != (db < 0):
            out.append(a + (b - a) * (da / (da - db)))
    return np.array([*out, out[0]]) if out else np.empty((0, 2))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise, not closed."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    half = []
    for side in (p, p[::-1]):
        chain: list = []
        for q in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(q)
        half += chain[:-1]
    return np.array(half)


#: A type object: a string would need a session when this module is imported.
MEASURES = StructType().add("area", DoubleType()).add("perimeter", DoubleType()).add("parts", IntegerType())


@F.pandas_udf(MEASURES)
def measures(wkb: pd.Series) -> pd.DataFrame:
    """Area less holes, length of all rings, number of polygons."""
    found = [parse(g) for g in wkb]
    area = [sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in g) for g in found]
    return pd.DataFrame({"area": np.array(area, float), "perimeter": [float(sum(ring_length(r) for p in g for r in p)) for g in found], "parts": [len(g) for g in found]})


def cleaned(wkb: Column, grid: float = 2.0) -> Column:
    """Two dimensions, on the grid; rings and polygons without area go, and null is what is left of nothing."""

    @F.pandas_udf("binary")
    def run(wkb: pd.Series) -> pd.Series:
        out = []
        for g in wkb:
            kept = []
            for shell, *holes in parse(g):
                if (outer := snapped(shell, grid)) is not None:
                    kept.append([outer, *(h for r in holes if (h := snapped(r, grid)) is not None)])
            out.append(dump(kept))
        return pd.Series(out, dtype=object)

    return run(wkb)


def clipped(wkb: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """The part within a box. Concave shapes may keep edges of no width along it, which add no area."""

    @F.pandas_udf("binary")
    def run(wkb: pd.Series) -> pd.Series:
        def within(r):
            for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
                r = cut(r, axis, bound, sign) if len(r) else r
            return r if ring_area(r) > 0 else None

        out = []
        for g in wkb:
            kept = []
            for shell, *holes in parse(g):
                if (outer := within(shell)) is not None:
                    kept.append([outer, *(h for r in holes if (h := within(r)) is not None)])
            out.append(dump(kept))
        return pd.Series(out, dtype=object)

    return run(wkb)


@F.pandas_udf(BinaryType())
def box(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series([dump([[np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], float)]]) for a, b, c, d in zip(x1, y1, x2, y2)], dtype=object)


def region(areas: DataFrame, wkb: str = "geom") -> DataFrame:
    """x, y: corners of the convex hull of all areas. Tasks send the corners of their own hulls only."""

    def of_geometries(batches):
        corners = np.empty((0, 2))
        for b in batches:
            corners = hull(np.concatenate([corners, *(r for g in b[wkb] for p in parse(g) for r in p)]))
        yield pd.DataFrame(corners, columns=["x", "y"])

    def of_points(batches):
        corners = np.empty((0, 2))
        for b in batches:
            corners = hull(np.concatenate([corners, b[["x", "y"]].to_numpy()]))
        yield pd.DataFrame(corners, columns=["x", "y"])

    partial = areas.select(wkb).mapInPandas(of_geometries, "x double, y double")
    return partial.coalesce(1).mapInPandas(of_points, "x double, y double")


#: Fixed values of the WGS 84 ellipsoid and of UTM.
A, FLATTENING, SCALE, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm(lon: Column, lat: Column, zone: int = 30) -> tuple[Column, Column]:
    """Easting and northing (northern half) by the transverse Mercator series in the third flattening; exact to millimetres within a zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(series, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EAST + SCALE * radius * east, SCALE * radius * north
