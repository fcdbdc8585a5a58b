"""Column functions of distance, grids and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.EARTH_KM) -> Column:
    """Great-circle distance in the radius' unit, by the form that is stable at short range."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def inside(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def km_cells(km: float, max_abs_lat: float) -> tuple[float, float]:
    """Sizes in degrees (lat, lon) of cells that are at least ``km`` wide up to a latitude."""
    lat = math.degrees(km / C.EARTH_KM) * 1.001
    return lat, lat / max(0.01, math.cos(math.radians(max_abs_lat)))


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the slippy-map tile, kept inside the map."""
    n = 1 << zoom
    keep = lambda c: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c))).cast("long")
    merc = F.asinh(F.tan(F.radians(lat))) / math.pi
    return keep((lon + 180.0) / 360.0 * n), keep((1.0 - merc) / 2.0 * n)


def snap_key(lon: Column, lat: Column, step: float) -> Column:
    """Name of the nearest grid node, halves to even."""
    snap = lambda c: F.bround(c / step) * step
    return F.format_string("%.2f_%.2f", snap(lon), snap(lat))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a straight segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    return F.sqrt(F.pow(px - ax - t * dx, F.lit(2)) + F.pow(py - ay - t * dy, F.lit(2)))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive left of the line from a to b, negative right of it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segment_meets_triangle(seg: tuple[Column, ...], tri: Column) -> Column:
    """Whether a segment (ux, uy, vx, vy) touches a triangle: by separating axes.

    Two convex shapes are apart exactly if a line along one of their sides has them on its two sides.
    """
    ux, uy, vx, vy = seg
    corner = [(tri[a], tri[b]) for a, b in (("ax", "ay"), ("lx", "ly"), ("rx", "ry"))]
    apart = F.lit(False)
    for i in range(3):
        (px, py), (qx, qy), (rx, ry) = corner[i], corner[(i + 1) % 3], corner[(i + 2) % 3]
        own, one, two = side(px, py, qx, qy, rx, ry), side(px, py, qx, qy, ux, uy), side(px, py, qx, qy, vx, vy)
        apart = apart | ((own > 0) & (one < 0) & (two < 0)) | ((own < 0) & (one > 0) & (two > 0))
    a, b, c = (side(ux, uy, vx, vy, x, y) for x, y in corner)
    return ~(apart | ((a > 0) & (b > 0) & (c > 0)) | ((a < 0) & (b < 0) & (c < 0)))
