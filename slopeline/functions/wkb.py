"""Well-known-binary geometries as column expressions: points, lines and polygons of either byte order.

Numbers are put together from the bytes: a double is its sign, exponent and fraction, which is exact.
A header is the byte order (1) and the kind (4 bytes, of which the flags of further dimensions are not
supported); a line holds its number of points, a polygon its number of rings before those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of geometries in the format.
POINT, LINE, POLYGON = 1, 2, 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in it more than once, so that the expression doesn't grow with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hex(data: Column, at: Column, n: int) -> Column:
    """The ``n`` bytes from ``at`` (from 0) on in hexadecimal, most significant first."""
    little = F.substring(data, F.lit(1), F.lit(1)) == F.unhex(F.lit("01"))
    turned = lambda text: F.concat(*[F.substring(text, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(n))])
    return _let(F.hex(F.substring(data, at + 1, F.lit(n))), lambda text: F.when(little, turned(text)).otherwise(text))


def _long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def integer_at(data: Column, at: Column) -> Column:
    """An unsigned 32-bit number."""
    return _long(_hex(data, at, 4))


def double_at(data: Column, at: Column) -> Column:
    """A 64-bit IEEE number; null for infinities and NaN, which are no places."""
    whole = lambda e, fraction: (1 + fraction / float(2**52)) * F.pow(F.lit(2.0), F.greatest(e - 1023, F.lit(-1022)))
    size = lambda e, fraction: F.when(e == 0, fraction * float(2.0**-1074)).when(e < 2047, whole(e, fraction))
    parts = _let(_hex(data, at, 8), lambda t: F.struct(_long(F.substring(t, F.lit(1), F.lit(3))).alias("high"), _long(F.substring(t, F.lit(4), F.lit(13))).cast("double").alias("low")))
    return _let(parts, lambda v: size(v["high"] % 2048, v["low"]) * F.when(v["high"] >= 2048, -1.0).otherwise(1.0))


def kind(data: Column) -> Column:
    return integer_at(data, F.lit(1))


def _points(data: Column, at: Column, n: Column) -> Column:
    """``n`` points (x, y) from ``at`` on."""
    each = F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    found = F.transform(each, lambda i: F.struct(double_at(data, at + 16 * i).alias("x"), double_at(data, at + 16 * i + 8).alias("y")))
    return F.when(n > 0, found).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def point(data: Column) -> Column:
    """(x, y) of a point; null for other kinds."""
    return F.when(kind(data) == POINT, F.struct(double_at(data, F.lit(5)).alias("x"), double_at(data, F.lit(13)).alias("y")))


def line(data: Column) -> Column:
    """The points of a line; null for other kinds."""
    return F.when(kind(data) == LINE, _points(data, F.lit(9), integer_at(data, F.lit(5))))


def rings(data: Column) -> Column:
    """The rings of a polygon, each an array of points, the outer one first; null for other kinds."""
    n = integer_at(data, F.lit(5))
    # Where each ring begins follows from the number of points of those before it.
    start = F.struct(F.lit(9).cast("long").alias("at"), F.array().cast("array<bigint>").alias("begins"))
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), start, lambda a, i: F.struct((a["at"] + 4 + 16 * integer_at(data, a["at"])).alias("at"), F.concat(a["begins"], F.array(a["at"])).alias("begins"))
    )
    found = F.transform(walked["begins"], lambda at: _points(data, at + 4, integer_at(data, at)))
    return F.when((kind(data) == POLYGON) & (n > 0), found).when(kind(data) == POLYGON, F.array().cast("array<array<struct<x:double,y:double>>>"))


def _sums(ring: Column) -> Column:
    """(a, x, y): twice the signed area of a ring and the moments of its centroid, from its first point."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    each = F.zip_with(ring, after, lambda p, q: F.struct((p["x"] - x0).alias("px"), (p["y"] - y0).alias("py"), (q["x"] - x0).alias("qx"), (q["y"] - y0).alias("qy")))
    cross = lambda e: e["px"] * e["qy"] - e["qx"] * e["py"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(each, zero, lambda s, e: F.struct((s["a"] + cross(e)).alias("a"), (s["x"] + cross(e) * (e["px"] + e["qx"])).alias("x"), (s["y"] + cross(e) * (e["py"] + e["qy"])).alias("y")))
    return _let(total, lambda t: F.struct(t["a"].alias("a"), (t["x"] + 3 * x0 * t["a"]).alias("x"), (t["y"] + 3 * y0 * t["a"]).alias("y")))


def area_and_centroid(polygon: Column) -> Column:
    """(area, x, y) of rings as ``rings`` gives them: holes are taken off whichever way they run; null
    without an area."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("i"))

    def add(s: Column, ring: Column) -> Column:
        sign = lambda one: F.when(s["i"] == 0, 1.0).otherwise(-1.0) * F.when(one["a"] < 0, -1.0).otherwise(1.0)
        return _let(_sums(ring), lambda one: F.struct((s["a"] + sign(one) * one["a"]).alias("a"), (s["x"] + sign(one) * one["x"]).alias("x"), (s["y"] + sign(one) * one["y"]).alias("y"), (s["i"] + 1).alias("i")))

    total = F.aggregate(F.filter(polygon, lambda r: F.size(r) > 2), zero, add)
    return _let(total, lambda t: F.when(t["a"] != 0, F.struct((t["a"] / 2).alias("area"), (t["x"] / (3 * t["a"])).alias("x"), (t["y"] / (3 * t["a"])).alias("y"))))


def length(points: Column) -> Column:
    """The length of a line, 0 for a single point."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)
