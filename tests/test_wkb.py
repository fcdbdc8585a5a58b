"""Geometries in well-known binary: exact numbers, both byte orders, area and centroid."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from slopeline.functions import wkb as W


def point(x, y, order="<"):
    return struct.pack(order + "BIdd", order == "<", 1, x, y)


def line(points, order="<"):
    return struct.pack(order + "BII", order == "<", 2, len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)


def polygon(rings, order="<"):
    return struct.pack(order + "BII", order == "<", 3, len(rings)) + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)


def frame(spark, geometries):
    return spark.createDataFrame([(i, g) for i, g in enumerate(geometries)], "id long, g binary")


def test_numbers_come_back_exactly(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.0, -1.5, 92.7, 23.6, 5e-324, -2.5e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.pi, -1e-7, 123456.789] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(200)]
    numbers = [x for x in numbers if math.isfinite(x)]
    geometries = [point(x, -x, order) for x in numbers for order in "<>"]
    got = frame(spark, geometries).select("id", W.point(F.col("g")).alias("p"), W.line(F.col("g")).alias("l")).orderBy("id").collect()
    want = [x for x in numbers for _ in "<>"]
    assert [(r.p.x, r.p.y) for r in got] == [(x, -x) for x in want] and all(r.l is None for r in got)
    assert frame(spark, [point(math.nan, math.inf)]).select(W.point(F.col("g")).alias("p")).first().p == (None, None)


def test_lines_and_polygons(spark):
    rng = random.Random(2)
    some = lambda n: [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n)]
    lines = [[], some(1), some(2), some(50)]
    shapes = [[], [some(3)], [some(5), some(4), some(7)], [[]]]
    geometries = [line(p, o) for p in lines for o in "<>"] + [polygon(r, o) for r in shapes for o in "<>"]
    got = frame(spark, geometries).select("id", W.kind(F.col("g")).alias("k"), W.line(F.col("g")).alias("l"), W.rings(F.col("g")).alias("r")).orderBy("id").collect()
    assert [[tuple(p) for p in r.l] for r in got[:8]] == [p for p in lines for _ in "<>"] and all(r.r is None and r.k == 2 for r in got[:8])
    assert [[[tuple(p) for p in ring] for ring in r.r] for r in got[8:]] == [s for s in shapes for _ in "<>"] and all(r.l is None and r.k == 3 for r in got[8:])
    far = frame(spark, [line([(0.0, 0.0), (3.0, 4.0), (3.0, 5.0)]), line([(1.0, 1.0)]), None]).select("id", W.length(W.line(F.col("g"))).alias("n")).orderBy("id").collect()
    assert [r.n for r in far] == [6.0, 0.0, None]


def test_area_and_centroid(spark):
    square = [(100.0, 50.0), (110.0, 50.0), (110.0, 60.0), (100.0, 60.0), (100.0, 50.0)]
    hole = [(102.0, 52.0), (104.0, 52.0), (104.0, 54.0), (102.0, 54.0), (102.0, 52.0)]
    cases = [[square], [square[::-1]], [square, hole], [square, hole[::-1]], [[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]], [[(0.0, 0.0), (1.0, 1.0)]], []]
    got = frame(spark, [polygon(c) for c in cases]).select("id", W.area_and_centroid(W.rings(F.col("g"))).alias("c")).orderBy("id").collect()
    holed = (96.0, (100 * 105 - 4 * 103) / 96, (100 * 55 - 4 * 53) / 96)
    want = [(100.0, 105.0, 55.0), (100.0, 105.0, 55.0), holed, holed, (4.5, 1.0, 1.0), None, None]
    for r, w in zip(got, want):
        assert (r.c is None) if w is None else tuple(r.c) == pytest.approx(w, rel=1e-12)
