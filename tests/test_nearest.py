"""Nearest places and segments against all pairs, where they lie well and where they do not."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slopeline.operators import joins as J


def told(spark, points, sites, cell):
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    s = spark.createDataFrame(sites, "site long, s_lon double, s_lat double")
    return {r.id: (r.site, r.dist) for r in J.nearest(p, s, key="id", site="site", cell=cell).collect()}


def brute(points, sites):
    return {i: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in sites if a is not None)[::-1] for i, x, y in points if x is not None}


def clouds(rng):
    """Points and sites: spread; sites in one corner far from all points; many at one place; ties on a grid."""
    spread = lambda n, side: [(i, rng.uniform(-side, side), rng.uniform(-side, side)) for i in range(n)]
    yield "spread", spread(300, 5), spread(200, 5)
    yield "corner", spread(300, 5), [(i, 90 + rng.uniform(0, 0.001), 80 + rng.uniform(0, 0.001)) for i in range(500)]
    yield "one place", spread(50, 5), [(i, 1.0, 1.0) for i in range(500)] + [(1000, -3.0, -3.0)]
    yield "ties", [(i, float(i % 7), float(i // 7)) for i in range(49)], [(i, i % 5 + 0.5, i // 5 + 0.5) for i in range(25)]
    yield "far apart", [(0, -170.0, -80.0), (1, 170.0, 80.0), (2, None, 1.0)], [(5, 0.0, 0.0), (6, 1e-7, 0.0), (7, None, None)]


@pytest.mark.parametrize("cell", [0.01, 0.5, 100.0])
def test_nearest_against_all_pairs(spark, cell):
    for name, points, sites in clouds(random.Random(4)):
        got, want = told(spark, points, sites, cell), brute(points, sites)
        assert got.keys() == want.keys(), name
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want), name
    assert told(spark, [(1, 0.0, 0.0)], [], cell) == {} == told(spark, [], [(1, 0.0, 0.0)], cell)


def test_few_cells_are_opened(spark):
    """Points far from all sites, which lie in one corner, open a few cells of sites each."""
    rng = random.Random(6)
    points = spark.createDataFrame([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(400)], "x double, y double")
    sites = spark.createDataFrame([(50 + rng.uniform(0, 1), 50 + rng.uniform(0, 1)) for _ in range(3000)], "x double, y double")
    _, cells = J._candidates(points, sites, 0.05, 0.0)
    opened = [r["count"] for r in cells.groupBy("qx", "qy").count().collect()]
    full = J._levels(sites, 0.05)[1][0].count()
    assert max(opened) < 20 and full > 300


def test_nearest_segment_against_all_pairs(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(150)]
    segments = [tuple(rng.uniform(-3, 3) for _ in range(4)) for _ in range(15)] + [(1.0, 1.0, 1.0, 1.0), (-40.0, -40.0, 40.0, 39.0)]

    def gap(x, y, ux, uy, vx, vy):
        dx, dy = vx - ux, vy - uy
        t = max(0.0, min(1.0, ((x - ux) * dx + (y - uy) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - ux - t * dx, y - uy - t * dy)

    p = spark.createDataFrame(points, "id long, x double, y double")
    s = spark.createDataFrame(segments, "ux double, uy double, vx double, vy double")
    for cell in (0.1, 2.0):
        got = {r.id: r.dist for r in J.nearest_segment(p, s, key="id", cell=cell).collect()}
        assert all(got[i] == pytest.approx(min(gap(x, y, *g) for g in segments), abs=1e-9) for i, x, y in points)
    assert J.nearest_segment(p, s.where(F.lit(False)), key="id", cell=1.0).isEmpty()
