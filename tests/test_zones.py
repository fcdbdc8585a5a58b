"""Polygon zones, tile trees and the index of road names against brute force."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from slopeline.operators import decisions as D
from slopeline.operators import zones as Z
from slopeline.sources import feeds as X


def inside(rings, x, y):
    """By the number of edges to the left, over all rings."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay <= y) != (by <= y) and x >= ax + (y - ay) * (bx - ax) / (by - ay):
                n += 1
    return n % 2 == 1


def test_pixels_in_polygons(spark):
    rng = random.Random(5)
    shapes = {i: [[(rng.uniform(-5, 15), rng.uniform(-5, 15)) for _ in range(rng.randint(3, 8))]] for i in range(12)}
    shapes[20] = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]]  # a hole, corners on lines of pixels
    shapes[21] = [[(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5), (0.5, 0.5)]]  # closed, corners on middles
    shapes[22] = [[(-300.0, 4.0), (300.0, 4.0), (300.0, 5.1)]]  # long and thin
    shapes[23], shapes[24] = [[(1.0, 1.0), (2.0, 2.0)]], [[]]
    rows = [(i, [{"x": x, "y": y} for x, y in ring]) for i, rings in shapes.items() for ring in rings]
    polygons = spark.createDataFrame(rows + [(30, None)], "zone long, ring array<struct<x:double,y:double>>")
    cells = [(r, c, float(r * 100 + c)) for r in range(-5, 15) for c in range(-80, 90)]
    pixels = spark.createDataFrame(cells, "row long, col long, value double")
    got = {(r.zone, r.row, r.col) for r in Z.pixels_in(polygons, pixels, "zone", 1.0).collect()}
    want = {(i, r, c) for i, rings in shapes.items() if len(rings[0]) > 2 for r, c, _ in cells if inside(rings, c + 0.5, r + 0.5)}
    assert got == want
    told = {r.zone: (r.n, r.total) for r in Z.zonal(polygons, pixels, "zone", 1.0, total=F.sum("value")).collect()}
    assert told.keys() == {*shapes, 30} and told[30] == told[23] == told[24] == (0, None)
    value = {(r, c): v for r, c, v in cells}
    assert all(told[i] == (len(own := [value[k[1:]] for k in want if k[0] == i]), pytest.approx(sum(own)) if own else None) for i in shapes)


def test_tile_tree(spark):
    rng = random.Random(6)
    points = [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(150)] + [(0.01, 0.01)] * 40 + [(2.9 + rng.uniform(0, 0.05), 0.3) for _ in range(60)] + [(3.0, 1.0), (-0.1, 1.0), (1.0, 1.0), (1.5, 1.25)]
    most, found = 12, collections.Counter()

    def split(label, w, s, e, n, own, depth):
        if len(own) <= most or depth == 3:
            if own:
                found[label] = len(own)
            return
        x, y = (w + e) / 2, (s + n) / 2
        for i, (a, b, c, d) in enumerate(((w, s, x, y), (x, s, e, y), (w, y, x, n), (x, y, e, n))):
            split(f"{label}-{i}", a, b, c, d, [(p, q) for p, q in own if a <= p < c and b <= q < d], depth + 1)

    for r in range(3):
        for c in range(3):
            split(f"{r}-{c}", float(c), float(r), c + 1.0, r + 1.0, [(p, q) for p, q in points if c <= p < c + 1 and r <= q < r + 1], 0)
    table = spark.createDataFrame(points, "lon double, lat double")
    got = {r.label: r.n for r in X.tile_tree(table, (0.0, 0.0, 3.0, 3.0), most=most).collect()}
    assert got == dict(found) and max(got.values()) > most > 1  # the crowd at one place stays together
    assert X.tile_tree(table.limit(0), (0.0, 0.0, 3.0, 3.0), most=1).isEmpty()


def test_lead_times_by_comparing_all_names(spark):
    rng = random.Random(7)
    t0 = datetime.datetime(2024, 1, 1)
    word = lambda n: "".join(rng.choice("abAB -") for _ in range(n))
    predicted = [(t0 + datetime.timedelta(hours=rng.randrange(50)), i, rng.choice([None, "", word(rng.randint(1, 9))]), rng.random() < 0.7) for i in range(200)]
    roads = [word(n) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 12)] + ["", "zz", None, "AB"]
    actual = [(r, t0 + datetime.timedelta(hours=20 + i)) for i, r in enumerate(roads)]
    p = spark.createDataFrame(predicted, "t timestamp_ntz, edge_id long, name string, severed boolean")
    got = {(r.road, r.t): (r.predicted_t, r.edge_id) for r in D.lead_times(p, spark.createDataFrame(actual, "road string, t timestamp_ntz")).collect()}
    for road, t in actual:
        hits = [(pt, e) for pt, e, name, severed in predicted if severed and name and road is not None and road.lower() in name.lower()]
        assert got[road, t] == min(hits, default=(None, None))
    assert len(got) == len(actual)
