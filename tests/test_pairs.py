"""Pairs of one table within a distance, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slopeline import config as C
from slopeline.operators import joins as J


def km(a, b):
    rad = math.radians
    h = math.sin(rad(b[1] - a[1]) / 2) ** 2 + math.cos(rad(a[1])) * math.cos(rad(b[1])) * math.sin(rad(b[2] - a[2]) / 2) ** 2
    return 2 * C.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def places(lat, lon, spread, n=120):
    rng = random.Random(f"{lat} {lon}")
    return [(i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), lon + rng.uniform(-spread, spread)) for i in range(n)]


@pytest.mark.parametrize("lat, lon", [(0.0, 0.0), (23.7, 92.7), (-70.0, 180.0), (89.9, 10.0), (-90.0, -179.9), (85.0, 179.95)])
@pytest.mark.parametrize("reach", [4.0, 60.0])
def test_pairs_are_those_of_brute_force(spark, lat, lon, reach):
    rows = places(lat, lon, 0.4)
    rows += [(200 + i, *rows[i][1:]) for i in range(5)] + [(300, None, 1.0)]  # copies of places, and none
    rows = [(i, a, (b + 180) % 360 - 180 if i % 2 else b) for i, a, b in rows]  # both ways to write a longitude
    got = sorted((r.id, r.other_id) for r in J.pairs_within_km(spark.createDataFrame(rows, "id long, lat double, lon double"), "id", reach).collect())
    told = [r for r in rows if r[1] is not None]
    want = sorted((a[0], b[0]) for a in told for b in told if a[0] < b[0] and km(a, b) <= reach)
    assert got == want


def test_dense_places_are_dealt_to_all_tasks(spark):
    """Before, cells were as wide as the distance: all that lies within one was a single task's work."""
    rng = random.Random(1)
    rows = [(i, 23.7 + rng.uniform(0, 0.03), 92.7 + rng.uniform(0, 0.03)) for i in range(300)]
    pairs = J.pairs_within_km(spark.createDataFrame(rows, "id long, lat double, lon double"), "id", 4.0)
    load = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(load) == 4 and max(load) < sum(load) * 0.6
