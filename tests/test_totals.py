"""Sums within a distance against every pair."""

import math
import random

from pyspark.sql import functions as F

from slopeline.operators import joins as J
from slopeline.sources import feeds as X
from slopeline.streaming.processors import _km


def test_totals_equal_every_pair(spark):
    """A crowd, places across the date line and near a pole, shared places, missing places."""
    rnd = random.Random(5)
    crowd = lambda n: [(23.6 + rnd.random() / 4, 92.6 + rnd.random() / 4) for _ in range(n)]
    edge = lambda n: [(rnd.uniform(-0.1, 0.1), rnd.choice((179.95, -179.95, 180.02)) + rnd.uniform(-0.04, 0.04)) for _ in range(n)]
    pole = lambda n: [(90 - rnd.random() / 20, rnd.uniform(-180, 180)) for _ in range(n)]
    left = crowd(60) + edge(20) + pole(20)
    right = crowd(500) + edge(60) + pole(60)
    right += right[::9]
    values = [rnd.randrange(100) for _ in right]
    want = {}
    for a in left:
        near = [v for b, v in zip(right, values) if _km(*a, *b) <= 5.0]
        if near:
            want[a] = (len(near), sum(near))
    places = spark.createDataFrame([*left, left[0], (None, 1.0)], "lat double, lon double")
    things = spark.createDataFrame([(*b, v) for b, v in zip(right, values)] + [(None, None, 1)], "r_lat double, r_lon double, v long")
    got = J.totals_within(places, things, 5.0, "v").collect()
    assert len(got) == len(want) and {(r.lat, r.lon): (r.n, r.v) for r in got} == want


def test_density_of_places_that_share_a_point(spark):
    places = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 50.0, 20.0), (4, None, 20.0)], "place_id long, lat double, lon double")
    pixels = spark.createDataFrame([(10.0, 20.0, 4.0), (10.001, 20.0, 2.0), (10.0, 20.0, None), (10.5, 20.0, 9.0)], "lat double, lon double, value double")
    got = {r.place_id: r.value for r in X.buffered_density(places, pixels, 1.5).select("place_id", F.round("value", 6).alias("value")).collect()}
    full = round(3.0 * math.pi * 1.5 * 1.5, 6)
    assert got == {1: full, 2: full, 3: 0.0, 4: 0.0}
