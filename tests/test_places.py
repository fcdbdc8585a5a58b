"""Joins of reports by place: against brute force, and where many rows share a place."""

import datetime
import math
import random
import time

import pytest

from slopeline.operators import joins as J

DAY0 = datetime.datetime(2024, 1, 1)
COLUMNS = "id long, category string, status string, lat double, lon double, t timestamp_ntz"


def km_of(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def reports(n=500, seed=3):
    """Few places, times on the hour so that many are equal, some exactly as far apart as is asked for."""
    rng = random.Random(seed)
    places = [(23.6 + rng.randrange(30) / 1000, 92.6 + rng.randrange(30) / 1000) for _ in range(25)]
    return [(i, rng.choice("ab"), rng.choice(["open", "open", "actioned", "dismissed"]), *rng.choice(places), DAY0 + datetime.timedelta(hours=rng.randrange(24 * 14))) for i in rng.sample(range(10 * n), n)]


def crowd(n=60000):
    """Reports of one place and category, a second apart."""
    return [(i, "a", "open", 23.7, 92.7, DAY0 + datetime.timedelta(seconds=i)) for i in range(n)]


def test_duplicates_by_brute_force(spark):
    rows = reports()
    want = {}
    for i, c, _, la, lo, t in rows:
        near = [(km_of((la, lo), (lb, lp)), j) for j, d, s, lb, lp, u in rows if d == c and s == "open" and (u, j) < (t, i) and t - u <= datetime.timedelta(hours=72)]
        if near := [x for x in near if x[0] <= 0.25]:
            want[i] = min(near)[1]
    got = {r.id: r.duplicate_of for r in J.duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want and len(want) > 50


def test_duplicates_of_a_crowd_are_not_paired(spark):
    """1.8 billion pairs, which no query should look at."""
    rows = spark.createDataFrame(crowd(), COLUMNS)
    began = time.time()
    got = J.duplicates(rows).agg({"id": "count", "duplicate_of": "max", "km_apart": "max"}).first()
    assert sorted(map(float, got)) == [0.0, 0.0, 59999.0] and time.time() - began < 40


def test_hotspots_by_brute_force(spark):
    rows, week = reports(), datetime.timedelta(days=7)
    want = {i: 1 + sum(u < t and t - u <= week and km_of((la, lo), (lb, lp)) <= 2.0 for _, _, _, lb, lp, u in rows) for i, _, _, la, lo, t in rows}
    assert {r.id: r.hotspot_count for r in J.hotspots(spark.createDataFrame(rows, COLUMNS)).collect()} == want


def test_hotspots_of_a_crowd_run_once(spark):
    """A window that begins anew for each row would add up 1.8 billion counts."""
    rows = spark.createDataFrame(crowd(200000), COLUMNS)
    began = time.time()
    got = J.hotspots(rows).agg({"hotspot_count": "sum", "id": "count"}).first()
    assert set(got) == {200000 * 200001 // 2, 200000} and time.time() - began < 40


@pytest.mark.parametrize("km", [0.5, 40.0])
def test_nearest_places_by_brute_force(spark, km):
    """Crowded and lonely sites, several at one place, ties kept."""
    rng = random.Random(8)
    sites = [(23.7 + rng.random() / 1000, 92.7 + rng.random() / 1000) for _ in range(300)] + [(23.6, 92.5), (23.6, 92.7), (23.6, 92.7), (None, 92.6)]
    points = [(23.5 + rng.random() / 2, 92.5 + rng.random() / 2) for _ in range(150)] + [(23.6, 92.6), sites[0], sites[0], (None, 1.0)]
    want = set()
    for p in {p for p in points if p[0]}:
        near = {s: km_of(p, s) for s in sites if s[0]}
        least = min(near.values())
        want |= {(*p, *s) for s, d in near.items() if d <= km and d <= least + 1e-12}
    found = J.nearest_places(spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(sites, "r_lat double, r_lon double"), km)
    assert {(r.lat, r.lon, r.r_lat, r.r_lon) for r in found.collect()} == want


def test_outside_events_by_brute_force(spark):
    rows = [(i, la, lo, t, c) for i, c, _, la, lo, t in reports()]
    rng = random.Random(5)
    events = [(la if rng.random() < 0.5 else None, lo, t + datetime.timedelta(days=rng.choice([-9, 0, 8]), seconds=rng.choice([-1, 0, 1])), rng.choice("xb")) for _, la, lo, t, _ in rng.sample(rows, 12)]
    reached = lambda t, u: abs((t - u).total_seconds()) // 86400 <= 2
    want = {i for i, la, lo, t, c in rows if not any(reached(t, u) and (km_of((la, lo), (lb, lp)) <= 1.0 if lb else c == s) for lb, lp, u, s in events)}
    got = J.outside_events(spark.createDataFrame(rows, "id long, lat double, lon double, t timestamp_ntz, state string"), spark.createDataFrame(events, "e_lat double, e_lon double, e_t timestamp_ntz, e_state string"), km=1.0, days=2)
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(rows)


def test_outside_events_of_a_crowd_are_not_paired(spark):
    rows = spark.createDataFrame(crowd(), COLUMNS).selectExpr("id", "lat", "lon", "t", "category AS state")
    events = rows.selectExpr("CASE WHEN id % 2 = 0 THEN lat END AS e_lat", "lon AS e_lon", "t AS e_t", "state AS e_state")
    began = time.time()
    assert J.outside_events(rows, events).isEmpty() and time.time() - began < 40
