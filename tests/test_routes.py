"""Goal-directed routes against Dijkstra's search, trends in SQL against least squares."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.operators import graph as G
from slopeline.operators import routes as W
from slopeline.operators import trends as L


def dijkstra(edges, source):
    out = {}
    for u, v, w in edges:
        if None not in (u, v, w):
            out.setdefault(u, []).append((v, w))
    best, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in out.get(u, ()):
            heapq.heappush(heap, (d + w, v))
    return best


def told(spark, pairs, edges, **settings):
    p = spark.createDataFrame(pairs, "source long, target long")
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    return W.goal_routes(p, e, **settings).collect()


def graphs(rng):
    """Directed random edges with parallel ones, loops and nulls; a grid of streets; two parts joined one way; no edge."""
    yield "random", [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 1.0, rng.uniform(0, 9)])) for _ in range(150)] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None), (3, 3, 0.0)], 60
    grid = [(6 * i + j, 6 * x + y, rng.uniform(1, 2)) for i in range(6) for j in range(6) for x, y in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= x < 6 and 0 <= y < 6]
    yield "grid", grid, 36
    ring = [(i, (i + 1) % 8, 1.0) for i in range(8)]
    yield "one way", ring + [(a + 20, b + 20, w) for a, b, w in ring] + [(2, 25, 4.0)], 30
    yield "none", [], 3


def test_routes_against_dijkstra(spark):
    rng = random.Random(12)
    for name, edges, n in graphs(rng):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
        pairs += [pairs[0], (0, 0), (999, 999), (999, 1), (1, 999), (None, 1), (1, None)]
        got = told(spark, pairs, edges)
        assert sorted({(str(s), str(t)) for s, t in pairs}) == sorted((str(r.source), str(r.target)) for r in got), name
        cost = {}
        for u, v, w in edges:
            if None not in (u, v, w):
                cost[u, v] = min(w, cost.get((u, v), math.inf))
        for r in got:
            want = None if None in (r.source, r.target) else dijkstra(edges, r.source).get(r.target)
            assert (r.dist is None) == (want is None) == (r.path is None), (name, r)
            if want is not None:
                assert r.dist == pytest.approx(want, abs=1e-9), (name, r)
                assert r.path[0] == r.source and r.path[-1] == r.target
                assert sum(cost[a, b] for a, b in zip(r.path, r.path[1:])) == pytest.approx(want, abs=1e-9)


def test_search_stays_between_source_and_goal(spark):
    """On a grid of streets landmarks keep most nodes out of the search; all of them give the same lengths."""
    rng = random.Random(3)
    n = 14
    edges = [(n * i + j, n * x + y, rng.uniform(1, 1.3)) for i in range(n) for j in range(n) for x, y in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= x < n and 0 <= y < n]
    corners = spark.createDataFrame([(0, 0), (n - 1, 1), (n * (n - 1), 2), (n * n - 1, 3)], "mark long, place int")
    pairs = [(rng.randrange(n * n), rng.randrange(n * n)) for _ in range(12)]
    got = told(spark, pairs, edges, marks=corners)
    assert np.mean([r.seen for r in got]) < n * n / 4
    assert all(r.dist == pytest.approx(dijkstra(edges, r.source)[r.target]) for r in got)


def meetings(spark, pairs, edges, **settings):
    p = spark.createDataFrame(pairs, "source long, target long")
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    return {(r.source, r.target): r for r in W.meeting_routes(p, e, **settings).collect()}


def test_ends_meet_within_small_surroundings(spark):
    """On a graph of random chords the two ends see few nodes; lengths and ways are those of Dijkstra's search."""
    rng = random.Random(8)
    n = 3000
    one = [(i, rng.randrange(n), float(rng.randint(0, 50))) for i in range(n) for _ in range(3)]
    edges = one + [(b, a, w) for a, b, w in one]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(8)] + [(5, 5), (9999, 9999), (9999, 5), (None, 5)]
    got = meetings(spark, pairs, edges, symmetric=True)
    assert got.keys() == set(pairs) and np.mean([r.seen for r in got.values()]) < n / 4
    cost = {}
    for a, b, w in edges:
        cost[a, b] = min(w, cost.get((a, b), math.inf))
    for (s, t), r in got.items():
        want = None if s is None else dijkstra(edges, s).get(t)
        assert r.dist == want and (r.path is None) == (want is None)
        assert want is None or (r.path[0] == s and r.path[-1] == t and sum(cost[e] for e in zip(r.path, r.path[1:])) == want)


def test_ends_meet_step_by_step_along_directed_edges(spark, monkeypatch):
    """One node of each end goes on in a round at first."""
    monkeypatch.setattr(W, "_STEP", 1)
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice([0.0, 1.0, 7.0])) for _ in range(70)] + [(None, 1, 1.0), (1, 2, None)]
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(15)]
    got = meetings(spark, pairs, edges, unmet=3)
    assert {p: got[p].dist for p in pairs} == {(s, t): dijkstra(edges, s).get(t) for s, t in pairs}


def test_pairs_that_never_meet_are_flooded_once(spark):
    """Two rings apart: the flood ends such pairs after their first steps, and keeps those that hang together."""
    ring = [(i, (i + 1) % 10, 1.0) for i in range(10)]
    edges = ring + [(a + 100, b + 100, w) for a, b, w in ring]
    pairs = [(0, 5), (3, 104), (101, 108), (105, 7)]
    both = edges + [(b, a, w) for a, b, w in edges]
    got = meetings(spark, pairs, both, symmetric=True, unmet=2)
    assert [got[p].dist for p in pairs] == [5.0, None, 3.0, None]
    assert got[3, 104].seen < 10 and got[105, 7].seen < 10 and got[3, 104].path is None


def test_long_ways_can_be_planned(spark):
    """Forty rounds and more: estimates of size must not grow from round to round."""
    e = spark.range(45).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    seeds = spark.createDataFrame([(0, 0, 0.0)], "source long, node long, dist double")
    assert {r.node: r.dist for r in G.shortest(seeds, e).collect()} == {i: float(i) for i in range(46)}


def test_ways_without_water_have_the_same_length(spark):
    """Priced roads give the same times as the search of all nodes does."""
    nodes = spark.range(30).select(F.col("id").alias("node"), (F.col("id") % 7 / 20).alias("depth"), (F.col("id") * 1.5).alias("slope"), (F.col("id") % 11 != 10).alias("passable"))
    edges = spark.range(120).select((F.col("id") % 30).alias("src"), (F.col("id") * 7 % 30).alias("dst"), (5 + F.col("id") % 13).cast("double").alias("base_s"), F.lit(0.0).alias("depth"), F.lit(True).alias("passable"))
    pairs = spark.createDataFrame([(s, t) for s in (1, 4) for t in range(30)], "source long, target long")
    want = {(r.source, r.target): r.eta_s for r in G.budgeted_routes(pairs, nodes, edges).collect()}
    got = {(r.source, r.target): r.dist for r in W.goal_routes(pairs, G.priced_roads(nodes, edges)).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or round(got[k], 2) == want[k]) for k in want)


def test_trends_in_sql(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.uniform(1e6, 1e6 + 9), rng.uniform(-1, 1)) for _ in range(900)]
    rows += [("one", 0.1, float(i)) for i in range(7)] + [("flat", float(i), 0.3) for i in range(5)] + [("void", None, 1.0), ("void", 1.0, None)]
    names = L.register_trends(spark)
    points = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    asked = ", ".join(f"{f}(s) AS {f[6:]}" for f in names if f not in ("trend_states", "trend_merge"))
    got = {r.key: r for r in spark.sql(f"SELECT key, {asked} FROM (SELECT key, trend_merge(state) AS s FROM trend_states(TABLE({{points}})) GROUP BY key)", points=points).collect()}
    assert got.keys() == {"a", "b", None, "one", "flat", "void"}
    for k in ("a", "b", None):
        x, y = np.array([r[1:] for r in rows if r[0] == k]).T
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        assert got[k]["count"] == len(x) and got[k].slope == pytest.approx(slope, rel=1e-6) and got[k].fit == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, rel=1e-6)
    assert (got["one"]["count"], got["one"].slope, got["one"].fit) == (7, None, None)
    assert (got["flat"].slope, got["flat"].fit) == (0.0, 1.0) and got["flat"].intercept == 0.3
    assert (got["void"]["count"], got["void"].slope) == (0, None)
    assert spark.sql("SELECT key FROM trend_states(TABLE({points}))", points=points.limit(0)).count() == 0


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    points = np.zeros((200, 6))
    points[:, 0], points[:, 1:3] = 1, rng.normal(1e5, 1, (200, 2))
    zero = np.zeros(200, np.int64)
    whole = L.merged(zero, points, 1)
    parts = L.merged(rng.integers(0, 9, 200), points, 9)
    assert np.allclose(L.merged(zero[:9], parts, 1), whole, rtol=1e-9)
    assert np.allclose(L.merged(zero[:9], parts[::-1].copy(), 1), whole, rtol=1e-9)
