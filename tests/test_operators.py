"""Operators on tiny inputs with results worked out by hand or by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from slopeline.functions import risk as R
from slopeline.operators import blocks as B
from slopeline.operators import graph as G
from slopeline.operators import joins as J
from slopeline.operators import state as S
from slopeline.operators import windows as W
from slopeline.streaming.processors import next_stage


def test_bottleneck_prefers_the_detour(spark):
    edges = spark.createDataFrame([("v", "hq", 0.9), ("v", "mid", 0.2), ("mid", "hq", 0.3)], "a string, b string, w double")
    best = G.bottleneck(spark.createDataFrame([("v", "v", 0.0)], "source string, node string, dist double"), G.both_ways(edges, "w"))
    assert {r.node: r.dist for r in best.collect()} == {"v": 0.0, "mid": 0.2, "hq": 0.3}


def test_shortest_path_and_way(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a long, b long, w double")
    best = G.shortest(spark.createDataFrame([(1, 1, 0.0)], "source long, node long, dist double"), G.both_ways(edges, "w"))
    assert {r.node: r.dist for r in best.collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    assert {r.node: r.path for r in G.path_of(best).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3]}


def test_shortest_parallel_edge_wins_even_if_severed(spark):
    edges = spark.createDataFrame([(1, 2, "x", 5.0, True), (2, 1, "y", 9.0, False), (3, 3, "loop", 1.0, False)], "u long, v long, edge_id string, length double, severed boolean")
    assert [tuple(r) for r in G.simple_edges(edges).collect()] == [(1, 2, "x", 5.0, True)]


def test_graph_measures_against_brute_force(spark):
    rng = random.Random(3)
    nodes = list(range(9))
    links = {(a, b) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.25}
    n = spark.createDataFrame([(i,) for i in nodes], "node long")
    e = spark.createDataFrame(sorted(links), "a long, b long")
    near = {i: {b if a == i else a for a, b in links if i in (a, b)} for i in nodes}

    def parts(lost):
        left, count = set(near[lost]), 0
        while left:
            todo = [left.pop()]
            count += 1
            seen = {lost, *todo}
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            left -= seen
        return count

    assert {r.node: r.parts for r in B.cut_nodes(n, e).collect()} == {i: parts(i) for i in nodes if parts(i) > 1}

    def ways(s, t):
        front = [[s]]
        while front:
            hit = [p for p in front if p[-1] == t]
            if hit:
                return hit
            front = [p + [x] for p in front for x in near[p[-1]] if x not in p]
        return []

    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        w = ways(s, t)
        for p in w:
            for x in p[1:-1]:
                score[x] += 1 / len(w)
    got = {r.node: r.score for r in G.betweenness(n, e).collect()}
    assert got == pytest.approx(score)
    label = {r.node: r.component for r in G.components(n, e).collect()}
    assert all((label[s] == label[t]) == bool(ways(s, t)) for s, t in itertools.combinations(nodes, 2))


def test_cascade_counts_fewest_hops_then_likelihood(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "d", 0.8), ("d", "c", 0.9), ("c", "a", 1.0)], "src string, dst string, p double")
    got = {r.asset: (r.hop, round(r.probability, 3), r.path) for r in G.cascade(spark.createDataFrame([("a",)], "node string"), edges).collect()}
    assert got == {"b": (1, 0.9, ["a", "b"]), "d": (1, 0.8, ["a", "d"]), "c": (2, 0.72, ["a", "d", "c"])}


def test_thresholds(spark):
    one = spark.range(1)
    ratio = R.exceedance_ratio({1: F.lit(5.8294), 6: F.lit(0.0), 24: F.lit(0.0), 72: F.lit(0.0)})
    deep = R.exceedance_ratio({1: F.lit(0.0), 6: F.lit(0.0), 24: F.lit(0.0), 72: F.lit(100.0)})
    r = one.select(ratio.alias("a"), deep.alias("b"), R.ed_threshold(F.lit(24.0)).alias("c"), R.ed_threshold(F.lit(72.0)).alias("d")).first()
    assert r.a == pytest.approx(1.0) and r.b == pytest.approx(100 / 33.54) and r.c is None and r.d == pytest.approx(33.54)


def test_hysteresis(spark):
    ps = [0.1, 0.8, 0.7, 0.6, 0.2]
    rows = spark.createDataFrame([("x", i, p) for i, p in enumerate(ps)], "k string, t int, p double")
    got = [(r.from_stage, r.to_stage) for r in S.escalations(rows, "k", "p", "t").orderBy("seq").collect()]
    assert got == [("GREEN", "RED"), ("RED", "ORANGE"), ("ORANGE", "GREEN")]
    stage, seen = 0, []
    for p in ps:
        stage = next_stage(stage, p)
        seen.append(stage)
    assert seen == [0, 3, 3, 2, 0]
    with pytest.raises(Exception, match="outside"):
        S.escalations(spark.createDataFrame([("x", 0, 1.5)], "k string, t int, p double"), "k", "p", "t").collect()


def test_rejected_calls_do_not_count(spark):
    calls = spark.createDataFrame([("c", float(t)) for t in (0, 1, 2, 3, 61, 62)], "k string, at double")
    got = [(r.allowed, r.retry_after) for r in S.rate_limited(calls, "k", "at", 2, 60.0).orderBy("seq").collect()]
    assert got == [(True, 0.0), (True, 0.0), (False, 58.0), (False, 57.0), (True, 0.0), (True, 0.0)]


def test_breaker(spark):
    rows = spark.createDataFrame([("k", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, False), (3, True), (303, False), (304, True), (700, True)])], "k string, n int, at double, ok boolean")
    assert [r.state for r in S.circuit(rows, "k", "n").orderBy("seq").collect()] == ["CLOSED", "CLOSED", "OPEN", "OPEN", "OPEN", "OPEN", "CLOSED"]


def test_window_brackets_the_crossing(spark):
    rows = spark.sql("SELECT 'a' AS k, timestamp_ntz '2026-05-27 00:00:00' + make_interval(0, 0, 0, 0, id) AS t, (id + 1) / 10.0D AS y FROM range(4)")
    r = W.safe_window(W.trend(rows, "k", "t", "y")).first()
    assert r.basis == "projected" and r.lo_h < 6 < r.hi_h
    flat = W.trend(spark.sql("SELECT 'a' AS k, timestamp_ntz '2026-05-27 00:00:00' + make_interval(0, 0, 0, 0, id) AS t, 0.2D AS y FROM range(4)"), "k", "t", "y").first()
    assert flat.r2 == 0.0


def test_hyetograph_keeps_the_total(spark):
    rows = spark.createDataFrame([("s", 30.0, 7, 1)], "storm string, total_mm double, n_steps int, peak int")
    got = [r.mm for r in W.hyetograph(rows).orderBy("step").collect()]
    assert sum(got) == pytest.approx(30.0) and max(got) == got[1] and sorted(got[2:], reverse=True) == got[2:]


def test_runout_at_equal_angles(spark):
    t = spark.range(1).select(R.runout_triangle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(0.9), 45.0, 45.0).alias("t")).first().t
    assert [round(x, 6) for x in t] == [0, 0, 100, 100, -100, 100]  # the first corner lies clockwise of the way down


def test_nearest_and_within_agree_with_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(92, 93), rng.uniform(23, 24)) for i in range(60)]
    sts = [(i, rng.uniform(92, 93), rng.uniform(23, 24)) for i in range(15)]
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    s = spark.createDataFrame(sts, "sid long, s_lon double, s_lat double")
    got = {r.id: r.sid for r in J.nearest(p, s, key="id", site="sid", cell=0.01).collect()}
    assert got == {i: min(sts, key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]))[0] for i, x, y in pts}
    near = J.within_km(p, s.select("sid", F.col("s_lat").alias("r_lat"), F.col("s_lon").alias("r_lon")), 20.0).count()
    every = p.crossJoin(s).where(J.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= 20.0).count()
    assert near == every > 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    seeds = spark.createDataFrame([(1, 1, 0.0)], "source long, node long, dist double")
    assert G.shortest(seeds, G.both_ways(none, "w")).count() == 1
    assert S.escalations(spark.createDataFrame([], "k string, t int, p double"), "k", "p", "t").count() == 0
