"""Blocks, cut nodes and sampled betweenness against textbook searches on small graphs."""

import random
import sys
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.operators import blocks as B
from slopeline.operators import graph as G
from slopeline.operators import lanes as L
from slopeline.plans import network as N


def search(nodes, edges):
    """(cut nodes with their number of blocks, blocks as sets of nodes) by depth-first search."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    order, low, held, found = {}, {}, [], []

    def visit(v, parent):
        order[v] = low[v] = len(order)
        for w in sorted(near[v]):
            if w not in order:
                held.append((v, w))
                visit(w, v)
                low[v] = min(low[v], low[w])
                if low[w] >= order[v]:
                    block = set()
                    while True:
                        edge = held.pop()
                        block.update(edge)
                        if edge == (v, w):
                            break
                    found.append(frozenset(block))
            elif w != parent and order[w] < order[v]:
                held.append((v, w))
                low[v] = min(low[v], order[w])

    sys.setrecursionlimit(100_000)
    for v in nodes:
        if v not in order:
            visit(v, None)
    count = defaultdict(int)
    for block in found:
        for v in block:
            count[v] += 1
    return {v: n for v, n in count.items() if n > 1}, sorted(map(sorted, found))


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("seed", (1, 3))
def test_blocks_of_random_graphs(spark, seed):
    """Sparse graphs with trees, cycles, parallel edges, loops and nodes of their own."""
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(rng.randrange(36), rng.randrange(36)) for _ in range((20, 34, 45, 70)[seed])]
    edges += edges[:3] + [(b, a) for a, b in edges[3:6]]
    n, e = tables(spark, nodes, edges)
    got = defaultdict(set)
    for r in B.blocks(n, e).collect():
        got[r.block].add(r.node)
    cuts, blocks = search(nodes, edges)
    assert sorted(map(sorted, got.values())) == blocks
    count = defaultdict(int)
    for v in (v for block in got.values() for v in block):
        count[v] += 1
    assert {v: k for v, k in count.items() if k > 1} == cuts


def test_blocks_of_a_path_and_of_no_edges(spark):
    n, e = tables(spark, range(7), [(i, i + 1) for i in range(6)])
    assert {r.node: r.parts for r in B.cut_nodes(n, e).collect()} == {i: 2 for i in range(1, 6)}
    assert B.blocks(n, e.limit(0)).isEmpty()


def test_supply_cut_nodes_by_search(spark):
    sf = "/root/testdata/sf0.001"
    nodes, edges = N._supply(spark, sf)
    want, _ = search([r.node for r in nodes.collect()], [tuple(r) for r in edges.collect()])
    assert {r.node: r.parts for r in N.supply_cut_nodes(spark, sf).collect()} == want


def test_sampled_betweenness(spark):
    rng = random.Random(3)
    n, e = tables(spark, range(30), [(rng.randrange(30), rng.randrange(30)) for _ in range(50)])
    e = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    exact = {r.node: r.score for r in G.betweenness(n, e).collect()}
    whole = {r.node: (r.score, r.error) for r in B.sampled_betweenness(n, e, parts=3).collect()}
    assert all(whole[k][0] == pytest.approx(v, abs=1e-9) and whole[k][1] == 0 for k, v in exact.items())
    half = {r.node: (r.score, r.error) for r in B.sampled_betweenness(n, e, parts=4, used=2).collect()}
    near = sum(abs(half[k][0] - v) <= 3 * half[k][1] + 1e-9 for k, v in exact.items())
    assert half.keys() == exact.keys() and near >= 0.6 * len(exact)  # two parts tell little of their spread
    with pytest.raises(ValueError):
        B.sampled_betweenness(n, e, parts=2, used=3)


def test_estimates_do_not_grow_with_rounds(spark):
    """Loops are planned by what they hold: an estimate that every round multiplies makes planning endless on long ways."""
    nodes, edges = tables(spark, range(9), [(i, i + 1) for i in range(8)])
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    levels = B.forest(nodes, edges)
    assert len(levels) == 9
    assert max(map(size, [G.components(nodes, edges), *levels, *B.numbered(levels)])) < 10**7


def shuffled(spark):
    """Bytes that all tasks so far have written for shuffles."""
    time.sleep(1)
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


@pytest.fixture
def by_shuffles(spark):
    """Small tables join as large ones do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def random_trade(spark):
    rng = random.Random(5)
    return tables(spark, range(3000), [(rng.randrange(1500), 1500 + rng.randrange(1500)) for _ in range(12000)])


def test_cut_nodes_move_edges_few_times(spark, by_shuffles):
    """Every level used to move the whole table of edges: 7.6 MB here, 1.7 MB since levels move their own rows."""
    n, e = random_trade(spark)
    before = shuffled(spark)
    B.cut_nodes(n, e).collect()
    assert shuffled(spark) - before < 3_000_000


@pytest.mark.parametrize("at_once", (0, 500_000))
def test_cut_nodes_by_rounds_and_at_once(spark, monkeypatch, at_once):
    """Graphs with circles of odd length, a star, a path, loops, parallel edges; the rounds and the task that ends them."""
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(99, i) for i in range(50, 60)] + [(i, i + 1) for i in range(60, 66)]
    edges += [(70, 71), (71, 72), (72, 70), (72, 73), (73, 74), (74, 72), (70, 70), (70, 71)]
    nodes = [*range(90), 99]
    n, e = tables(spark, nodes, edges)
    want, _ = search(nodes, edges)
    assert {r.node: r.parts for r in B.cut_nodes(n, e).collect()} == want
    names = e.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    if at_once:
        assert {r.node: r.parts for r in B.cut_nodes(n.select(F.concat(F.lit("n"), "node").alias("node")), names).collect()} == {f"n{k}": v for k, v in want.items()}
    else:
        roots = {r.node: r.root for r in B.gathered(e.where("a <> b")).collect()}
        near = {r.node: r.component for r in G.components(n, e).collect()}
        assert len({(near[k], v) for k, v in roots.items()}) == len({near[k] for k in roots}) == len(set(roots.values()))


def test_supply_cut_nodes_of_keys_too_large_to_number(spark, tmp_path):
    """Keys at the ends of a long, negative ones and missing ones."""
    big = (1 << 63) - 1
    spark.createDataFrame([(big, -5), (2, -5), (3, None), (-4, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(big, 7), (2, 8), (2, -big - 1), (-4, None), (-4, 1)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.node: r.parts for r in N.supply_cut_nodes(spark, str(tmp_path)).collect()}
    assert found == {f"O{big}": 2, "C-5": 2, "O2": 3, "O-4": 2}


def test_sampled_betweenness_moves_an_edge_once_for_all_lanes(spark, by_shuffles):
    """A row for each source and edge used to be moved: 39 MB here, 20 MB since an edge is one row for all sources."""
    n, e = random_trade(spark)
    before = shuffled(spark)
    B.sampled_betweenness(n, e, parts=100, used=2).collect()
    assert shuffled(spark) - before < 28_000_000


def test_sampled_betweenness_in_batches_of_names(spark, monkeypatch):
    """Batches that cut through parts, nodes with names, some without edges, loops and parallel edges; what is dealt by."""
    monkeypatch.setattr(L, "LANES", 7)
    rng = random.Random(4)
    edges = [(rng.randrange(26), rng.randrange(26)) for _ in range(40)]
    n, e = tables(spark, range(30), [*edges, *edges[:5], (3, 3)])
    names = n.select(F.concat(F.lit("n"), "node").alias("node")), e.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    once = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    exact = {f"n{r.node}": r.score for r in G.betweenness(n, once).collect()}
    got = {r.node: (r.score, r.error) for r in B.sampled_betweenness(*names, parts=3).collect()}
    assert got == {k: (pytest.approx(v, abs=1e-9), 0) for k, v in exact.items()}
    half = {r.node: (r.score, r.error) for r in B.sampled_betweenness(*names, parts=4, used=2).collect()}
    dealt = {f"n{r.node}": (r.score, r.error) for r in B.sampled_betweenness(n, e, parts=4, used=2, deal=F.concat(F.lit("n"), "node")).collect()}
    assert dealt == {k: (pytest.approx(s, abs=1e-9), pytest.approx(x, abs=1e-9)) for k, (s, x) in half.items()}


def test_sums_of_a_task_are_put_together_on_the_way(monkeypatch):
    monkeypatch.setattr(L, "NUMBERS", 50)
    rng = random.Random(2)
    for nodes in (10, 100_000):
        sums, want = L._Sums(100), defaultdict(float)
        for _ in range(30):
            rows = [(rng.randrange(nodes), rng.sample(range(100), rng.randrange(8))) for _ in range(9)]
            held = np.array([(lane, 1 + lane) for _, lanes in rows for lane in lanes], L._HELD)
            for node, lanes in rows:
                for lane in lanes:
                    want[node, lane] += 1 + lane
            sums.add(np.array([node for node, _ in rows]), np.array([len(lanes) for _, lanes in rows]), held)
        at, cells, x = sums.total()
        assert {(int(at[c // 100]), int(c % 100)): v for c, v in zip(cells, x.tolist())} == want


def test_supply_betweenness_by_shares(spark):
    """The same sources as ever, and what single searches from them give."""
    sf = "/root/testdata/sf0.001"
    nodes, edges = N._supply(spark, sf)
    parts = max(2, nodes.count() // 32)
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))).where("part < 2")
    each = G.shares(dealt, G.both_ways(edges)).join(dealt.select(F.col("node").alias("s"), "part"), "s").groupBy("node", "part").agg((F.sum("share") / 2).alias("x")).collect()
    got = {r.node: (r.score, r.error) for r in N.supply_betweenness(spark, sf).collect()}
    want = {r.node: [0.0, 0.0] for r in nodes.collect()}
    for r in each:
        want[r.node][r.part] = r.x
    spread = parts * (1 - 2 / parts) ** 0.5 / 2
    assert got == {k: (pytest.approx((a + b) * parts / 2, abs=2e-4), pytest.approx(abs(a - b) * spread, abs=2e-4)) for k, (a, b) in want.items()}
