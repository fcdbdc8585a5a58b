"""Road network and infrastructure graphs: paths, isolation, cascades, choke points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import risk as R
from ..operators import blocks as B
from ..operators import graph as G
from ..operators import routes as W
from ..session import cut, written
from ..sources import tables as T


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.simple_edges(T.roads(spark, sf_dir)).withColumn("severed", F.col("p_blocked") >= F.when(F.col("is_bridge"), C.P_CRIT_BRIDGE).otherwise(C.P_CRIT_ROAD))


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads that are not severed, with their risk-weighted cost; a severed shortest road isn't replaced by a longer one."""
    return _simple(spark, sf_dir).where("NOT severed").withColumn("w", F.col("length") * (1 + C.ROUTE_ALPHA * F.col("p_blocked")))


def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _simple(spark, sf_dir)
    return s.select("a", "b", "edge_id", F.round("length", 5).alias("length"), "p_blocked", "severed", F.round(R.clearance_hours(F.col("class"), F.col("is_bridge"), F.col("p_blocked")), 5).alias("hours"))


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least risk-weighted cost between all nations over open roads."""
    seeds = _nodes(spark, sf_dir).select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.shortest(seeds, G.both_ways(_open(spark, sf_dir), "w"))
    return best.select("source", "node", F.round("dist", 3).alias("cost"))


def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ways from nation 0, node by node, and the minutes they take on foot."""
    seeds = _nodes(spark, sf_dir).where("node = 0").select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.shortest(seeds, G.both_ways(_open(spark, sf_dir), "w"))
    paths = G.path_of(best).join(best.select("source", "node", "dist"), ["source", "node"])
    return paths.select("node", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), R.walk_minutes(F.floor("dist")).alias("minutes"))


def minimax_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all nations, the least possible worst blockage on the way; 1 where there is no way."""
    n = _nodes(spark, sf_dir)
    seeds = n.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.bottleneck(seeds, G.both_ways(_simple(spark, sf_dir).withColumn("w", F.col("p_blocked")), "w"))
    pairs = n.select(F.col("node").alias("source")).join(n, how="cross")  # the result is a row per pair of nations
    return pairs.join(best, ["source", "node"], "left").select("source", "node", F.coalesce("dist", F.lit(1.0)).alias("p_blocked"))


def road_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_nodes(spark, sf_dir), _open(spark, sf_dir))


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation: the least bottleneck to a target, whether a severed road lies on its usual way
    (by length, severed roads included) to every target, and whether open roads lead to one anyway.

    Targets are the first nations of each region. The fixpoints run from the targets backwards.
    """
    targets = T.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("node")).select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    n, e = _nodes(spark, sf_dir), cut(_simple(spark, sf_dir))
    worst = G.bottleneck(targets, G.both_ways(e.withColumn("w", F.col("p_blocked")), "w")).groupBy("node").agg(F.min("dist").alias("p"))
    usual = G.relax(targets, G.both_ways(e.withColumns({"w": F.col("length"), "cuts": F.col("severed").cast("int")}), "w", "cuts"), F.col("dist") + F.col("w"), carry=("cuts",))
    free = usual.groupBy("node").agg(F.bool_or(F.col("cuts") == 0).alias("free"))
    reach = G.components(n, e.where("NOT severed")).alias("c")
    safe = targets.select("node").join(reach, "node").select("component").distinct().withColumn("reached", F.lit(True))
    out = n.join(worst, "node", "left").join(free, "node", "left").join(reach, "node").join(safe, "component", "left")
    cut_off = ~F.coalesce("free", F.lit(False))
    return out.select("node", F.coalesce("p", F.lit(1.0)).alias("p_isolated"), cut_off.alias("isolated_now"), (~cut_off | F.coalesce("reached", F.lit(False))).alias("alternate"))


def best_shelter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation, the target with room that is cheapest to reach (targets without room only if there is no other)."""
    targets = T.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("node")).select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.shortest(targets, G.both_ways(_open(spark, sf_dir), "w"))
    rank = F.struct((F.col("source") % 2 == 1).alias("full"), F.round("dist", 6).alias("cost"), F.col("source"))
    return best.groupBy("node").agg(F.min(rank).alias("b")).select("node", F.col("b.source").alias("shelter"), (~F.col("b.full")).alias("has_room"), F.round("b.cost", 3).alias("cost"))


def choke_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criticality of nations from betweenness, rank, splits and critical neighbours."""
    n, e = _nodes(spark, sf_dir), cut(_simple(spark, sf_dir))  # the roads are a join of four tables
    bc, pr, ap = G.betweenness(n, e), G.pagerank(n, e), B.cut_nodes(n, e)
    critical = n.where("node % 4 = 0").select(F.col("node").alias("dst"))
    around = G.two_hops(G.both_ways(e)).join(critical, "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    rows = n.join(bc, "node").join(pr, "node").join(ap, "node", "left").join(around, "node", "left")
    # A critical node counts itself; through its neighbours it is two steps from itself and counts again.
    crit = F.coalesce("c", F.lit(0)) + F.when(F.col("node") % 4 == 0, 1).otherwise(0)
    index = 0.45 * F.log10(F.col("score") + 1) + 0.25 * 10 * F.col("rank") + 0.30 * (5 * F.col("parts").isNotNull().cast("int") + 1.5 * crit)
    return rows.select("node", F.round("score", 5).alias("betweenness"), F.round("rank", 6).alias("rank"), F.coalesce("parts", F.lit(1)).alias("parts"), crit.cast("long").alias("critical"), F.round(index, 3).alias("criticality"))


def top_choke_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most critical nations: a report, so limited."""
    return G.top(choke_points(spark, sf_dir).select("node", "criticality"), "criticality", "node", 3)


def _trade(spark: SparkSession, sf_dir: str, node: Callable[[str, str], Column]) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(node("O", "o_orderkey").alias("a"), node("C", "o_custkey").alias("b"))
    return o.unionByName(T.table(spark, sf_dir, "lineitem").select(node("O", "l_orderkey").alias("a"), node("P", "l_partkey").alias("b")))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()


def _named(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), key)


def _supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All trade as a graph: customers, orders and parts as nodes, an edge from an order to its customer and to
    each part in it. It grows with the tables and no edge is left out."""
    edges = written(_trade(spark, sf_dir, _named).distinct())
    return _ends(edges), edges


def _numbered_supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """The graph of ``_supply`` with numbers for nodes, edges of a line as often as it is there, and the name of a node as a
    column; keys too large for that leave it as it is."""
    t, kinds = lambda name: T.table(spark, sf_dir, name), "OCP"
    bounds = lambda df, *keys: df.agg(F.least(*[F.min(k) for k in keys]).alias("low"), F.greatest(*[F.max(k) for k in keys]).alias("high"))
    found = bounds(t("orders"), "o_orderkey", "o_custkey").unionByName(bounds(t("lineitem"), "l_orderkey", "l_partkey")).agg(F.min("low"), F.max("high")).first()
    if any(x is not None and abs(x) >= 1 << 61 for x in found):
        return *_supply(spark, sf_dir), F.col("node")
    edges = written(_trade(spark, sf_dir, lambda kind, key: F.col(key).cast("long") * 3 + kinds.index(kind)))
    name = F.concat(F.substring(F.lit(kinds), (F.pmod("node", F.lit(3)) + 1).cast("int"), F.lit(1)), F.expr("(node - pmod(node, 3)) div 3"))
    return _ends(edges), edges, name


def supply_cut_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and parts without which trade falls apart, and into how many parts."""
    nodes, edges, name = _numbered_supply(spark, sf_dir)
    return B.cut_nodes(nodes, edges).select(name.alias("node"), "parts")


def supply_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shortest ways lead over each customer, order and part, from a sample of two parts of some 32
    sources each, with the standard error."""
    nodes, edges, name = _numbered_supply(spark, sf_dir)
    nodes = written(nodes)
    found = B.sampled_betweenness(nodes, edges, parts=max(2, nodes.count() // 32), used=2, deal=name)
    return found.select(name.alias("node"), F.round("score", 4).alias("score"), F.round("error", 4).alias("error"))


def supply_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest chain of trade between the first and the last customer of each nation: an order weighs as its
    urgency, a part in it as its quantity."""
    o = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("a"), F.concat(F.lit("C"), "o_custkey").alias("b"), F.substring("o_orderpriority", 1, 1).cast("double").alias("w"))
    p = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_quantity").cast("double").alias("w"))
    e = o.unionByName(p.select(F.concat(F.lit("O"), "l_orderkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b"), "w"))
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), "w")
    e = e.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    ends = T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("s"), F.max("c_custkey").alias("t"))
    found = W.meeting_routes(ends.select(F.concat(F.lit("C"), "s").alias("source"), F.concat(F.lit("C"), "t").alias("target")), e, symmetric=True)
    return found.select("source", "target", F.round("dist", 3).alias("cost"))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as assets; failures go down from region to nation to supplier."""
    n = T.table(spark, sf_dir, "nation")
    down = n.select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"), (0.9 - F.col("n_nationkey") % 5 / 50).alias("p"))
    side = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("N"), (F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit(C.CASCADE_DEFAULT).alias("p"))
    s = T.table(spark, sf_dir, "supplier")
    leaf = s.select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"), (0.5 + F.col("s_suppkey") % 40 / 100).alias("p"))
    return down.unionByName(side).unionByName(leaf)


def cascade_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loss of each region reaches in three steps: hop, likelihood and the way."""
    triggers = T.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    c = G.cascade(triggers, _assets(spark, sf_dir))
    return c.select("trigger", "asset", "hop", F.round("probability", 5).alias("probability"), F.concat_ws(">", "path").alias("path"))


def cascade_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets and exposed people per failing region; suppliers' hours of supply at worst."""
    s = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("asset"), F.when(F.col("s_suppkey") % 4 == 0, 0).otherwise(F.floor(F.abs("s_acctbal") / 100)).alias("beds"), (F.col("s_suppkey") % 50).alias("staff"), (F.abs("s_acctbal") / (0.28 * (50 + F.col("s_suppkey") % 100))).alias("hours"))
    triggers = T.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    c = G.cascade(triggers, _assets(spark, sf_dir)).join(s, "asset", "left")
    people = F.coalesce(F.when(F.col("beds") != 0, F.col("beds")), F.col("staff"), F.lit(0))
    return c.groupBy("trigger").agg(F.count(F.lit(1)).alias("assets"), F.sum(people).cast("long").alias("exposure"), F.round(F.min(F.greatest(F.lit(0.0), F.col("hours") - 2)), 4).alias("least_hours"))


def downslope_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations within two directed roads that lie at least 1.5 lower (the key's hash as height)."""
    e = T.roads(spark, sf_dir).where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    height = lambda c: c * 7 % 11
    return G.two_hops(e).where((F.col("src") != F.col("dst")) & (height(F.col("dst")) <= height(F.col("src")) - 1.5))


QUERIES = {f.__name__: f for f in (simple_graph, shortest_paths, route_paths, minimax_paths, road_components, isolation, best_shelter, choke_points, top_choke_points, supply_cut_nodes, supply_betweenness, supply_routes, cascade_3hop, cascade_exposure, downslope_2hop)}

_SIMPLE = """simple AS (SELECT least(u, v) AS a, greatest(u, v) AS b, arg_min(edge_id, (length, edge_id)) AS edge_id, min(length) AS length, arg_min(p_blocked, (length, edge_id)) AS p_blocked,
    arg_min(is_bridge, (length, edge_id)) AS is_bridge, arg_min(class, (length, edge_id)) AS class FROM roads WHERE u <> v GROUP BY 1, 2),
    sev AS (SELECT *, p_blocked >= CASE WHEN is_bridge THEN 0.5 ELSE 0.7 END AS severed FROM simple),
    op AS (SELECT a AS s, b AS d, length * (1 + 3.0 * p_blocked) AS w FROM sev WHERE NOT severed UNION ALL SELECT b, a, length * (1 + 3.0 * p_blocked) FROM sev WHERE NOT severed),
    allw AS (SELECT a AS s, b AS d, p_blocked AS w FROM sev UNION ALL SELECT b, a, p_blocked FROM sev)"""
_HEAD = f"{T.with_tables('roads', recursive=True)}, {_SIMPLE}"
# Reachable pairs, for SQL: values are settled by unrolled relaxation over at most 24 steps.
_PATHS = """d0 AS (SELECT n_nationkey AS source, n_nationkey AS node, 0.0::DOUBLE AS dist, 0 AS step FROM nation),
    walk AS (SELECT * FROM d0 UNION ALL SELECT source, node, min(dist), step + 1 FROM (
        SELECT w1.source, w1.node, w1.dist, w1.step FROM walk w1 UNION ALL SELECT w2.source, e.d, {step}, w2.step FROM walk w2 JOIN {edges} e ON e.s = w2.node) WHERE step < 24 GROUP BY 1, 2, step),
    best AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"""
_SHORT = _PATHS.format(step="w2.dist + e.w", edges="op")
_WORST = _PATHS.format(step="greatest(w2.dist, e.w)", edges="allw")
_ASSETS = """assets AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 0.9::DOUBLE - (n_nationkey % 5) / 50.0::DOUBLE AS p FROM nation
    UNION ALL SELECT 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25), 0.95 FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 0.5::DOUBLE + (s_suppkey % 40) / 100.0::DOUBLE FROM supplier),
    walk AS (SELECT 'R' || r_regionkey AS trigger, 'R' || r_regionkey AS asset, 0 AS hop, 1.0::DOUBLE AS p, ['R' || r_regionkey] AS path FROM region
        UNION ALL SELECT trigger, dst, hop + 1, w.p * a.p, list_append(path, dst) FROM walk w JOIN assets a ON a.src = w.asset WHERE hop < 3 AND NOT list_contains(path, dst)),
    hit AS (SELECT * FROM walk WHERE hop > 0 QUALIFY row_number() OVER (PARTITION BY trigger, asset ORDER BY hop, p DESC, path) = 1)"""

# Shortest ways by edge count from the numbers of walks of each length; ranks by unrolled rounds; splits by labels
# that spread in copies of the graph which lack a node.
_CHOKE = """e2 AS (SELECT a AS s, b AS d FROM sev UNION SELECT b, a FROM sev), nd AS (SELECT n_nationkey AS node FROM nation), dg AS (SELECT s, count(*) AS deg FROM e2 GROUP BY 1),
    wk AS (SELECT node AS s, node, 0 AS k, 1.0::DOUBLE AS c FROM nd UNION ALL SELECT wk.s, e2.d, k + 1, sum(c) FROM wk JOIN e2 ON e2.s = wk.node WHERE k < 24 GROUP BY wk.s, e2.d, k),
    sp AS (SELECT s, node AS t, min(k) AS d, arg_min(c, k) AS c FROM wk GROUP BY 1, 2),
    bc AS (SELECT v.t AS node, sum(v.c * w.c / x.c) AS score FROM sp x JOIN sp v ON v.s = x.s AND v.t <> x.s AND v.t <> x.t JOIN sp w ON w.s = v.t AND w.t = x.t AND v.d + w.d = x.d WHERE x.s < x.t GROUP BY 1),
    pr AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank, 0 AS k FROM nd UNION ALL SELECT node, 0.15::DOUBLE / 25 + 0.85::DOUBLE * sum(g), k + 1 FROM (
        SELECT e2.d AS node, rank / deg AS g, k FROM pr JOIN e2 ON e2.s = pr.node JOIN dg ON dg.s = pr.node UNION ALL SELECT node, 0, k FROM pr) WHERE k < 20 GROUP BY node, k),
    lb AS (SELECT s AS lost, d AS node, d AS label, 0 AS k FROM e2 UNION ALL SELECT lost, node, min(label), k + 1 FROM (SELECT lost, node, label, k FROM lb UNION ALL SELECT lost, e2.d, label, k FROM lb JOIN e2 ON e2.s = node AND e2.d <> lost) WHERE k < 24 GROUP BY lost, node, k),
    ap AS (SELECT lost AS node, count(DISTINCT label) AS parts FROM lb JOIN e2 ON e2.s = lost AND e2.d = node WHERE k = 24 GROUP BY 1 HAVING count(DISTINCT label) > 1),
    ar AS (SELECT s AS node, count(*) AS c FROM (SELECT s, d FROM e2 UNION SELECT x.s, y.d FROM e2 x JOIN e2 y ON x.d = y.s) WHERE d % 4 = 0 GROUP BY 1),
    ck AS (SELECT node, coalesce(score, 0) AS score, rank, parts, coalesce(c, 0) + CASE WHEN node % 4 = 0 THEN 1 ELSE 0 END AS crit FROM nd LEFT JOIN bc USING (node) LEFT JOIN (SELECT node, rank FROM pr WHERE k = 20) USING (node) LEFT JOIN ap USING (node) LEFT JOIN ar USING (node)),
    ci AS (SELECT *, round(0.45::DOUBLE * log10(score + 1) + 2.5::DOUBLE * rank + 0.30::DOUBLE * (CASE WHEN parts IS NULL THEN 0 ELSE 5 END + 1.5::DOUBLE * crit), 3) AS criticality FROM ck)"""

ORACLES = {
    "supply_routes": """WITH RECURSIVE one AS (SELECT 'O' || o_orderkey AS a, 'C' || o_custkey AS b, substr(o_orderpriority, 1, 1)::DOUBLE AS w FROM orders
            UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, min(l_quantity)::DOUBLE FROM lineitem GROUP BY l_orderkey, l_partkey),
        e AS (SELECT a AS s, b AS d, w FROM one UNION ALL SELECT b, a, w FROM one),
        ends AS (SELECT 'C' || min(c_custkey) AS source, 'C' || max(c_custkey) AS target FROM customer GROUP BY c_nationkey),
        best(source, node, dist) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0.0::DOUBLE FROM ends UNION
            (SELECT n.source, n.d, min(n.dist) FROM (SELECT x.source, e.d, x.dist + e.w AS dist FROM best x JOIN e ON e.s = x.node) n LEFT JOIN recurring.best r ON r.source = n.source AND r.node = n.d WHERE r.dist IS NULL OR n.dist < r.dist GROUP BY n.source, n.d))
        SELECT ends.source, target, round(dist, 3) AS cost FROM ends LEFT JOIN best ON best.source = ends.source AND best.node = target""",
    "route_paths": f"""{_HEAD}, pw AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, [0]::BIGINT[] AS path, 0 AS step UNION ALL SELECT node, min(dist), arg_min(path, dist), step + 1 FROM (SELECT w1.node, w1.dist, w1.path, w1.step FROM pw w1
            UNION ALL SELECT e.d, w2.dist + e.w, list_append(w2.path, e.d), w2.step FROM pw w2 JOIN op e ON e.s = w2.node) WHERE step < 24 GROUP BY node, step), bp AS (SELECT node, min(dist) AS dist, arg_min(path, dist) AS path FROM pw GROUP BY 1)
        SELECT node, array_to_string(path, '>') AS path, CASE WHEN floor(dist) <= 0 THEN 0 ELSE round_even(floor(dist) / 1000 / 4.0::DOUBLE * 60, 0) END::BIGINT AS minutes FROM bp""",
    "choke_points": f"{_HEAD}, {_CHOKE} SELECT node, round(score, 5) AS betweenness, round(rank, 6) AS rank, coalesce(parts, 1) AS parts, crit::BIGINT AS critical, criticality FROM ci",
    "top_choke_points": f"{_HEAD}, {_CHOKE} SELECT node, criticality FROM ci ORDER BY criticality DESC, node LIMIT 3",
    "simple_graph": f"""{_HEAD} SELECT a, b, edge_id, round(length, 5) AS length, p_blocked, severed, round(CASE class WHEN 'trunk' THEN 24 WHEN 'primary' THEN 24 WHEN 'secondary' THEN 18 WHEN 'tertiary' THEN 12
        WHEN 'residential' THEN 6 WHEN 'unclassified' THEN 6 WHEN 'service' THEN 4 ELSE 12 END * CASE WHEN is_bridge THEN 2.0::DOUBLE ELSE 1 END * (1 + p_blocked), 5) AS hours FROM sev""",
    "shortest_paths": f"{_HEAD}, {_SHORT} SELECT source, node, round(dist, 3) AS cost FROM best",
    "minimax_paths": f"{_HEAD}, {_WORST} SELECT a.n_nationkey AS source, b.n_nationkey AS node, coalesce(dist, 1.0) AS p_blocked FROM nation a CROSS JOIN nation b LEFT JOIN best ON source = a.n_nationkey AND node = b.n_nationkey",
    "road_components": f"{_HEAD}, {_SHORT} SELECT node, min(source) AS component FROM best GROUP BY 1",
    "isolation": f"""{_HEAD}, {_SHORT}, t AS (SELECT min(n_nationkey) AS k FROM nation GROUP BY n_regionkey), {_WORST.replace('d0 AS', 'd1 AS').replace('walk', 'walk2').replace('FROM d0', 'FROM d1').replace('best AS', 'best2 AS')},
        lenw AS (SELECT a AS s, b AS d, length AS w, severed::INT AS x FROM sev UNION ALL SELECT b, a, length, severed::INT FROM sev),
        walk3 AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS dist, 0 AS cuts, 0 AS step FROM t UNION ALL SELECT source, node, min(dist), arg_min(cuts, dist), step + 1 FROM (
            SELECT w1.source, w1.node, w1.dist, w1.cuts, w1.step FROM walk3 w1 UNION ALL SELECT w2.source, e.d, w2.dist + e.w, w2.cuts + e.x, w2.step FROM walk3 w2 JOIN lenw e ON e.s = w2.node) WHERE step < 24 GROUP BY 1, 2, step),
        usual AS (SELECT source, node, arg_min(cuts, dist) AS cuts FROM walk3 GROUP BY 1, 2)
        SELECT n_nationkey AS node, coalesce((SELECT min(dist) FROM best2 WHERE node = n_nationkey AND source IN (SELECT k FROM t)), 1.0) AS p_isolated,
        NOT EXISTS (SELECT 1 FROM usual WHERE node = n_nationkey AND cuts = 0) AS isolated_now,
        EXISTS (SELECT 1 FROM usual WHERE node = n_nationkey AND cuts = 0) OR EXISTS (SELECT 1 FROM best WHERE node = n_nationkey AND source IN (SELECT k FROM t)) AS alternate FROM nation""",
    "best_shelter": f"""{_HEAD}, {_SHORT}, t AS (SELECT min(n_nationkey) AS k FROM nation GROUP BY n_regionkey) SELECT node, source AS shelter, source % 2 = 0 AS has_room, round(dist, 3) AS cost FROM best
        WHERE source IN (SELECT k FROM t) QUALIFY row_number() OVER (PARTITION BY node ORDER BY source % 2 = 1, round(dist, 6), source) = 1""",
    "cascade_3hop": f"WITH RECURSIVE {_ASSETS} SELECT trigger, asset, hop, round(p, 5) AS probability, array_to_string(path, '>') AS path FROM hit",
    "cascade_exposure": f"""WITH RECURSIVE {_ASSETS}, s AS (SELECT 'S' || s_suppkey AS asset, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE floor(abs(s_acctbal) / 100) END AS beds, s_suppkey % 50 AS staff,
            abs(s_acctbal) / (0.28::DOUBLE * (50 + s_suppkey % 100)) AS hours FROM supplier)
        SELECT trigger, count(*) AS assets, sum(coalesce(nullif(beds, 0), staff, 0))::BIGINT AS exposure, round(min(greatest(0, hours - 2)), 4) AS least_hours FROM hit LEFT JOIN s USING (asset) GROUP BY 1""",
    "downslope_2hop": f"""{T.with_tables('roads')}, e AS (SELECT DISTINCT u AS src, v AS dst FROM roads WHERE u < v), t AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src)
        SELECT src, dst FROM t WHERE src <> dst AND dst * 7 % 11 <= src * 7 % 11 - 1.5""",
}
