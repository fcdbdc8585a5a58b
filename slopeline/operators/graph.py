"""Graph operators as joins and aggregations over edge tables.

Loops run until nothing changes; each round ends in a table or a checkpoint, so plans stay short. Edges are
written once before a loop and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import dynamic_cost
from ..session import cut, written


def simple_edges(edges: DataFrame) -> DataFrame:
    """(a, b, edge_id, length, ...): of parallel edges in either direction the shortest, loops left out."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    keyed = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), *rest)
    best = keyed.groupBy("a", "b").agg(F.min_by(F.struct(*rest), F.struct("length", "edge_id")).alias("e"))
    return best.select("a", "b", "e.*")


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """(src, dst, ...) for each direction of (a, b) edges."""
    one = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), *columns)
    return one.unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), *columns))


def relax(seeds: DataFrame, edges: DataFrame, step: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(source, node, dist, prev) of the best value from every seed to every node it reaches.

    ``seeds`` has (source, node, dist); ``edges`` (src, dst, w). ``step`` builds a value from
    ``dist`` and ``w``: their sum gives shortest paths, their greatest the path whose worst edge is
    least bad. Values must not get better along a path. Columns of ``edges`` named in ``carry`` are
    summed up along the best path. Ends when a round betters nothing, after as many rounds as the
    longest best path has edges.
    """
    edges = written(edges.select("src", "dst", "w", *[F.col(c).cast("double").alias(f"_{c}") for c in carry]))
    kept = ["dist", "prev", *carry]
    best = seeds.select("source", "node", F.col("dist").cast("double").alias("dist"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("prev"), *[F.lit(0.0).alias(c) for c in carry])
    best = written(best.withColumn("moved", F.lit(True)))
    while True:
        sums = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in carry]
        front = best.where("moved").select("source", F.col("node").alias("src"), "dist", *carry)
        reached = front.join(edges, "src").select("source", F.col("dst").alias("node"), step.alias("dist"), F.col("src").alias("prev"), *sums)
        reached = reached.groupBy("source", "node").agg(F.min_by(F.struct(*kept), F.struct("dist", "prev")).alias("n"))
        old = best.select("source", "node", F.struct(*kept).alias("o"))
        better = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.dist") < F.col("o.dist")))
        both = old.join(reached, ["source", "node"], "full_outer")
        best = written(both.select("source", "node", F.when(better, F.col("n")).otherwise(F.col("o")).alias("x"), better.alias("moved")).select("source", "node", "x.*", "moved"))
        if best.where("moved").isEmpty():
            return best.drop("moved")


def shortest(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return relax(seeds, edges, F.col("dist") + F.col("w"))


def bottleneck(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return relax(seeds, edges, F.greatest("dist", "w"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by handing on the smallest label and following it."""
    label = written(nodes.select("node", F.col("node").alias("component")))
    pairs = written(both_ways(edges))
    while True:
        heard = pairs.join(label, pairs.src == label.node).groupBy("dst").agg(F.min("component").alias("heard"))
        nearer = label.join(heard, label.node == heard.dst, "left").select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = written(nearer.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved")))
        label = step.select("node", "component")
        if step.where("moved").isEmpty():
            return label


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = C.DAMPING, rounds: int = C.PAGERANK_ROUNDS) -> DataFrame:
    """(node, rank) after a fixed number of rounds from even ranks; what dead ends hold is lost."""
    n = nodes.count()
    pairs = both_ways(edges)
    pairs = cut(pairs.join(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"))
    rank = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        given = pairs.join(rank, pairs.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = nodes.join(given, nodes.node == given.dst, "left").select("node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def cascade(triggers: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(trigger, asset, hop, probability, path): what a failure reaches along simple paths.

    ``edges`` has (src, dst, p). Of several ways to an asset the one of fewest hops counts, then
    the likeliest, then the first path in order.
    """
    front = triggers.select(F.col("node").alias("trigger"), F.col("node").alias("asset"), F.lit(1.0).alias("probability"), F.array("node").alias("path"))
    found = None
    for hop in range(1, max_hops + 1):
        go = front.join(edges, front.asset == edges.src).where(~F.array_contains("path", F.col("dst")))
        front = go.select("trigger", F.col("dst").alias("asset"), (F.col("probability") * F.col("p")).alias("probability"), F.concat("path", F.array("dst")).alias("path"))
        # A worse path to the same asset can still matter only if it avoids a node the better one
        # visits; within so few hops all simple paths are kept.
        told = front.withColumn("hop", F.lit(hop))
        found = told if found is None else found.unionByName(told)
    rank = F.struct("hop", -F.col("probability"), "path")
    best = found.groupBy("trigger", "asset").agg(F.min_by(F.struct("hop", "probability", "path"), rank).alias("b"))
    return best.select("trigger", "asset", "b.*")


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst) for nodes one or two directed steps apart."""
    near = edges.select("src", "dst").distinct()
    far = near.join(near.select(F.col("src").alias("mid"), F.col("dst").alias("to")), F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst"))
    return near.unionByName(far).distinct()


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score): shortest paths by edge count that pass through a node, each pair once.

    All sources go outward together, level by level, with the number of shortest paths; then
    shares come back from the deepest level. The table has a row per source and node.
    """
    pairs = cut(both_ways(edges).distinct())
    sums = shares(nodes, pairs).groupBy("node").agg((F.sum("share") / 2).alias("score"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def shares(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, node, share): what shortest paths from each source pass through other nodes (``pairs``: src, dst, each in both directions)."""
    level = written(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    levels = [level]
    while True:
        out = levels[-1].join(pairs, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        # Breadth first over pairs in both directions: what is new is neither on the last level nor on the one before it.
        for known in levels[-2:]:
            out = out.join(known.select("s", "node"), ["s", "node"], "left_anti")
        level = written(out)
        if level.isEmpty():
            break
        levels.append(level)
    share = sources.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("share")).limit(0)
    total = share
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:])):
        got = lower.join(share, ["s", "node"], "left").select("s", F.col("node").alias("below"), F.col("paths").alias("m"), F.coalesce("share", F.lit(0.0)).alias("share"))
        back = upper.join(pairs, upper.node == pairs.src).join(got, ["s"]).where(F.col("dst") == F.col("below"))
        share = written(back.groupBy("s", "node").agg(F.sum(F.col("paths") / F.col("m") * (1 + F.col("share"))).alias("share")))
        total = total.unionByName(share.where("s <> node"))
    return total


def path_of(best: DataFrame, ends: Column | None = None) -> DataFrame:
    """(source, node, path): the nodes from source to node, by following ``prev`` back, all at once.

    ``best`` must be a forest per source, as ``relax`` returns it. Paths lead to all nodes or to those for
    which ``ends`` holds.
    """
    known = written(best.select("source", F.col("node").alias("at"), F.col("prev").alias("before")))
    last = best if ends is None else best.where(ends)
    walk = written(last.select("source", "node", F.array("node").alias("path"), F.col("prev").alias("at")))
    while not walk.where("at is not null").isEmpty():
        step = walk.join(known, ["source", "at"], "left")
        walk = written(step.select("source", "node", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"), F.col("before").alias("at")))
    return walk.select("source", "node", "path")


def top(rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(k)


def per_key_top(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def priced_roads(nodes: DataFrame, edges: DataFrame, clearance: float = 0.45) -> DataFrame:
    """(src, dst, w): seconds that a vehicle needs for an edge, null where it can't pass.

    ``nodes``: node, depth, slope, passable; ``edges``: src, dst, base_s, depth, passable (one direction each).
    """
    u = nodes.select(F.col("node").alias("src"), F.col("slope").alias("_us"))
    v = nodes.select(F.col("node").alias("dst"), F.col("depth").alias("_vd"), F.col("slope").alias("_vs"), F.col("passable").alias("_vp"))
    both = edges.join(u, "src").join(v, "dst")
    depth = F.greatest(F.coalesce("depth", F.lit(0.0)), F.coalesce("_vd", F.lit(0.0)))
    slope = F.greatest(F.coalesce("_us", F.lit(2.0)), F.coalesce("_vs", F.lit(2.0)))
    open_way = F.coalesce("passable", F.lit(True)) & F.coalesce("_vp", F.lit(True))
    return both.select("src", "dst", F.when(open_way, dynamic_cost(F.coalesce("base_s", F.lit(55.0)), depth, slope, clearance)).alias("w"))


def budgeted_routes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, clearance: float = 0.45) -> DataFrame:
    """(source, target, reachable, eta_s, path, avoided): the cheapest way of a vehicle that can pass some depth of water.

    ``pairs``: source, target; ``nodes``: node, depth, slope, passable; ``edges``: src, dst, base_s, depth,
    passable (one direction each). The deeper of edge and far node counts, and the steeper end. Ways
    through water or closed nodes do not exist. ``avoided`` lists, in order, the closed neighbours of all
    nodes that are at most as far as the target: it does not depend on the order of a search.
    """
    priced = cut(priced_roads(nodes, edges, clearance))
    seeds = pairs.select("source").distinct().join(nodes.select(F.col("node").alias("source")), "source", "left_semi").select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    best = shortest(seeds, priced.where("w is not null"))
    goal = best.select("source", F.col("node").alias("target"), F.col("dist").alias("eta_s"))
    out = pairs.join(goal, ["source", "target"], "left")
    ways = path_of(best).withColumnRenamed("node", "target")
    # Of a target out of reach the whole reach counts.
    limit = out.select("source", "target", F.coalesce("eta_s", F.lit(float("inf"))).alias("most"))
    shut = best.join(priced.where("w is null"), best.node == F.col("src")).select("source", "dist", F.col("dst").alias("closed"))
    avoided = shut.join(limit, "source").where((F.col("dist") < F.col("most"))).groupBy("source", "target").agg(F.sort_array(F.collect_set("closed")).alias("avoided"))
    return out.join(ways, ["source", "target"], "left").join(avoided, ["source", "target"], "left").select("source", "target", F.col("eta_s").isNotNull().alias("reachable"), F.round("eta_s", 2).alias("eta_s"), "path", "avoided")


def steps_of(paths: DataFrame) -> DataFrame:
    """(source, node, step, a, b): the edges of paths (source, node, path) in order."""
    pairs = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.element_at("path", i + 2).alias("b")))
    return paths.select("source", "node", F.posexplode(pairs).alias("step", "e")).select("source", "node", "step", "e.a", "e.b")


def avoided_roads(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, roads): labels of severed edges on paths, each where it is first met.

    ``edges``: a, b (a < b), severed, ref, name, edge_id. A road is called by its ref, else its name.
    """
    label = F.coalesce(F.nullif("ref", F.lit("")), F.nullif("name", F.lit("")), F.concat(F.lit("unnamed segment "), "edge_id"))
    cut_off = edges.where("severed").select(F.col("a").alias("_a"), F.col("b").alias("_b"), label.alias("label"))
    s = steps_of(paths)
    met = s.join(cut_off, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")))
    first = met.groupBy("source", "node", "label").agg(F.min("step").alias("step"))
    told = first.groupBy("source", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "label"))), lambda x: x["label"]).alias("roads"))
    return paths.select("source", "node").join(told, ["source", "node"], "left").withColumn("roads", F.coalesce("roads", F.array().cast("array<string>")))


def route_lines(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, line): a path's points, edge by edge as travelled, joints once.

    ``nodes``: node, x, y; ``edges``: a, b (a < b), u (the end where the geometry begins), geometry
    (array of struct<x,y>; null: a straight line).
    """
    n = nodes.select(F.col("node"), F.struct("x", "y").alias("p"))
    s = steps_of(paths).withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")})
    e = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "u", "geometry")
    s = s.join(e, ["_a", "_b"]).join(n.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(n.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
    part = F.when(F.col("geometry").isNull(), F.array("pa", "pb")).when(F.col("u") == F.col("a"), F.col("geometry")).otherwise(F.reverse("geometry"))
    parts = s.groupBy("source", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", part.alias("line")))), lambda x: x["line"]).alias("parts"))
    # A point is left out where the part before ends in it.
    ends = F.transform("parts", lambda x: F.element_at(x, -1))
    joined = F.flatten(F.transform("parts", lambda x, i: F.when((i > 0) & (F.get(ends, i - 1) == F.element_at(x, 1)), F.slice(x, 2, F.size(x))).otherwise(x)))
    return paths.select("source", "node").join(parts.select("source", "node", joined.alias("line")), ["source", "node"], "left")


def subgraph(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, through: tuple[str, ...], also: tuple[str, ...] = (), hops: int = 3) -> DataFrame:
    """(anchor, node, hop, path): what an anchor reaches in some hops: it goes on along edges of the kinds in
    ``through``; those in ``also`` are followed once and end there (path null).

    ``anchors``: anchor; ``nodes``: node, label; ``edges``: src, dst, rel. Every walk is told; the anchor
    itself has hop 0. Nodes that are not in ``nodes`` are never reached.
    """
    tag = nodes.select(F.col("node").alias("dst"), F.concat_ws(":", "label", "node").alias("tag"))
    ways = cut(edges.where(F.col("rel").isin(*through, *also)).join(tag, "dst"))
    front = anchors.join(nodes.select(F.col("node").alias("anchor"), "label"), "anchor").select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hop"), F.concat_ws(":", "label", "anchor").alias("path"))
    found = front
    for hop in range(1, hops + 1):
        step = front.join(ways, front.node == ways.src)
        go = F.col("rel").isin(*through)
        out = step.select("anchor", F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.when(go, F.concat("path", F.lit("-["), "rel", F.lit("]->"), "tag")).alias("path"))
        found = found.unionByName(out)
        front = out.where("path is not null")
    return found
