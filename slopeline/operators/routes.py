"""Ways to a goal: bounds from landmarks keep the search between a source and its target.

Distances from and to a few landmarks bound every distance from below (triangle inequality) and that of each pair
from above (by way of a landmark). A node is looked at for a pair only while the way to it and the bound of what
is left are no longer than the best way known. Where nodes don't reach each other, landmarks often tell before
any search.

In graphs where distances hardly grow with the steps, landmarks tell little: there the search from both ends
(``meeting_routes``) sees two small surroundings and not the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import components, path_of, shortest

_FAR = float("inf")

#: Sums along different ways differ by rounding; bounds are held to this share.
_SLACK = 1e-9

_STEP = 4096  # nodes of one end that go on in a round, or as many as it has been through before
_SMALL = 250_000  # rows of a front that may be broadcast
_SHARES = [0.5**i for i in range(24)]


def landmarks(edges: DataFrame, count: int = 8) -> DataFrame:
    """(mark, place): ``count`` nodes that have ways out, by a hash, numbered from 0."""
    chosen = edges.select(F.col("src").alias("mark")).distinct().orderBy(F.xxhash64("mark"), "mark").limit(count)
    numbered = chosen.agg(F.sort_array(F.collect_list("mark")).alias("m"))  # at most ``count`` nodes
    return numbered.select(F.posexplode("m").alias("place", "mark")).select("mark", "place")


def bearings(edges: DataFrame, marks: DataFrame, symmetric: bool = False) -> DataFrame:
    """(node, near, away): arrays with the distance from each landmark and to each landmark, infinite where there is no way.

    ``symmetric`` says that every edge is there in both directions with one weight, so one search serves both.

    Nodes that neither reach nor are reached from any landmark are absent.
    """
    marks = written(marks)
    size = marks.count()
    seeds = marks.select(F.col("mark").alias("source"), F.col("mark").alias("node"), F.lit(0.0).alias("dist"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = None
    for name, way in (("near", edges), ("away", back))[: 1 if symmetric else 2]:
        dist = shortest(seeds, way).select("source", "node", F.col("dist").alias(name))
        dist = dist.join(F.broadcast(marks), dist.source == F.col("mark"))  # as many rows as landmarks
        row = dist.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", name))).alias("m"))
        row = row.select("node", _filled(F.col("m"), size).alias(name))
        both = row if both is None else both.join(row, "node", "full_outer")
    if symmetric:
        return written(both.select("node", "near", F.col("near").alias("away")))
    none = F.array_repeat(F.lit(_FAR), size)
    return written(both.select("node", F.coalesce("near", none).alias("near"), F.coalesce("away", none).alias("away")))


def _filled(found: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(_FAR)))


def at_least(near: Column, away: Column, goal_near: Column, goal_away: Column) -> Column:
    """Lower bound of the distance from a node with ``near`` and ``away`` to a goal; infinite if there is no way.

    A landmark that reaches the node but not the goal, or is reached from the goal but not from the node, rules
    a way out.
    """
    apart = lambda far, close: F.when(close == _FAR, 0.0).otherwise(far - close)
    forth = F.zip_with(goal_near, near, apart)
    back = F.zip_with(away, goal_away, apart)
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(forth), F.lit(0.0)), F.coalesce(F.array_max(back), F.lit(0.0)))


def goal_routes(pairs: DataFrame, edges: DataFrame, *, marks: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """(source, target, dist, path, seen): cheapest ways for pairs (source, target) over edges (src, dst, w >= 0).

    ``dist`` and ``path`` are null where there is no way; ``seen`` counts the nodes that were given a distance for
    the pair. A pair is told once however often it is asked; one with a null end has no way. Ends when no pair has
    a node left within its bound; there is no limit on rounds.
    """
    edges = written(edges.select("src", "dst", F.col("w").cast("double").alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL"))
    sight = bearings(edges, landmarks(edges) if marks is None else marks, symmetric)
    # A node that no landmark knows has no bounds: zero for every distance, by empty arrays.
    blank = F.array().cast("array<double>")
    near, away = F.coalesce("near", blank), F.coalesce("away", blank)
    onward = edges.join(sight, edges.dst == sight.node, "left").select("src", "dst", "w", near.alias("near"), away.alias("away"))
    onward = written(onward)
    asked = pairs.select("source", "target").distinct()
    ends = asked.where("source IS NOT NULL AND target IS NOT NULL")
    ends = ends.join(sight.select(F.col("node").alias("source"), F.col("near").alias("s_near"), F.col("away").alias("s_away")), "source", "left")
    ends = ends.join(sight.select(F.col("node").alias("target"), F.col("near").alias("g_near"), F.col("away").alias("g_away")), "target", "left")
    for c in ("s_near", "s_away", "g_near", "g_away"):
        ends = ends.withColumn(c, F.coalesce(c, blank))
    round_about = F.coalesce(F.array_min(F.zip_with("s_away", "g_near", lambda a, b: a + b)), F.lit(_FAR))
    least = at_least(F.col("s_near"), F.col("s_away"), F.col("g_near"), F.col("g_away"))
    goals = written(ends.select("source", "target", "g_near", "g_away", F.when(F.col("source") == F.col("target"), 0.0).otherwise(round_about).alias("most"), least.alias("least")))
    kind = dict(edges.dtypes)["src"]
    open_ends = goals.where(F.col("least") < _FAR)
    best = written(open_ends.select("source", "target", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("prev"), F.col("least").alias("rest"), F.lit(True).alias("moved")))
    key = ["source", "target", "node"]
    within = lambda dist, rest: dist + rest <= F.col("most") * (1 + _SLACK) + _SLACK
    while True:
        front = best.where("moved").join(goals.drop("least"), ["source", "target"]).where((F.col("node") != F.col("target")) & within(F.col("dist"), F.col("rest")))
        step = front.join(onward, front.node == onward.src)
        step = step.select("source", "target", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"), at_least(F.col("near"), F.col("away"), F.col("g_near"), F.col("g_away")).alias("rest"), "most")
        step = step.where((F.col("rest") < _FAR) & within(F.col("dist"), F.col("rest")))
        reached = step.groupBy(*key).agg(F.min_by(F.struct("dist", "prev", "rest"), F.struct("dist", "prev")).alias("n"))
        old = best.select(*key, F.struct("dist", "prev", "rest").alias("o"))
        better = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.dist") < F.col("o.dist")))
        both = old.join(reached, key, "full_outer")
        best = written(both.select(*key, F.when(better, F.col("n")).otherwise(F.col("o")).alias("x"), better.alias("moved")).select(*key, "x.*", "moved"))
        if best.where("moved").isEmpty():
            break
        got = best.where("moved AND node = target").select("source", "target", F.col("dist").alias("_got"))
        goals = written(goals.join(got, ["source", "target"], "left").withColumn("most", F.least("most", F.coalesce("_got", F.lit(_FAR)))).drop("_got"))
    # A pair is the source of its own search.
    search = best.select(F.struct("source", "target").alias("source"), "node", "prev")
    ways = path_of(search, F.col("node") == F.col("source.target")).select("source.*", "path")
    seen = best.groupBy("source", "target").agg(F.count(F.lit(1)).alias("seen"), F.min(F.when(F.col("node") == F.col("target"), F.col("dist"))).alias("dist"))
    out = asked.join(seen, ["source", "target"], "left").join(ways, ["source", "target"], "left")
    return out.select("source", "target", "dist", "path", F.coalesce("seen", F.lit(0)).alias("seen"))


def hang_together(pairs: DataFrame, edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """The pairs (source, target) that some way joins, whatever the direction of its edges.

    One flood from all ends level by level: a node is told once, with one end that is nearest; where floods of
    different ends touch, these hang together.
    """
    arcs = edges.select("src", "dst")
    if not symmetric:
        arcs = arcs.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = written(pairs.select(F.col("source").alias("node")).unionByName(pairs.select(F.col("target").alias("node"))).distinct())
    before, front = ends.limit(0).select("node", F.col("node").alias("end")), ends.select("node", F.col("node").alias("end"))
    touches = ends.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    while not front.isEmpty():
        small = front.count() <= _SMALL
        heard = front.select(F.col("node").alias("src"), "end")
        heard = written((F.broadcast(heard) if small else heard).join(arcs, "src").select(F.col("dst").alias("node"), "end").distinct())
        # Breadth first over edges in both directions: what is new is neither on the last level nor on the one before it.
        known = front.unionByName(before)
        fresh = written(heard.join(known, "node", "left_anti").groupBy("node").agg(F.min("end").alias("end")))
        told = known.unionByName(fresh).withColumnRenamed("end", "other")
        touches = touches.unionByName(written(heard.join(told, "node").where("end <> other").select(F.col("end").alias("a"), F.col("other").alias("b")).distinct()))
        before, front = front, fresh
    part = components(ends, touches)
    of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    return pairs.join(of("source"), "source").join(of("target"), "target").where("_source = _target").select("source", "target")


def meeting_routes(pairs: DataFrame, edges: DataFrame, *, symmetric: bool = False, unmet: int = 20_000) -> DataFrame:
    """(source, target, dist, path, seen): cheapest ways as ``goal_routes`` tells them, searched from both ends at once
    and without landmarks, for graphs in which few steps lead everywhere.

    From each end the nearest nodes go on first; once the two searches of a pair have met, neither goes farther than
    half the best way known. All nodes within half the way go on from either end, so the last node of a way that lies
    within its half has a distance from the source, as the nodes before it have gone on, and one from the target, as
    the node behind it has. A pair ends without a way when one end has no node left. Pairs that have not met after
    ``unmet`` nodes from each end are asked once whether they hang together at all, by one flood for all of them.
    """
    edges = written(edges.select("src", "dst", F.col("w").cast("double").alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL"))
    kind = dict(edges.dtypes)["src"]
    asked = written(pairs.select("source", "target").distinct())
    arcs = edges
    if not symmetric:
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        arcs = edges.withColumn("back", F.lit(False)).unionByName(turned.withColumn("back", F.lit(True)))
    on = ["src"] if symmetric else ["src", "back"]
    pair, key = ["source", "target"], ["source", "target", "back", "node"]
    goals = asked.where("source IS NOT NULL AND target IS NOT NULL").withColumn("most", F.lit(_FAR))
    start = lambda c, back: goals.select(*pair, F.lit(back).alias("back"), F.col(c).cast(kind).alias("node"))
    best = start("source", False).unionByName(start("target", True))
    best = written(best.withColumns({"dist": F.lit(0.0), "prev": F.lit(None).cast(kind), "moved": F.lit(True)}))
    fits = lambda dist: dist <= F.col("most") * (1 + _SLACK) + _SLACK
    flooded = False
    while True:
        got = _met(best).groupBy(pair).agg(F.min("dist").alias("_got"))
        goals = goals.join(got, pair, "left").withColumn("most", F.least("most", F.coalesce("_got", F.lit(_FAR)))).drop("_got")
        # What may go on: of a pair that has met, what is within half its way; of another one everything, while both ends have some.
        may = F.col("moved") & fits(2 * F.col("dist"))
        ahead = best.join(goals.select(*pair, "most"), pair).withColumn("go", may)
        state = []
        for name, own in (("fore", ~F.col("back")), ("rear", F.col("back"))):
            gone, left = F.count_if(own & ~F.col("moved")), F.count_if(own & F.col("go"))
            halvings = F.ceil(F.log2(left / F.greatest(gone, F.lit(_STEP)))).cast("int")
            cuts = F.percentile_approx(F.when(own & F.col("go"), F.col("dist")), F.array(*map(F.lit, _SHARES)), F.lit(1000))
            upto = F.when(left > 0, F.get(cuts, F.greatest(F.lit(0), F.least(F.lit(len(_SHARES) - 1), halvings))))
            state += [left.alias(f"{name}_left"), F.count_if(own).alias(f"{name}_held"), upto.alias(f"{name}_upto")]
        goals = goals.select(*pair, "most").join(ahead.groupBy(pair).agg(*state), pair)
        goals = written(goals.where((F.col("most") < _FAR) | (F.least("fore_left", "rear_left") > 0)))
        if not flooded and not goals.where((F.col("most") == _FAR) & (F.least("fore_held", "rear_held") > unmet)).isEmpty():
            flooded = True
            lost = goals.where(F.col("most") == _FAR).select(pair)
            goals = written(goals.join(lost.join(hang_together(lost, edges, symmetric), pair, "left_anti"), pair, "left_anti"))
        front = best.join(goals, pair).where(may & (F.col("dist") <= F.when(F.col("back"), F.col("rear_upto")).otherwise(F.col("fore_upto"))))
        front = written(front.select(F.col("node").alias("src"), "back", *pair, "dist", "most"))
        size = front.count()
        if not size:
            break
        # A front that is small by count is sent to the arcs, which then stay where they are.
        step = (F.broadcast(front) if size <= _SMALL else front).join(arcs, on)
        step = step.select(*pair, "back", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"), "most")
        # Only the search from the target tells nodes beyond its half.
        step = step.where(fits(F.col("dist")) & (F.col("back") | fits(2 * F.col("dist"))))
        reached = step.groupBy(*key).agg(F.min(F.struct("dist", "prev")).alias("n"))
        gone_on = front.select(*pair, "back", F.col("src").alias("node"), F.lit(False).alias("still"))
        old = best.join(gone_on, key, "left").select(*key, F.struct("dist", "prev").alias("o"), F.coalesce("still", "moved").alias("moved"))
        better = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.dist") < F.col("o.dist")))
        both = old.join(reached, key, "full_outer")
        best = written(both.select(*key, F.when(better, F.col("n")).otherwise(F.col("o")).alias("x"), (better | F.col("moved")).alias("moved")).select(*key, "x.*", "moved"))
    met = written(_met(best).groupBy(pair).agg(F.min("dist").alias("dist"), F.min_by("node", F.struct("dist", "node")).alias("meet")))
    # Each end of a pair is the source of its own search; the two ways to where they meet are put together.
    search = best.join(met, pair).select(F.struct(*pair, "back", "meet").alias("source"), "node", "prev")
    ways = path_of(search, F.col("node") == F.col("source.meet")).select("source.*", "path")
    ways = ways.groupBy(pair).agg(F.max(F.when(~F.col("back"), F.col("path"))).alias("fore"), F.max(F.when(F.col("back"), F.col("path"))).alias("rear"))
    ways = ways.select(*pair, F.concat("fore", F.slice(F.reverse("rear"), F.lit(2), F.size("rear"))).alias("path"))
    seen = best.groupBy(pair).agg(F.count_distinct("node").alias("seen"))
    out = asked.join(seen, pair, "left").join(met.drop("meet"), pair, "left").join(ways, pair, "left")
    return out.select("source", "target", "dist", "path", F.coalesce("seen", F.lit(0)).alias("seen"))


def _met(best: DataFrame) -> DataFrame:
    """(source, target, node, dist): nodes that both ends have reached, with the way by each of them."""
    by = lambda back: F.min(F.when(F.col("back") == back, F.col("dist")))
    return best.groupBy("source", "target", "node").agg((by(False) + by(True)).alias("dist")).where("dist IS NOT NULL")
