"""The tick of the hazard pipeline as one plan, and what people see of it, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators import channels as H
from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import graph as G
from ..session import cut
from ..sources import tables as T
from .impact import _GRID, _apart, _grid_roads, road_hits
from .network import _HEAD as _ROADS
from .network import _nodes, _open, _simple
from .risk import _HEAD, _obs


def tick_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every observed cell: fused where the model knows the cell (every third), by threshold elsewhere."""
    obs = _obs(spark, sf_dir).select(F.col("pixel_id").cast("long").alias("cell_id"), F.col("ratio").alias("exceedance"), "ml")
    risks = D.cell_risks(obs, obs.where("cell_id % 3 = 0").select("cell_id", F.col("ml").alias("model_p")))
    return risks.select("cell_id", F.round("p_fail", 6).alias("p_fail"), F.round("threshold_exceedance", 6).alias("threshold_exceedance"), F.round("confidence", 6).alias("confidence"), "model_version")


def _village_p(spark: SparkSession, sf_dir: str, risks: DataFrame) -> DataFrame:
    """Villages with the risk of their cell (0 where it is not observed)."""
    v = T.villages(spark, sf_dir).select("village_id", (F.col("village_id") % 150 + 1).alias("cell_id"), "pop")
    return v.join(risks.select("cell_id", "p_fail"), "cell_id", "left").select("village_id", "cell_id", "pop", F.coalesce("p_fail", F.lit(0.0)).alias("p"))


def tick_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame through the whole pipeline: risks, the flag, runouts, roads, priorities and cards, each
    with its number of rows and a sum over its main value."""
    risks = cut(tick_cells(spark, sf_dir))
    t = T.terrain(spark, sf_dir).join(risks.select("cell_id", "p_fail"), "cell_id")
    tri = t.withColumn("t", R.runout_triangle(F.col("x"), F.col("y"), F.col("aspect"), F.col("relief"), F.col("p_fail"))).where("t IS NOT NULL").select("cell_id", F.col("p_fail").alias("p"), "t")
    roads = road_hits(_grid_roads(spark, sf_dir), tri)
    v = _village_p(spark, sf_dir, risks)
    eps = v.withColumn("eps", R.eps_score(F.col("p"), F.col("pop"), F.col("village_id") % 7 / 6, F.lit(0.5)))
    cards = v.withColumn("stage", R.stage(F.col("p"))).where(F.col("stage").isin("ORANGE", "RED"))
    part = lambda d, name, value: d.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 4).alias("value")).select(F.lit(name).alias("part"), "n", "value")
    flag = risks.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.max("p_fail"), F.lit(0.0)), 4).alias("value")).select(F.lit("flag").alias("part"), "n", "value")
    out = part(risks, "cell_risks", F.col("p_fail")).unionByName(flag).unionByName(part(tri, "runouts", F.col("p"))).unionByName(part(roads.where("severed"), "severed_roads", F.col("p_blocked")))
    return out.unionByName(part(eps, "priorities", F.col("eps"))).unionByName(part(cards, "cards", F.col("p")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages with the roads that cut them off: those of their number and its neighbours."""
    k = F.col("village_id")
    n = F.broadcast(T.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))
    v = T.villages(spark, sf_dir).join(n)
    links = F.when(k % 5 != 0, F.array(k % F.col("n") + 1, (k * 3) % F.col("n") + 1)).otherwise(F.array().cast("array<bigint>"))
    return v.select("village_id", k.alias("place"), F.concat(F.lit("village "), k.cast("string")).alias("name"), F.col("pop").alias("population"), links.alias("severed_links"))


def _road_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cells = F.when(k % 7 != 0, F.array(k % 150 + 1, k * 2 % 150 + 1, k * 5 % 150 + 1)).otherwise(F.array().cast("array<bigint>"))
    return T.table(spark, sf_dir, "supplier").select(k.alias("edge_id"), cells.alias("cells"), (k % 3 == 0).alias("severed"), (k % 20 / 20).alias("p_blocked"), F.when(k % 4 != 0, F.col("s_name")).alias("name"))


def driving_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest cell behind every village's severed roads."""
    return D.driving_cells(_links(spark, sf_dir), _road_cells(spark, sf_dir), tick_cells(spark, sf_dir))


def card_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of threatened villages with their priority and isolation, where there are such."""
    k = F.col("village_id")
    v = T.villages(spark, sf_dir)
    cards = v.where("village_id % 3 = 0").select("village_id", F.concat(F.lit("alert-"), k.cast("string")).alias("alert_id"))
    priorities = v.where("village_id % 2 = 0").select("village_id", (k % 10 / 10).alias("eps"), R.eps_tier(k % 10 / 10).alias("tier"))
    isolations = v.where("village_id % 5 <> 0").select("village_id", F.col("pop").alias("population"), (k % 4 == 0).alias("isolated_now"))
    return D.card_context(cards, priorities, isolations)


def impacted_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads that are severed or likely blocked, with the first three villages behind each."""
    out = D.impacted_roads(_road_cells(spark, sf_dir), _links(spark, sf_dir))
    return out.select("edge_id", "severed", "p_blocked", "villages")


def _road_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as road risks of ticks (a tick is an hour); every fourth road has no name."""
    k = F.col("user_id")
    e = T.table(spark, sf_dir, "events")
    return e.select(F.date_trunc("hour", "ts").alias("t"), k.cast("string").alias("edge_id"), F.when(k % 4 != 0, F.concat(F.lit("NH-"), (k % 50).cast("string"), F.lit(" km "), k.cast("string"))).alias("name"), (F.col("value") / 500).alias("p_blocked"), (F.col("value") > 250).alias("severed"))


def lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by which a predicted severance came ahead of a recorded one, per nation as a recorded road."""
    day = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")) + F.make_dt_interval(days=(F.col("n_nationkey") % 9).cast("int"))
    actual = T.table(spark, sf_dir, "nation").select(F.concat(F.lit("nh-"), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("road"), day.alias("t"))
    return D.lead_times(_road_ticks(spark, sf_dir), actual).select("road", "t", "edge_id", "predicted_t", F.round("hours", 4).alias("hours"))


def flagged_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads flagged and severed at the latest tick."""
    return D.flagged_roads(_road_ticks(spark, sf_dir))


def commander_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the feed and the answer they give without an assistant."""
    v, r = T.villages(spark, sf_dir).select(R.eps_tier(F.col("village_id") % 10 / 10).alias("tier")), _road_cells(spark, sf_dir)
    routes = _cards(spark, sf_dir).where("shelter_id IS NOT NULL").select("shelter_id").distinct()
    c = D.commander_counts(v, r, routes)
    empty = D.commander_counts(v, r, routes.limit(0)).unionByName(D.commander_counts(v.limit(0), r, routes.limit(0)))
    return c.unionByName(empty).withColumn("answer", D.fallback_answer(F.col("route_count"), F.col("priority_count"), F.col("p1_count")))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards with a route to a shelter (every fourth has none)."""
    k = F.col("o_orderkey")
    avoid = F.when(k % 3 == 0, F.array(F.concat(F.lit("road "), (k % 11).cast("string")), F.concat(F.lit("road "), (k % 13).cast("string")))).otherwise(F.array().cast("array<string>"))
    return T.table(spark, sf_dir, "orders").select(k.alias("place"), (F.col("o_custkey") % 40).alias("village_id"), F.when(k % 4 != 0, k % 6).alias("shelter_id"), avoid.alias("avoid"))


def verified_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three routes to distinct shelters of every village."""
    return D.verified_routes(_cards(spark, sf_dir), by="village_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit events of users' alerts with payloads."""
    e, k = T.table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("AI_FLAGGED", "DDMA_APPROVED", "STOOD_DOWN", "DISSEMINATED", "VILLAGE_ACKNOWLEDGED", "ESCALATED", "DELIVERED"))), (k * 5 % 7 + 1).cast("int"))
    n = k.cast("string")
    body = (
        F.when(k * 5 % 7 == 0, F.concat(F.lit('{"aoi_id":"demo","cell_count":'), n, F.lit(',"max_p_fail":'), F.format_string("%.2f", k % 90 / 100), F.lit("}")))
        .when(k * 5 % 7 < 3, F.concat(F.lit('{"decision":"modified"'), F.when(k % 2 == 0, F.concat(F.lit(',"notes":"see '), n, F.lit('"'))).otherwise(""), F.lit("}")))
        .when(k * 5 % 7 == 3, F.concat(F.lit('{"channels":["mesh","sms"],"total_recipients":'), n, F.lit(',"total_delivered":'), (k % 50).cast("string"), F.lit(',"total_acknowledged":'), (k % 20).cast("string"), F.lit("}")))
        .when(k * 5 % 7 == 5, F.lit('{"to_stage":"RED"}'))
        .otherwise(F.concat(F.lit('{"village_id":"'), n, F.lit('"}')))
    )
    return e.select((F.col("user_id") % 97).alias("alert_id"), k.alias("seq"), kind.alias("kind"), F.concat(F.lit("officer "), (k % 5).cast("string")).alias("actor"), body.alias("payload"))


def trail_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit event in words."""
    return _events(spark, sf_dir).select("seq", D.event_label(F.col("kind")).alias("label"), D.event_summary(F.col("kind"), F.col("actor"), F.col("payload")).alias("summary"))


def alert_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one alert."""
    return D.alert_trail(_events(spark, sf_dir), 7).select("alert_id", "seq", "kind")


def missing_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that alerts have not reached."""
    return D.missing_stages(_events(spark, sf_dir).where("seq % 3 = 0"))


_T = "2024-01-29T12:00:00+00:00"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.element_at(F.array(*map(F.lit, ("approved", "modified", "rejected"))), (k % 3 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), k.cast("string")).alias("alert_id"), F.concat(F.lit("o"), (k % 4).cast("string")).alias("officer_id"), decision.alias("decision"), F.lit("").alias("notes"), F.lit(_T).alias("t"),
        F.col("o_custkey").cast("string").alias("village_id"), F.when(k % 2 == 0, "RED").otherwise("ORANGE").alias("stage"), F.col("o_orderpriority").alias("headline"), k.alias("k"),
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    channel = F.element_at(F.array(*map(F.lit, ("broadcast", "sms", "push", "mesh"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("alert_id"), F.lit("v").alias("village_id"), channel.alias("channel"), (n * 10).alias("recipients"), (n * 7).alias("delivered"), (n * 3).alias("acknowledged"), F.lit(_T).alias("t"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that decisions, disseminations and acknowledgements leave behind, with a digest of their payloads."""
    d = _decisions(spark, sf_dir)
    acks = d.where("k % 5 = 0").select("alert_id", "village_id", "t")
    out = D.decision_events(d).unionByName(D.dissemination_events(_results(spark, sf_dir))).unionByName(D.acknowledgement_events(acks))
    return out.select("event_id", "kind", "actor", F.md5("payload").alias("payload_md5"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of the orders' cards; half of them have been decided on."""
    d = _decisions(spark, sf_dir)
    cards = d.select("alert_id", "village_id", "stage", F.col("headline").alias("reason"), F.when(F.col("k") % 3 == 0, F.lit("go now")).when(F.col("k") % 3 == 1, F.lit("")).alias("message"), "officer_id", "t")
    decided = D.decision_events(d.where("k % 2 = 0")).select("alert_id", "kind")
    return D.announcements(cards, decided, _results(spark, sf_dir))


def went_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong per conversation: turns by users as warnings, by assistants as road events; empty texts are skipped."""
    text = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.substring("text", 1, 30))
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    turns = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    g = c.groupBy(F.col("conv_id").alias("id")).agg(turns("user").alias("warnings"), turns("assistant").alias("road_events"), F.array(F.concat(F.lit("story "), F.max("turn").cast("string"))).alias("narration"))
    return D.went_wrong(g)


def missed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per recorded road about how the replay did."""
    out = lead_times(spark, sf_dir)
    return out.select("road", D.missed_line(F.length("road") % 2 == 0, F.col("edge_id"), F.col("road"), F.col("hours"), F.date_format("t", "yyyy-MM-dd")).alias("line"))


def voice_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per voice model of their language (made of the language and the id)."""
    lang = F.element_at(F.array(*map(F.lit, ("hi-IN", "ml-IN", " pa-IN ", "xx", "as-IN"))), (F.col("doc_id") % 5 + 1).cast("int"))
    model, fallback = D.voice_model(lang)
    return T.table(spark, sf_dir, "documents").groupBy(model.alias("model"), fallback.alias("fallback")).agg(F.count(F.lit(1)).alias("n"))


def resolved_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier for every order: the one asked for, else the first of its nation, else the first of all."""
    k = F.col("o_orderkey")
    asked = T.table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 3 == 0, k % 2000).alias("fixture_id"), (k % 31).alias("aoi_id"))
    return D.resolve_fixtures(asked, T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("aoi_id"), F.col("s_suppkey").alias("place")))


def replay_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by how far their shipping lies between the order's date and a number of days behind it (null for none),
    in hundredths, halves up: 23 of 40 days are 0.58, whatever the nearest binary number to 0.575 is."""
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    li = T.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.date_add("start", F.col("l_partkey").cast("int") % 90)
    p = F.round(D.progress(F.to_date("l_shipdate"), F.col("start"), end), 2)
    return li.groupBy(p.alias("progress")).agg(F.count(F.lit(1)).alias("n"))


def _graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as nodes of an infrastructure graph."""
    s, n = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    state = F.when(k % 7 == 0, "PLAUSIBILITY_REJECTED").when(k % 7 == 1, "SUPERSEDED").when(k % 7 == 2, "VERIFIED")
    a = s.select(F.concat(F.lit("S"), k).alias("id"), F.when(k % 2 == 0, "Hospital").otherwise("Culvert").alias("label"), F.col("s_nationkey").cast("string").alias("aoi_id"), state.alias("verification_state"), F.when(k % 3 != 0, k / 100.0).alias("lat"), (k / 50.0).alias("lon"), F.when(k % 5 == 0, k * 1.0).alias("elev_m"), F.when(k % 4 == 0, F.col("s_name")).alias("name"))
    b = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Substation").alias("label"), F.col("n_nationkey").cast("string").alias("aoi_id"), F.lit(None).cast("string").alias("verification_state"), F.lit(1.0).alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("elev_m"), F.col("n_name").alias("name"))
    return a.unionByName(b)


def _graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, k = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation"), F.col("s_suppkey")
    a = s.select(F.concat(F.lit("N"), "s_nationkey").alias("src_id"), F.concat(F.lit("S"), k).alias("dst_id"), F.when(k % 3 == 0, "CONNECTS_TO").otherwise("POWERS").alias("rel_type"))
    b = n.select(F.concat(F.lit("N"), "n_nationkey").alias("src_id"), F.concat(F.lit("N"), (F.col("n_nationkey") * 7 + 3) % 25).alias("dst_id"), F.when(F.col("n_nationkey") % 4 == 0, "CONNECTS_TO").otherwise("SUPPLIES").alias("rel_type"))
    return a.unionByName(b)


def node_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted hospitals, cells of placed nodes, and the edges into and out of a node, as counts."""
    n, e = _graph_nodes(spark, sf_dir), _graph_edges(spark, sf_dir)
    count = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    cells = D.node_cells(n)
    out = count(D.nodes_by_label(D.trusted_nodes(n), "Hospital"), "trusted hospitals").unionByName(count(D.nodes_by_label(n, "Culvert", "3"), "culverts of 3")).unionByName(count(cells, "cells")).unionByName(count(cells.where("elev_m = 10"), "cells of unknown height"))
    return out.unionByName(count(D.edges_of(e, "N3"), "out")).unionByName(count(D.edges_of(e, "N3", ("POWERS",)), "out POWERS")).unionByName(count(D.edges_of(e, "N3", incoming=True), "in"))


def subgraph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failing nations reach in three hops over supply and power, roads one hop, among trusted nodes."""
    nodes = D.trusted_nodes(_graph_nodes(spark, sf_dir)).select(F.col("id").alias("node"), "label")
    edges = _graph_edges(spark, sf_dir).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("rel_type").alias("rel"))
    anchors = T.table(spark, sf_dir, "nation").where("n_nationkey % 6 = 1").select(F.concat(F.lit("N"), "n_nationkey").alias("anchor"))
    return G.subgraph(anchors, nodes, edges, ("POWERS", "SUPPLIES"), ("CONNECTS_TO",))


def _route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _simple(spark, sf_dir)
    return cut(e.select("a", "b", "edge_id", "length", "severed", "p_blocked", F.when(F.col("a") % 3 == 0, F.concat(F.lit("NH-"), F.col("b").cast("string"))).when(F.col("a") % 3 == 1, "").alias("ref"), F.when(F.col("b") % 2 == 0, F.concat(F.lit("Road "), F.col("a").cast("string"))).alias("name")))


def avoided_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severed roads on the usual ways from nation 0, in the order in which they are met."""
    e = _route_edges(spark, sf_dir)
    seeds = _nodes(spark, sf_dir).where("node = 0").select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.shortest(seeds, G.both_ways(e.withColumn("w", F.col("length")), "w"))
    return G.avoided_roads(G.path_of(best), e).select("node", F.array_join("roads", ", ").alias("roads"))


def severed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All severed roads on the usual ways of a nation to any of three targets, in order."""
    e = _route_edges(spark, sf_dir)
    seeds = _nodes(spark, sf_dir).where("node IN (0, 7, 13)").select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    best = G.shortest(seeds, G.both_ways(e.withColumn("w", F.col("length")), "w"))
    s = G.steps_of(G.path_of(best)).withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}).drop("a", "b")
    met = s.join(e.where("severed").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "edge_id"), ["_a", "_b"]).groupBy("node").agg(F.sort_array(F.collect_set("edge_id")).alias("links"))
    return _nodes(spark, sf_dir).join(met, "node", "left").select("node", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the best open ways from nation 0; half of the roads have a bend."""
    e = cut(_open(spark, sf_dir))
    seeds = _nodes(spark, sf_dir).where("node = 0").select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    paths = G.path_of(G.shortest(seeds, G.both_ways(e, "w")))
    point = lambda x, y: F.struct((x * 1.0).alias("x"), (y * 1.0).alias("y"))
    n = _nodes(spark, sf_dir).select("node", (F.col("node") * 1.0).alias("x"), (F.col("node") * 2.0).alias("y"))
    bend = F.when((F.col("a") + F.col("b")) % 2 == 1, F.array(point(F.col("b"), F.col("b") * 2), point(F.col("a") + F.col("b"), F.lit(-1)), point(F.col("a"), F.col("a") * 2)))
    lines = G.route_lines(paths, n, e.select("a", "b", F.col("b").alias("u"), bend.alias("geometry")))
    return lines.select("node", F.concat_ws(" ", F.transform("line", lambda p: F.concat_ws(",", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string")))).alias("line"))


def budgeted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of a vehicle from nations 0 and 5 to all others over roads under water."""
    k = F.col("node")
    nodes = _nodes(spark, sf_dir).select("node", (k % 9 / 25).alias("depth"), (k * 2.0).alias("slope"), (k % 11 != 10).alias("passable"))
    e = T.roads(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("length") / 15).alias("base_s"), (F.col("p_blocked") * 0.6).alias("depth"), (F.col("p_blocked") < 0.95).alias("passable"))
    pairs = _nodes(spark, sf_dir).where("node IN (0, 5)").select(F.col("node").alias("source")).join(_nodes(spark, sf_dir).select(F.col("node").alias("target")), how="cross")  # the query set: two sources, all targets
    out = G.budgeted_routes(pairs, nodes, e)
    return out.select("source", "target", "reachable", F.round("eta_s", 1).alias("eta_s"), F.array_join("path", ">").alias("path"), F.coalesce(F.array_join("avoided", ","), F.lit("")).alias("avoided"))


def tactical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders per nation from its suppliers as impacted assets."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("Substation", "Hospital", "Culvert", "DrainageNode", "Bridge"))), (k * 3 % 5 + 1).cast("int"))
    s = T.table(spark, sf_dir, "supplier")
    impacted = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("aoi_id"), k.alias("place"), F.concat(F.lit("S"), k).alias("asset_id"), kind.alias("asset_type"), (k % 9 / 4).alias("hours"), (k % 40).alias("exposure"))
    chokes = s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("aoi_id"), F.concat(F.lit("C"), k).alias("node_id"), (k % 17).alias("criticality"))
    routes = T.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("aoi_id"), (F.col("n_nationkey") * 60.0 + 66).alias("eta_s"), F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("J1"), F.lit("J2"), F.lit("J3"))).alias("avoided"), F.when(F.col("n_nationkey") % 3 == 0, "B1").alias("bridge_id"))
    return D.recommendations(impacted, chokes, routes)


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missions to every supplier's place: corners and roles as read back from the GeoJSON."""
    k = F.col("s_suppkey")
    m = T.table(spark, sf_dir, "supplier").select(k.alias("id"), F.from_json(D.mission(92.6 + k / 100, 23.6 + k / 200, k.cast("string")), "features array<struct<geometry:struct<type:string>,properties:struct<role:string,target_node_id:string>>>").alias("m"), D.mission(92.6 + k / 100, 23.6 + k / 200, k.cast("string"), "UAV_DRONE").alias("js"))
    return m.select("id", F.size("m.features").cast("long").alias("features"), F.array_join(F.transform("m.features", lambda f: F.coalesce(f["properties"]["role"], f["geometry"]["type"])), ",").alias("roles"), F.round(F.get_json_object("js", "$.features[2].geometry.coordinates[0]").cast("double"), 6).alias("sweep_lon"))


def robotic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after robots' readings (events as readings of suppliers' nodes): the newest per node counts."""
    k = F.col("event_id")
    n = F.broadcast(T.table(spark, sf_dir, "supplier").agg((F.count(F.lit(1)) * 2).alias("n")))
    r = T.table(spark, sf_dir, "events").join(n).select(F.concat(F.lit("m"), k).alias("mission_id"), (k % F.col("n")).alias("node_id"), (F.col("value") / 300).alias("depth"), (k % 100 * 1.0).alias("blockage"), (k % 10 / 10).alias("integrity"), "ts", k.alias("k")).withColumn("observed_at", F.struct("ts", "k"))
    nodes = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("is_passable"))
    out = D.merge_nodes(nodes, D.robotic_updates(r))
    return out.select("id", "is_passable", F.round("water_depth_m", 3).alias("water_depth_m"), "blockage_pct", "mission_id")


def saved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' plans with their name-based ids: all differ, all are of version 5 and the right variant."""
    at = F.concat(F.lit("2024-01-29T12:00:"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    p = T.table(spark, sf_dir, "nation").select(D.saved_plan_id(at, F.concat(F.lit('{"name":"'), "n_name", F.lit('"}'))).alias("id"))
    return p.agg(F.count(F.lit(1)).alias("plans"), F.countDistinct("id").alias("ids"), F.count_if(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("valid"))


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reports of one category, newest first, as a store lists them."""
    r = T.reports(spark, sf_dir).select("id", F.col("category").alias("aoi_id"), "status", F.col("t").alias("created_at"))
    return D.stored_reports(r, "click", "open").select("id", "created_at")


def client_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest events of every user."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id")
    return D.latest_rows(e, "user_id", "event_id", 5)


def explained_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two weightiest groups of every terrain cell as a map, written out."""
    t = T.terrain(spark, sf_dir).select("cell_id", (F.col("slope") - 25).alias("a"), (F.col("elevation") / 100 - 12).alias("b"), (F.col("relief") / 10 - 10).alias("c"))
    m = D.explained_cells(E.attributions(t, "cell_id", {"slope": ["a"], "height": ["b"], "relief": ["c"]}, top=2))
    return m.select("cell_id", F.array_join(F.transform(F.map_entries("parts"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.5f", e["value"]))), " ").alias("parts"))


def asset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the share of its even parts among its expected parts, and precision of its first three."""
    li = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("found"), F.collect_set(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey"))).alias("expected"))
    return li.select("l_orderkey", F.round(D.recall(F.col("expected"), F.filter("found", lambda x: x % 2 == 0)), 6).alias("recall"))


def shelter_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and medical cases per shelter, from lines as entries of a register."""
    li = T.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("shelter"))
    return li.agg(F.sum(F.col("l_quantity").cast("long")).alias("heads"), F.count_if(F.col("l_partkey") % 9 == 0).alias("medical"))


def signboard_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths read off signboards count as a responder's claims: verified unless they are negative."""
    e = T.table(spark, sf_dir, "events").where("event_id % 10 = 0").select("event_id", (F.col("value") / 100 - 0.2).alias("depth"))
    state = F.when(F.col("depth") < 0, "PENDING").otherwise("VERIFIED")
    return e.select("event_id", state.alias("state"), F.when(F.col("depth") < 0, 0.78).otherwise(0.96).alias("confidence"))


def channel_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alerts sent over all channels: outcomes by the seeded generator (no SQL can draw like it)."""
    o = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("alert_id"), (F.col("o_custkey") % 30).alias("recipients"))
    return H.channel_results(o).withColumn("longest_s", F.round("longest_s", 6))


def mesh_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones reached and acknowledged over the mesh, and the longest latency, per area."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("alert_id"), (F.col("o_custkey") % 30).alias("recipients"), (F.col("o_custkey") % 10).alias("area"))
    out = H.channel_results(o.select("alert_id", "recipients"), ("mesh",)).join(o.select("alert_id", "area"), "alert_id")
    return out.groupBy("area").agg(F.sum("delivered").alias("delivered"), F.sum("acknowledged").alias("acknowledged"), F.round(F.max("longest_s"), 6).alias("longest_s"))


def photo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as photos: their bytes behind a PNG's head of known sides; every third declares another type."""
    k = F.col("page_id")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(k % 900 + 1), 8, "0")), F.unhex(F.lpad(F.hex(k % 700 + 2), 8, "0")), F.col("html").cast("binary"))
    url = F.concat(F.lit("data:image/"), F.when(k % 3 == 0, "jpeg").otherwise("png"), F.lit(";base64,"), F.base64(png))
    parts = H.photo(url)
    p = T.table(spark, sf_dir, "pages").select("page_id", F.octet_length(parts["data"]).cast("long").alias("bytes"), parts["mime"].alias("mime"), parts["width"].alias("width"), parts["height"].alias("height"))
    return p.withColumn("quality", R.image_quality(F.col("bytes"), F.col("width"), F.col("height")))


QUERIES = {f.__name__: f for f in (
    channel_results, mesh_rollup, photo_sizes, tick_cells, tick_result, driving_cells, card_context, impacted_roads, lead_times, flagged_roads, commander_answers, verified_routes, trail_summaries, alert_trail, missing_stages, audit_events, announcements,
    went_wrong, missed_lines, voice_models, resolved_fixtures, replay_progress, node_filters, subgraph_paths, avoided_roads, severed_union, route_lines, budgeted_routes, tactical_orders, missions, robotic_nodes,
    saved_plans, stored_reports, client_history, explained_cells, asset_recall, shelter_register, signboard_claims,
)}

_Q = "least(1 - 1e-9, greatest(1e-9, p))"
_RISK = f"""rk AS (SELECT *, CASE WHEN known THEN 'model' ELSE 'threshold_only_v1' END AS model_version, round(1 + {_Q} * log2({_Q}) + (1 - {_Q}) * log2(1 - {_Q}), 6) AS confidence FROM (
    SELECT CAST(pixel_id AS BIGINT) AS cell_id, ratio, CAST(pixel_id AS BIGINT) % 3 = 0 AS known, greatest(CASE WHEN CAST(pixel_id AS BIGINT) % 3 = 0 THEN ml ELSE 0 END, least(1, greatest(0, ratio))) AS p FROM obs)),
    rr AS (SELECT cell_id, round(p, 6) AS p_fail FROM rk)"""
_RHEAD = f"{_HEAD}, {_RISK}"
_TRI = f"""b AS (SELECT *, relief / tan(radians(25)) AS len, radians(aspect) AS be FROM ({T.SQL['terrain']}) JOIN rr USING (cell_id) WHERE p_fail >= 0.5 AND relief > 0),
    tri AS (SELECT cell_id, p_fail AS p, x AS ax, y AS ay, x + len * sin(be) + len * tan(radians(15)) * cos(be) AS lx, y + len * cos(be) - len * tan(radians(15)) * sin(be) AS ly,
    x + len * sin(be) - len * tan(radians(15)) * cos(be) AS rx, y + len * cos(be) + len * tan(radians(15)) * sin(be) AS ry FROM b)"""
_LINKS = """n AS (SELECT count(*) AS n FROM supplier), ln AS (SELECT c_custkey AS village_id, unnest(CASE WHEN c_custkey % 5 <> 0 THEN list_distinct([c_custkey % n + 1, c_custkey * 3 % n + 1]) ELSE [] END) AS edge_id FROM customer, n)"""
_RCELLS = """rc AS (SELECT s_suppkey AS edge_id, CASE WHEN s_suppkey % 7 <> 0 THEN [s_suppkey % 150 + 1, s_suppkey * 2 % 150 + 1, s_suppkey * 5 % 150 + 1] ELSE [] END AS cells, s_suppkey % 3 = 0 AS severed, (s_suppkey % 20) / 20.0::DOUBLE AS p_blocked FROM supplier)"""
_TICKS = """tk AS (SELECT date_trunc('hour', ts) AS t, CAST(user_id AS VARCHAR) AS edge_id, CASE WHEN user_id % 4 <> 0 THEN 'NH-' || (user_id % 50) || ' km ' || user_id END AS name, value / 500 AS p_blocked, value > 250 AS severed FROM events)"""
_LEAD = f"""{_TICKS}, ac AS (SELECT 'nh-' || n_nationkey || ' ' AS road, TIMESTAMP '2024-01-15' + to_days(n_nationkey % 9) AS t FROM nation),
    ld AS (SELECT road, ac.t, arg_min(tk.edge_id, (tk.t, tk.edge_id)) AS edge_id, min(tk.t) AS predicted_t FROM ac LEFT JOIN tk ON severed AND name <> '' AND contains(lower(name), lower(road)) GROUP BY 1, 2),
    lt AS (SELECT *, round((epoch_us(t) - epoch_us(predicted_t)) / 3.6e9::DOUBLE, 4) AS hours FROM ld)"""
_KINDS = "['AI_FLAGGED', 'DDMA_APPROVED', 'STOOD_DOWN', 'DISSEMINATED', 'VILLAGE_ACKNOWLEDGED', 'ESCALATED', 'DELIVERED']"
_CARDS = """ca AS (SELECT o_orderkey AS place, o_custkey % 40 AS village_id, o_orderkey % 6 AS shelter_id, CASE WHEN o_orderkey % 3 = 0 THEN 'road ' || (o_orderkey % 11) || ', road ' || (o_orderkey % 13) ELSE 'none listed' END AS avoid FROM orders WHERE o_orderkey % 4 <> 0)"""
_REL = """nd AS (SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Hospital' ELSE 'Culvert' END AS label FROM supplier WHERE s_suppkey % 7 > 1 UNION ALL SELECT 'N' || n_nationkey, 'Substation' FROM nation),
    ed AS (SELECT 'N' || s_nationkey AS src, 'S' || s_suppkey AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 'CONNECTS_TO' ELSE 'POWERS' END AS rel FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, 'N' || ((n_nationkey * 7 + 3) % 25), CASE WHEN n_nationkey % 4 = 0 THEN 'CONNECTS_TO' ELSE 'SUPPLIES' END FROM nation)"""
_USUAL = """lw AS (SELECT a AS s, b AS d, length AS w, severed, edge_id, a, b FROM sev UNION ALL SELECT b, a, length, severed, edge_id, a, b FROM sev),
    wl AS (SELECT n_nationkey AS source, n_nationkey AS node, 0.0::DOUBLE AS dist, []::VARCHAR[] AS cut, 0 AS step FROM nation WHERE n_nationkey IN ({seeds})
        UNION ALL SELECT source, node, min(dist), arg_min(cut, dist), step + 1 FROM (SELECT w1.source, w1.node, w1.dist, w1.cut, w1.step FROM wl w1
            UNION ALL SELECT w2.source, e.d, w2.dist + e.w, CASE WHEN e.severed THEN list_append(w2.cut, {what}) ELSE w2.cut END, w2.step FROM wl w2 JOIN lw e ON e.s = w2.node) WHERE step < 24 GROUP BY 1, 2, step),
    us AS (SELECT source, node, arg_min(cut, dist) AS cut FROM wl GROUP BY 1, 2)"""
_LABEL = "CASE WHEN e.a % 3 = 0 THEN 'NH-' || e.b WHEN e.b % 2 = 0 THEN 'Road ' || e.a ELSE 'unnamed segment ' || e.edge_id END"


def _esc(text: str) -> str:
    return text.replace("'", "''")


def _of(kind: str, what: str) -> str:
    return f"arg_min({what}, place) FILTER (asset_type = '{kind}')"


ORACLES = {
    "photo_sizes": """WITH p AS (SELECT page_id, page_id % 3 <> 0 AS ok, 24 + octet_length(encode(html)) AS n, page_id % 900 + 1 AS w, page_id % 700 + 2 AS h FROM pages), q AS (SELECT *, least(w, h) AS lo, greatest(w, h) AS hi FROM p)
        SELECT page_id, CASE WHEN ok THEN n END AS bytes, CASE WHEN ok THEN 'image/png' END AS mime, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height,
            round(CASE WHEN ok THEN least(1, 0.15::DOUBLE + CASE WHEN n >= 20000 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n >= 100000 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN lo >= 480 THEN 0.25::DOUBLE WHEN lo >= 320 THEN 0.12::DOUBLE ELSE 0 END
                + CASE WHEN hi >= 640 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN hi >= 960 THEN 0.25::DOUBLE ELSE 0 END) ELSE 0.15::DOUBLE END, 3) AS quality FROM q""",
    "tick_cells": f"{_RHEAD} SELECT cell_id, round(p, 6) AS p_fail, round(ratio, 6) AS threshold_exceedance, confidence, model_version FROM rk",
    "tick_result": f"""{_RHEAD}, {_TRI}, roads AS ({_GRID}), hit AS (SELECT edge_id, is_bridge, max(p) AS top FROM roads JOIN tri ON least(ux, vx) <= greatest(ax, lx, rx) AND greatest(ux, vx) >= least(ax, lx, rx) AND least(uy, vy) <= greatest(ay, ly, ry) AND greatest(uy, vy) >= least(ay, ly, ry)
            WHERE NOT ({_apart()}) GROUP BY 1, 2),
        vp AS (SELECT v.village_id, pop, coalesce(p_fail, 0) AS p FROM ({T.SQL['villages']}) v LEFT JOIN rr ON rr.cell_id = village_id % 150 + 1),
        parts AS (SELECT 'cell_risks' AS part, count(*) AS n, sum(p_fail) AS value FROM rr UNION ALL SELECT 'flag', count(*), max(p_fail) FROM rr UNION ALL SELECT 'runouts', count(*), sum(p) FROM tri
            UNION ALL SELECT 'severed_roads', count(*), sum(top) FROM hit WHERE top >= CASE WHEN is_bridge THEN 0.5 ELSE 0.7 END
            UNION ALL SELECT 'priorities', count(*), sum(0.35 * p + 0.25 * least(pop / 200.0::DOUBLE, 1) + 0.25 * (village_id % 7) / 6.0::DOUBLE + 0.075) FROM vp UNION ALL SELECT 'cards', count(*), sum(p) FROM vp WHERE p >= 0.5)
        SELECT part, n, round(coalesce(value, 0), 4) AS value FROM parts""",
    "driving_cells": f"""{_RHEAD}, {_LINKS}, {_RCELLS}, x AS (SELECT village_id, arg_min(rr.cell_id, (-p_fail, rr.cell_id)) AS cell_id, max(p_fail) AS p_fail FROM (SELECT village_id, unnest(cells) AS cell_id FROM ln JOIN rc USING (edge_id)) JOIN rr USING (cell_id) GROUP BY 1)
        SELECT c_custkey AS village_id, cell_id, p_fail FROM customer LEFT JOIN x ON village_id = c_custkey""",
    "card_context": f"""{T.with_tables('villages')} SELECT village_id, 'alert-' || village_id AS alert_id, CASE WHEN village_id % 2 = 0 THEN (village_id % 10) / 10.0::DOUBLE END AS eps,
        CASE WHEN village_id % 2 = 0 THEN CASE WHEN village_id % 10 >= 7 THEN 'P1' WHEN village_id % 10 >= 4 THEN 'P2' ELSE 'P3' END END AS tier, CASE WHEN village_id % 5 <> 0 THEN pop END AS population, CASE WHEN village_id % 5 <> 0 THEN village_id % 4 = 0 END AS isolated_now FROM villages WHERE village_id % 3 = 0""",
    "impacted_roads": f"""WITH {_LINKS}, {_RCELLS}, f AS (SELECT edge_id, list('village ' || village_id ORDER BY village_id) AS vs FROM ln GROUP BY 1)
        SELECT edge_id, severed, p_blocked, coalesce(vs[1:3], []::VARCHAR[]) AS villages FROM rc LEFT JOIN f USING (edge_id) WHERE severed OR p_blocked >= 0.45""",
    "lead_times": f"WITH {_LEAD} SELECT road, t, edge_id, predicted_t, hours FROM lt",
    "flagged_roads": f"WITH {_TICKS} SELECT count(*) FILTER (p_blocked > 0) AS flagged, count(*) FILTER (severed) AS severed, coalesce(list_sort(list(DISTINCT coalesce(name, edge_id)) FILTER (severed)), []::VARCHAR[]) AS names FROM tk WHERE t = (SELECT max(t) FROM tk)",
    "commander_answers": f"""WITH {_CARDS}, k AS (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM customer WHERE c_custkey % 10 >= 7) AS b, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS c, (SELECT count(DISTINCT shelter_id) FROM ca) AS d)
        SELECT a AS priority_count, b AS p1_count, c AS affected_road_count, d AS route_count, printf('{D.WITH_ROUTES}', d) AS answer FROM k UNION ALL SELECT a, b, c, 0, printf('{D.WITH_PRIORITIES}', a, b) FROM k UNION ALL SELECT 0, 0, c, 0, '{D.WAITING}' FROM k""",
    "verified_routes": f"""WITH {_CARDS}, f AS (SELECT village_id, shelter_id, min(place) AS place, arg_min(avoid, place) AS avoid FROM ca GROUP BY 1, 2)
        SELECT village_id, shelter_id, place, row_number() OVER (PARTITION BY village_id ORDER BY place)::INT AS route_rank, 'Avoid: ' || avoid AS risk_snapshot FROM f QUALIFY route_rank <= 3""",
    "trail_summaries": f"""SELECT event_id AS seq, CASE k WHEN 0 THEN 'AI Flagged' WHEN 1 THEN 'DDMA Approved' WHEN 2 THEN 'Stood Down (rejected)' WHEN 3 THEN 'Disseminated' WHEN 4 THEN 'Village Acknowledged' WHEN 5 THEN 'Escalated' ELSE 'Delivered' END AS label,
        CASE k WHEN 0 THEN 'demo · ' || event_id || ' cells · max p_fail ' || (event_id % 90) || '% · 0 action card(s) issued' WHEN 3 THEN (event_id % 20) || '/' || event_id || ' recipients acknowledged over mesh, sms (' || (event_id % 50) || ' delivered)'
            WHEN 4 THEN 'Acknowledged by officer ' || (event_id % 5) WHEN 5 THEN '-> RED' WHEN 6 THEN 'village_id: ' || event_id ELSE 'modified by officer ' || (event_id % 5) || CASE WHEN event_id % 2 = 0 THEN ' — "see ' || event_id || '"' ELSE '' END END AS summary
        FROM (SELECT event_id, event_id * 5 % 7 AS k FROM events)""",
    "alert_trail": f"SELECT user_id % 97 AS alert_id, event_id AS seq, ({_KINDS})[event_id * 5 % 7 + 1] AS kind FROM events WHERE user_id % 97 = 7",
    "missing_stages": """WITH e AS (SELECT DISTINCT user_id % 97 AS alert_id, CASE event_id * 5 % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE -1 END AS s FROM events WHERE event_id % 3 = 0),
        d AS (SELECT * FROM (VALUES (0, 'AI Flagged'), (1, 'DDMA Decision'), (2, 'Disseminated'), (3, 'Village Acknowledged')) t(stage, label))
        SELECT alert_id, stage::INT AS stage, label FROM (SELECT DISTINCT alert_id FROM e) a, d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.alert_id = a.alert_id AND s = stage)""",
    "audit_events": f"""WITH o AS (SELECT 'a' || o_orderkey AS alert_id, o_orderkey AS k, (['approved', 'modified', 'rejected'])[o_orderkey % 3 + 1] AS dec, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'RED' ELSE 'ORANGE' END AS stage FROM orders),
        r AS (SELECT 'a' || l_orderkey AS alert_id, list_sort(list(DISTINCT (['broadcast', 'sms', 'push', 'mesh'])[l_linenumber % 4 + 1])) AS ch, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1)
        SELECT 'evt-ddma-' || alert_id || '-{_T}' AS event_id, CASE WHEN dec = 'rejected' THEN 'STOOD_DOWN' ELSE 'DDMA_APPROVED' END AS kind, 'ddma:o' || (k % 4) AS actor,
            md5('{{"decision":"' || dec || '","notes":"","village_id":"' || o_custkey || '","stage":"' || stage || '","headline":"' || o_orderpriority || '"}}') AS payload_md5 FROM o
        UNION ALL SELECT 'evt-dissem-' || alert_id || '-{_T}', 'DISSEMINATED', 'system', md5('{{"village_id":"v","channels":["' || array_to_string(ch, '","') || '"],"total_recipients":' || q * 10 || ',"total_delivered":' || q * 7 || ',"total_acknowledged":' || q * 3 || '}}') FROM r
        UNION ALL SELECT 'evt-ack-' || alert_id || '-{_T}', 'VILLAGE_ACKNOWLEDGED', 'village:' || o_custkey, md5('{{"village_id":"' || o_custkey || '"}}') FROM o WHERE k % 5 = 0""",
    "announcements": f"""WITH r AS (SELECT l_orderkey AS k, count(*) AS c, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1)
        SELECT 'ann-a' || o_orderkey || '-{_T}' AS id, 'a' || o_orderkey AS alert_id, CAST(o_custkey AS VARCHAR) AS village_id, CASE WHEN o_orderkey % 2 = 0 THEN 'RED' ELSE 'ORANGE' END AS stage, CASE WHEN o_orderkey % 3 = 0 THEN 'go now' ELSE o_orderpriority END AS message,
            'o' || (o_orderkey % 4) AS issued_by, coalesce(c, 0) AS channels, coalesce(q * 10, 0)::BIGINT AS recipients, coalesce(q * 7, 0)::BIGINT AS delivered, coalesce(q * 3, 0)::BIGINT AS acknowledged, o_orderkey % 2 <> 0 AS approves FROM orders LEFT JOIN r ON k = o_orderkey""",
    "went_wrong": """WITH c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN '' ELSE substr(text, 1, 30) END AS text FROM conversations)
        SELECT conv_id AS id, coalesce(nullif(first(text ORDER BY turn, text) FILTER (role = 'user'), ''), nullif(first(text ORDER BY turn, text) FILTER (role = 'assistant'), ''), 'story ' || max(turn)) AS line FROM c GROUP BY 1""",
    "missed_lines": f"""WITH {_LEAD} SELECT road, CASE WHEN length(road) % 2 <> 0 THEN '{_esc(D.NO_HISTORY)}' WHEN hours IS NOT NULL THEN 'Our system flagged ' || edge_id || ' as severed ' || printf('%.1f', abs(hours)) || 'h' || CASE WHEN hours >= 0 THEN ' ahead of' ELSE ' behind' END
        || ' the official ' || road || ' severance recorded at ' || strftime(t, '%Y-%m-%d') || '.' ELSE '{_esc(D.NO_MATCH)}' END AS line FROM lt""",
    "voice_models": "SELECT CASE WHEN doc_id % 5 IN (1, 2, 4) THEN 'fallback' ELSE 'flash' END AS model, doc_id % 5 IN (1, 2, 4) AS fallback, count(*) AS n FROM documents GROUP BY 1, 2",
    "resolved_fixtures": """WITH f AS (SELECT s_nationkey, min(s_suppkey) AS m FROM supplier GROUP BY 1) SELECT o_orderkey AS request_id, coalesce(s.s_suppkey, f.m, (SELECT min(s_suppkey) FROM supplier)) AS fixture_id
        FROM orders LEFT JOIN supplier s ON o_orderkey % 3 = 0 AND s.s_suppkey = o_orderkey % 2000 LEFT JOIN f ON f.s_nationkey = o_orderkey % 31""",
    "replay_progress": """WITH d AS (SELECT l_shipdate::DATE AS n, o_orderdate::DATE AS a, l_partkey % 90 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT CASE WHEN w > 0 THEN (200 * least(w, greatest(0, n - a)) + w) // (2 * w) / 100.0::DOUBLE END AS progress, count(*) AS n FROM d GROUP BY 1""",
    "node_filters": """SELECT 'trusted hospitals' AS what, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 > 1 AND s_suppkey % 2 = 0) AS n UNION ALL SELECT 'culverts of 3', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey = 3)
        UNION ALL SELECT 'cells', (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) UNION ALL SELECT 'cells of unknown height', (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0 AND (s_suppkey % 5 <> 0 OR s_suppkey = 10))
        UNION ALL SELECT 'out', (SELECT count(*) FROM supplier WHERE s_nationkey = 3) + 1 UNION ALL SELECT 'out POWERS', (SELECT count(*) FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 3 <> 0) UNION ALL SELECT 'in', (SELECT count(*) FROM nation WHERE (n_nationkey * 7 + 3) % 25 = 3)""",
    "subgraph_paths": f"""WITH RECURSIVE {_REL}, w AS (SELECT 'N' || n_nationkey AS anchor, 'N' || n_nationkey AS node, 0 AS hop, 'Substation:N' || n_nationkey AS path FROM nation WHERE n_nationkey % 6 = 1
        UNION ALL SELECT anchor, dst, hop + 1, CASE WHEN rel <> 'CONNECTS_TO' THEN path || '-[' || rel || ']->' || label || ':' || dst END FROM w JOIN ed ON src = node JOIN nd ON id = dst WHERE hop < 3 AND path IS NOT NULL) SELECT * FROM w""",
    "avoided_roads": f"""{_ROADS}, {_USUAL.format(seeds='0', what=_LABEL)} SELECT node, array_to_string(list_filter(cut, lambda x, i: list_position(cut, x) = i), ', ') AS roads FROM us""",
    "severed_union": f"""{_ROADS}, {_USUAL.format(seeds='0, 7, 13', what='e.edge_id')}, un AS (SELECT node, list_sort(list_distinct(flatten(list(cut)))) AS links FROM us GROUP BY 1) SELECT n_nationkey AS node, coalesce(links, []::VARCHAR[]) AS links FROM nation LEFT JOIN un ON node = n_nationkey""",
    "route_lines": f"""{_ROADS}, pw AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, [0]::BIGINT[] AS path, 0 AS step UNION ALL SELECT node, min(dist), arg_min(path, dist), step + 1 FROM (SELECT w1.node, w1.dist, w1.path, w1.step FROM pw w1
            UNION ALL SELECT e.d, w2.dist + e.w, list_append(w2.path, e.d), w2.step FROM pw w2 JOIN op e ON e.s = w2.node) WHERE step < 24 GROUP BY node, step),
        bp AS (SELECT node, arg_min(path, dist) AS path FROM pw GROUP BY 1)
        SELECT node, CASE WHEN len(path) > 1 THEN array_to_string(list_transform(path, lambda x, i: CASE WHEN i = 1 THEN '' WHEN (x + path[i - 1]) % 2 = 1 THEN (x + path[i - 1]) || ',-1 ' ELSE '' END || x || ',' || 2 * x), ' ') ELSE '' END AS line FROM bp""",
    "budgeted_routes": f"""{T.with_tables('roads', recursive=True)}, cs AS (SELECT u AS s, v AS d, greatest(p_blocked * 0.6::DOUBLE, (v % 9) / 25.0::DOUBLE) AS dep, greatest(u, v) * 2.0::DOUBLE AS sl, p_blocked < 0.95 AND v % 11 <> 10 AS ok, length / 15 AS base FROM roads),
        pr AS (SELECT s, d, CASE WHEN ok AND dep < 0.45 THEN base * (1 + 4 * pow(dep / (0.45::DOUBLE - dep + 0.05), 2) + 2.5 * greatest(sl - 18, 0) / 18) END AS w FROM cs),
        wk AS (SELECT n_nationkey AS source, n_nationkey AS node, 0.0::DOUBLE AS dist, [n_nationkey]::BIGINT[] AS path, 0 AS step FROM nation WHERE n_nationkey IN (0, 5) UNION ALL SELECT source, node, min(dist), arg_min(path, dist), step + 1 FROM (
            SELECT w1.source, w1.node, w1.dist, w1.path, w1.step FROM wk w1 UNION ALL SELECT w2.source, e.d, w2.dist + e.w, list_append(w2.path, e.d), w2.step FROM wk w2 JOIN pr e ON e.s = w2.node AND w IS NOT NULL) WHERE step < 24 GROUP BY 1, 2, step),
        bs AS (SELECT source, node, min(dist) AS dist, arg_min(path, dist) AS path FROM wk GROUP BY 1, 2),
        qs AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target, dist, path FROM nation a CROSS JOIN nation b LEFT JOIN bs ON source = a.n_nationkey AND node = b.n_nationkey WHERE a.n_nationkey IN (0, 5)),
        av AS (SELECT qs.source, target, list_sort(list(DISTINCT pr.d)) AS shut FROM qs JOIN bs ON bs.source = qs.source AND bs.dist < coalesce(qs.dist, 'inf'::DOUBLE) JOIN pr ON pr.s = bs.node AND w IS NULL GROUP BY 1, 2)
        SELECT source, target, dist IS NOT NULL AS reachable, round(round(dist, 2), 1) AS eta_s, array_to_string(path, '>') AS path, coalesce(array_to_string(shut, ','), '') AS avoided FROM qs LEFT JOIN av USING (source, target)""",
    "tactical_orders": f"""WITH im AS (SELECT s_nationkey AS aoi_id, s_suppkey AS place, 'S' || s_suppkey AS asset_id, (['Substation', 'Hospital', 'Culvert', 'DrainageNode', 'Bridge'])[s_suppkey * 3 % 5 + 1] AS asset_type, (s_suppkey % 9) / 4.0::DOUBLE AS hours, s_suppkey % 40 AS exposure FROM supplier WHERE s_suppkey % 2 = 0),
        ch AS (SELECT s_nationkey AS aoi_id, arg_max('C' || s_suppkey, (s_suppkey % 17, [-unicode(c) FOR c IN string_split('C' || s_suppkey || chr(1), '')])) AS choke FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1),
        g AS (SELECT aoi_id, coalesce({_of('Substation', 'asset_id')}, arg_min(asset_id, place)) AS sub, coalesce({_of('Culvert', 'asset_id')}, {_of('DrainageNode', 'asset_id')}, {_of('Substation', 'asset_id')}, arg_min(asset_id, place)) AS cul, coalesce({_of('Hospital', 'asset_id')}, arg_max(asset_id, place)) AS hosp,
            coalesce({_of('Substation', 'hours')}, arg_min(hours, place)) AS sh, coalesce({_of('Hospital', 'hours')}, arg_max(hours, place)) AS hh, coalesce({_of('Hospital', 'exposure')}, arg_max(exposure, place)) AS ex, sum(exposure)::BIGINT AS tot FROM im GROUP BY 1),
        r AS (SELECT g.*, coalesce(choke, cul) AS cp, CASE WHEN aoi_id % 2 = 0 THEN (aoi_id * 60 + 66) / 60.0::DOUBLE ELSE 8 END AS eta, CASE WHEN aoi_id % 4 = 0 THEN 'J1, J2' ELSE 'inundated low-line junctions' END AS av, CASE WHEN aoi_id % 6 = 0 THEN 'B1' ELSE cul END AS br FROM g LEFT JOIN ch USING (aoi_id))
        SELECT aoi_id, 1 AS priority_rank, 'SANDBAG_CHOKEPOINT' AS action_type, cul AS target, 'Deploy SDRF clearance & sandbagging crew to ' || cul || ' and articulation point ' || cp || ' to prevent feeder submergence at ' || sub || '.' AS text, greatest(0.5, sh) AS hours FROM r
        UNION ALL SELECT aoi_id, 2, 'REROUTE_FUEL', hosp, 'Dispatch diesel bowser to ' || hosp || ' (' || ex || ' critical ICU/inpatients, ' || printf('%.2f', hh) || ' hrs DG backup remaining) via A* bypass (ETA ' || printf('%.1f', eta) || ' min, avoiding ' || av || ').', hh FROM r
        UNION ALL SELECT aoi_id, 3, 'DEPLOY_UAV_USV', br, 'Task CoE-AWRDS autonomous USV/UAV unit to inspect scour & debris at ' || br || ' (' || tot || ' critical occupants in cascade zone).', 2.5 FROM r""",
    "missions": """SELECT s_suppkey AS id, 5::BIGINT AS features, 'LAUNCH_STAGING,TARGET_CHOKEPOINT_SCAN,DOWNSTREAM_OUTFLOW_SWEEP,RTB_RECOVERY,LineString' AS roles, round(92.6::DOUBLE + s_suppkey / 100.0::DOUBLE + 0.0025::DOUBLE, 6) AS sweep_lon FROM supplier""",
    "robotic_nodes": """WITH n AS (SELECT count(*) * 2 AS n FROM supplier), r AS (SELECT event_id % n AS node, event_id, value / 300 AS d FROM events, n QUALIFY row_number() OVER (PARTITION BY event_id % n ORDER BY ts DESC, event_id DESC) = 1)
        SELECT s_suppkey AS id, coalesce(d < 0.45 AND event_id % 100 < 65, true) AS is_passable, round(d, 3) AS water_depth_m, (event_id % 100)::DOUBLE AS blockage_pct, 'm' || event_id AS mission_id FROM supplier LEFT JOIN r ON node = s_suppkey""",
    "saved_plans": "SELECT count(*) AS plans, count(*) AS ids, count(*) AS valid FROM nation",
    "stored_reports": f"{T.with_tables('reports')} SELECT id, t AS created_at FROM reports WHERE category = 'click' AND status = 'open'",
    "client_history": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS place FROM events QUALIFY place <= 5",
    "explained_cells": f"""{T.with_tables('terrain')}, p AS (SELECT cell_id, unnest(['slope', 'height', 'relief']) AS g, unnest([slope - 25, elevation / 100 - 12, relief / 10 - 10]) AS x FROM terrain),
        k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(x) DESC, g) AS r FROM p) SELECT cell_id, string_agg(g || '=' || printf('%.5f', x), ' ' ORDER BY r) AS parts FROM k WHERE r <= 2 GROUP BY 1""",
    "asset_recall": """SELECT l_orderkey, round(count(DISTINCT l_partkey) FILTER (l_suppkey % 2 = 0 AND l_partkey % 2 = 0) / nullif(count(DISTINCT l_partkey) FILTER (l_suppkey % 2 = 0), 0)::DOUBLE, 6) AS recall FROM lineitem GROUP BY 1""",
    "shelter_register": "SELECT l_suppkey % 50 AS shelter, sum(l_quantity::BIGINT)::BIGINT AS heads, count(*) FILTER (l_partkey % 9 = 0) AS medical FROM lineitem GROUP BY 1",
    "signboard_claims": "SELECT event_id, CASE WHEN value / 100 - 0.2 < 0 THEN 'PENDING' ELSE 'VERIFIED' END AS state, CASE WHEN value / 100 - 0.2 < 0 THEN 0.78::DOUBLE ELSE 0.96 END AS confidence FROM events WHERE event_id % 10 = 0",
}
