"""What people see and decide: cards in context, routes, trails, announcements, answers, recommendations.

Every function takes tables and returns a table; texts that must match are marked as fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import risk as R
from ..session import cut


def cell_risks(obs: DataFrame, model: DataFrame) -> DataFrame:
    """(cell_id, p_fail, threshold_exceedance, confidence, model_version): cells the model knows, fused with
    their exceedance, and all others by the threshold alone.

    ``obs``: cell_id, exceedance; ``model``: cell_id, model_p. One left join serves both kinds.
    """
    met = obs.join(model.select("cell_id", "model_p"), "cell_id", "left")
    known = F.col("model_p").isNotNull()
    rows = met.withColumn("p_fail", R.fuse(F.coalesce("model_p", F.lit(0.0)), F.col("exceedance")))
    return rows.select("cell_id", "p_fail", F.col("exceedance").alias("threshold_exceedance"), R.entropy_confidence(F.col("p_fail")).alias("confidence"), F.when(known, "model").otherwise("threshold_only_v1").alias("model_version"))


def driving_cells(villages: DataFrame, roads: DataFrame, risks: DataFrame) -> DataFrame:
    """(village_id, cell_id, p_fail): the riskiest cell behind a village's severed roads; null where the chain breaks.

    ``villages``: village_id, severed_links; ``roads``: edge_id, cells; ``risks``: cell_id, p_fail.
    """
    links = villages.select("village_id", F.explode("severed_links").alias("edge_id"))
    cells = links.join(roads.select("edge_id", "cells"), "edge_id").select("village_id", F.explode("cells").alias("cell_id")).distinct()
    best = cells.join(risks.select("cell_id", "p_fail"), "cell_id").groupBy("village_id").agg(F.min_by(F.struct("cell_id", "p_fail"), F.struct(-F.col("p_fail"), F.col("cell_id"))).alias("b"))
    return villages.select("village_id").join(best, "village_id", "left").select("village_id", "b.cell_id", "b.p_fail")


def card_context(cards: DataFrame, priorities: DataFrame, isolations: DataFrame) -> DataFrame:
    """Cards with eps and tier of their village, and its population and isolation; missing ones stay null."""
    out = cards.join(priorities.select("village_id", "eps", "tier"), "village_id", "left")
    return out.join(isolations.select("village_id", "population", "isolated_now"), "village_id", "left")


def impacted_roads(roads: DataFrame, villages: DataFrame, least: float = 0.45, names: int = 3) -> DataFrame:
    """Roads severed or at least ``least`` likely blocked, with the first names of villages they cut off.

    ``roads``: edge_id, severed, p_blocked; ``villages``: name, severed_links, in the order of ``place``.
    """
    hit = roads.where(F.col("severed") | (F.col("p_blocked") >= least))
    links = villages.select("place", "name", F.explode("severed_links").alias("edge_id"))
    first = Window.partitionBy("edge_id").orderBy("place")
    few = links.join(hit.select("edge_id"), "edge_id", "left_semi").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= names)
    told = few.groupBy("edge_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("villages"))
    return hit.join(told, "edge_id", "left").withColumn("villages", F.coalesce("villages", F.array().cast("array<string>")))


def lead_times(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(road, t, edge_id, predicted_t, hours): the first predicted severance of a road whose name holds the
    recorded road's, and the hours by which it came ahead.

    ``predicted``: t, edge_id, name, severed; ``actual``: road, t. Names are found by an index of their
    runs of up to three characters: a road is looked up by the rarest run of its own, and the names
    that have it are compared whole. A road without a name is in every name.
    """
    first = cut(predicted.where(F.col("severed") & (F.length("name") > 0)).groupBy("name").agg(F.min(F.struct("t", "edge_id")).alias("f")))  # a row per name
    roads = cut(actual.select("road").where("road IS NOT NULL").distinct().withColumn("_size", F.least(F.lit(3), F.length(F.lower("road")))))

    def runs(text: Column, size: Column) -> Column:
        """The distinct runs of ``size`` characters."""
        last = F.length(text) - size + 1
        return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))

    sizes = [r["_size"] for r in roads.where("_size > 0").select("_size").distinct().collect()]  # at most three
    index = first.select("name", "f", F.explode(F.flatten(F.array(*[runs(F.lower("name"), F.lit(n)) for n in sizes]))).alias("run")) if sizes else first.select("name", "f", F.lit("").alias("run")).limit(0)
    index = cut(index)
    often = index.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    keys = roads.where("_size > 0").select("road", F.explode(runs(F.lower("road"), F.col("_size"))).alias("run")).join(often, "run", "left")
    # A run that no name has rules the road out: it is the rarest, and nothing joins it.
    rarest = keys.groupBy("road").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    met = rarest.join(index, "run").where(F.contains(F.lower("name"), F.lower("road"))).groupBy("road").agg(F.min("f").alias("f"))
    unnamed = roads.where("_size = 0").select("road").join(F.broadcast(first.agg(F.min("f").alias("f"))))  # at most one road
    found = met.unionByName(unnamed)
    out = actual.withColumnRenamed("t", "at").join(found, "road", "left")
    seconds = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("f.t").cast("timestamp"))
    return out.select("road", F.col("at").alias("t"), F.col("f.edge_id").alias("edge_id"), F.col("f.t").alias("predicted_t"), (seconds / 3.6e9).alias("hours"))


def flagged_roads(roads: DataFrame) -> DataFrame:
    """(flagged, severed, names) of the latest tick: t, edge_id, name, p_blocked, severed."""
    last = F.broadcast(roads.agg(F.max("t").alias("t")))
    label = F.coalesce("name", "edge_id")
    return roads.join(last, "t").agg(F.count_if(F.col("p_blocked") > 0).alias("flagged"), F.count_if("severed").alias("severed"), F.sort_array(F.collect_set(F.when(F.col("severed"), label))).alias("names"))


def commander_counts(priorities: DataFrame, roads: DataFrame, routes: DataFrame) -> DataFrame:
    """(priority_count, p1_count, affected_road_count, route_count) in one row."""
    a = priorities.agg(F.count(F.lit(1)).alias("priority_count"), F.count_if(F.col("tier") == "P1").alias("p1_count"))
    return a.join(roads.agg(F.count_if("severed").alias("affected_road_count"))).join(routes.agg(F.count(F.lit(1)).alias("route_count")))


def verified_routes(cards: DataFrame, by: str | None = None, k: int = 3) -> DataFrame:
    """The first ``k`` distinct (village_id, shelter_id) with a route, in the order of ``place``, ranked.

    ``cards``: place, village_id, shelter_id (null: no route), avoid (array). With ``by`` every value
    of that column has its own ranking; without it the result is a report of k rows.
    """
    first = cards.where("shelter_id is not null").groupBy(*([by] if by else []), *[c for c in ("village_id", "shelter_id") if c != by]).agg(F.min_by(F.struct("place", "avoid"), "place").alias("f"))
    rows = first.select(*[c for c in first.columns if c != "f"], "f.*")
    text = F.concat(F.lit("Avoid: "), F.when(F.size("avoid") > 0, F.array_join("avoid", ", ")).otherwise("none listed"))
    if by is None:
        rows = rows.orderBy("place").limit(k)
    rank = F.row_number().over(Window.partitionBy(*([by] if by else [])).orderBy("place"))
    return rows.withColumn("route_rank", rank).where(F.col("route_rank") <= k).withColumn("risk_snapshot", text).drop("avoid")


# Kinds of audit events by stage, and their labels.
TRAIL = (("AI Flagged", ("AI_FLAGGED",)), ("DDMA Decision", ("DDMA_APPROVED", "STOOD_DOWN")), ("Disseminated", ("DISSEMINATED",)), ("Village Acknowledged", ("VILLAGE_ACKNOWLEDGED",)))
LABELS = {
    "AI_FLAGGED": "AI Flagged", "DDMA_APPROVED": "DDMA Approved", "STOOD_DOWN": "Stood Down (rejected)", "DISSEMINATED": "Disseminated", "DELIVERED": "Delivered",
    "VILLAGE_ACKNOWLEDGED": "Village Acknowledged", "ESCALATED": "Escalated",
}


def alert_trail(events: DataFrame, alert_id: str | int) -> DataFrame:
    """An alert's events in the order in which they were appended (column seq)."""
    return events.where(F.col("alert_id") == alert_id).orderBy("seq")


def missing_stages(events: DataFrame) -> DataFrame:
    """(alert_id, stage, label): canonical stages (from 0) that no event of an alert has reached."""
    kinds = F.create_map(*[F.lit(x) for i, (_, own) in enumerate(TRAIL) for kind in own for x in (kind, i)])
    seen = events.groupBy("alert_id").agg(F.collect_set(kinds[F.col("kind")]).alias("seen"))
    missing = F.filter(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label")) for i, (label, _) in enumerate(TRAIL)]), lambda s: ~F.array_contains("seen", s["stage"]))
    return seen.select("alert_id", F.explode(missing).alias("m")).select("alert_id", "m.stage", "m.label")


def event_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[kind], kind)


def event_summary(kind: Column, actor: Column, payload: Column) -> Column:
    """One line about an event from its payload (JSON text)."""
    get = lambda k, d: F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit(d))
    percent = F.coalesce(F.concat(F.round(F.get_json_object(payload, "$.max_p_fail").try_cast("double") * 100).cast("long").cast("string"), F.lit("%")), F.lit("?"))
    notes = F.get_json_object(payload, "$.notes")
    decided = F.concat(get("decision", "?"), F.lit(" by "), actor, F.when(F.length(notes) > 0, F.concat(F.lit(' — "'), notes, F.lit('"'))).otherwise(""))
    over = F.coalesce(F.array_join(F.from_json(F.get_json_object(payload, "$.channels"), "array<string>"), ", "), F.lit("simulated channels"))
    return (
        F.when(kind == "AI_FLAGGED", F.concat(get("aoi_id", "AOI"), F.lit(" · "), get("cell_count", "?"), F.lit(" cells · max p_fail "), percent, F.lit(" · "), get("action_cards_issued", "0"), F.lit(" action card(s) issued")))
        .when(kind.isin("DDMA_APPROVED", "STOOD_DOWN"), decided)
        .when(kind == "DISSEMINATED", F.concat(get("total_acknowledged", "0"), F.lit("/"), get("total_recipients", "0"), F.lit(" recipients acknowledged over "), over, F.lit(" ("), get("total_delivered", "0"), F.lit(" delivered)")))
        .when(kind == "VILLAGE_ACKNOWLEDGED", F.concat(F.lit("Acknowledged by "), actor))
        .when(kind == "ESCALATED", F.concat(F.lit("-> "), get("to_stage", "?")))
        .otherwise(F.array_join(F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "))
    )


def decision_events(decisions: DataFrame) -> DataFrame:
    """(event_id, alert_id, kind, actor, t, payload) of officers' decisions: a rejection stands the alert down,
    all else approves. ``decisions``: alert_id, officer_id, decision, notes, t (ISO text), village_id, stage, headline."""
    kind = F.when(F.col("decision") == "rejected", "STOOD_DOWN").otherwise("DDMA_APPROVED")
    return decisions.select(F.concat_ws("-", F.lit("evt-ddma"), "alert_id", "t").alias("event_id"), "alert_id", kind.alias("kind"), F.concat(F.lit("ddma:"), "officer_id").alias("actor"), "t", F.to_json(F.struct("decision", "notes", "village_id", "stage", "headline")).alias("payload"))


def dissemination_events(results: DataFrame) -> DataFrame:
    """One event per alert with its channels' totals. ``results``: alert_id, village_id, channel, recipients, delivered, acknowledged, t."""
    g = results.groupBy("alert_id", "village_id", "t").agg(F.sort_array(F.collect_set("channel")).alias("channels"), F.sum("recipients").alias("total_recipients"), F.sum("delivered").alias("total_delivered"), F.sum("acknowledged").alias("total_acknowledged"))
    body = F.to_json(F.struct("village_id", "channels", "total_recipients", "total_delivered", "total_acknowledged"))
    return g.select(F.concat_ws("-", F.lit("evt-dissem"), "alert_id", "t").alias("event_id"), "alert_id", F.lit("DISSEMINATED").alias("kind"), F.lit("system").alias("actor"), "t", body.alias("payload"))


def acknowledgement_events(acks: DataFrame) -> DataFrame:
    """``acks``: alert_id, village_id, t."""
    return acks.select(F.concat_ws("-", F.lit("evt-ack"), "alert_id", "t").alias("event_id"), "alert_id", F.lit("VILLAGE_ACKNOWLEDGED").alias("kind"), F.concat(F.lit("village:"), "village_id").alias("actor"), "t", F.to_json(F.struct("village_id")).alias("payload"))


def announcements(cards: DataFrame, decided: DataFrame, results: DataFrame) -> DataFrame:
    """Announcements of cards: id, the officer's message or the card's reason, totals over the channels, and
    ``approves``: whether issuing it also approves an alert that nobody has decided on.

    ``cards``: alert_id, village_id, stage, reason, message, officer_id, t (ISO text); ``decided``:
    alert_id, kind; ``results``: alert_id, recipients, delivered, acknowledged.
    """
    done = decided.where(F.col("kind").isin("DDMA_APPROVED", "STOOD_DOWN")).select("alert_id").distinct().withColumn("_done", F.lit(True))
    sums = results.groupBy("alert_id").agg(F.count(F.lit(1)).alias("channels"), F.sum("recipients").alias("recipients"), F.sum("delivered").alias("delivered"), F.sum("acknowledged").alias("acknowledged"))
    out = cards.join(done, "alert_id", "left").join(sums, "alert_id", "left")
    return out.select(
        F.concat_ws("-", F.lit("ann"), "alert_id", "t").alias("id"), "alert_id", "village_id", "stage", F.coalesce(F.nullif("message", F.lit("")), F.col("reason")).alias("message"), F.col("officer_id").alias("issued_by"),
        F.coalesce("channels", F.lit(0)).alias("channels"), F.coalesce("recipients", F.lit(0)).alias("recipients"), F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("acknowledged", F.lit(0)).alias("acknowledged"), F.col("_done").isNull().alias("approves"),
    )


def went_wrong(scenario: DataFrame) -> DataFrame:
    """(id, line): the first warning's note, else the first road event's consequence, else the first narration;
    empty texts count as missing. ``scenario``: id, warnings, road_events, narration (arrays of text)."""
    first = lambda c: F.nullif(F.try_element_at(c, F.lit(1)), F.lit(""))
    return scenario.select("id", F.coalesce(first("warnings"), first("road_events"), first("narration")).alias("line"))


# What a replay would have missed.
NO_HISTORY = (
    "Escalation-stage lead time (first Yellow/Orange/Red) can't be honestly shown yet: decision/escalation.py (BUILD_PLAN.md task 3.2) is real and tested, but the live pipeline "
    "(pipeline.py) still runs Phase 0's decision stub and has not been wired to it — a known backend integration gap, not a hidden limitation. It will populate here automatically, "
    "with no UI changes, once that wiring lands."
)
NO_MATCH = (
    "No road-severance prediction in this run lines up with a ground-truth road event to compare against — treat this replay's system output as incomplete for this comparison, "
    "not as evidence that nothing would have been caught."
)


def missed_line(has_history: Column, name: Column, road: Column, hours: Column, at: Column) -> Column:
    """One honest sentence about a replay: how far ahead of the recorded severance the predicted one came."""
    side = F.when(hours >= 0, " ahead of").otherwise(" behind")
    told = F.concat(F.lit("Our system flagged "), name, F.lit(" as severed "), F.format_string("%.1fh", F.abs(hours)), side, F.lit(" the official "), road, F.lit(" severance recorded at "), at, F.lit("."))
    return F.when(~has_history, NO_HISTORY).when(hours.isNotNull(), told).otherwise(NO_MATCH)


# Answers without an assistant.
WITH_ROUTES = (
    "Based on the current verified impact feed, I found %d safe route option(s) that avoid roads marked affected. Review the route details below before authorising movement. "
    "This answer is using the deterministic fallback because the NVIDIA assistant is unavailable."
)
WITH_PRIORITIES = (
    "The current feed contains %d priority settlement(s), including %d P1. No verified safe route is available in the current snapshot. "
    "Escalate to the authorised response team rather than using an unverified road."
)
WAITING = "The commander feed is still waiting for verified impact data. I cannot make a safe-route recommendation yet."


def fallback_answer(routes: Column, priorities: Column, p1: Column) -> Column:
    return F.when(routes > 0, F.format_string(WITH_ROUTES, routes)).when(priorities > 0, F.format_string(WITH_PRIORITIES, priorities, p1)).otherwise(WAITING)


# Languages that the fallback voice model speaks.
FALLBACK_LANGUAGES = ("ml-IN", "od-IN", "pa-IN", "as-IN")


def voice_model(language: Column, flash: str = "flash", fallback: str = "fallback") -> tuple[Column, Column]:
    """The voice model of a language, and whether it is the fallback."""
    other = F.trim(language).isin(*FALLBACK_LANGUAGES)
    return F.when(other, fallback).otherwise(flash), F.coalesce(other, F.lit(False))


def resolve_fixtures(asked: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(request_id, fixture_id): the fixture of the id asked for, else the first of the area, else the first of all.

    ``asked``: request_id, fixture_id, aoi_id; ``fixtures``: id, aoi_id, place (their order).
    """
    by_id = fixtures.select(F.col("id").alias("fixture_id"), F.lit(True).alias("_known"))
    by_aoi = fixtures.groupBy("aoi_id").agg(F.min_by("id", "place").alias("_own"))
    first = F.broadcast(fixtures.agg(F.min_by("id", "place").alias("_first")))
    out = asked.join(by_id, "fixture_id", "left").join(by_aoi, "aoi_id", "left").join(first)
    return out.select("request_id", F.coalesce(F.when(F.col("_known"), F.col("fixture_id")), "_own", "_first").alias("fixture_id"))


def progress(now: Column, start: Column, end: Column) -> Column:
    """How far a replay is, from 0 to 1; null where it is not defined."""
    at = lambda c: c.cast("timestamp").cast("double")
    return F.when(at(end) > at(start), R.clamp01((at(now) - at(start)) / (at(end) - at(start))))


def scenario_clock(now: Column, start: Column, end: Column, elapsed_s: Column, speed: float = 1.0) -> Column:
    """Scenario time after some wall-clock seconds at a speed: it never goes back and stops at the end."""
    moved = F.timestamp_micros((F.unix_micros(now.cast("timestamp")) + F.greatest(elapsed_s, F.lit(0.0)) * speed * 1e6).cast("long"))
    return F.greatest(start.cast("timestamp"), F.least(end.cast("timestamp"), moved))


# States of nodes that nothing relies on.
UNTRUSTED = ("PLAUSIBILITY_REJECTED", "SUPERSEDED")


def trusted_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are neither rejected nor superseded; without a state they count as verified."""
    return nodes.where(~F.coalesce("verification_state", F.lit("VERIFIED")).isin(*UNTRUSTED))


def nodes_by_label(nodes: DataFrame, label: str, aoi_id: str | None = None) -> DataFrame:
    out = nodes.where(F.col("label") == label)
    return out.where(F.col("aoi_id") == aoi_id) if aoi_id is not None else out


def edges_of(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None, incoming: bool = False) -> DataFrame:
    """Edges from (or to) a node, of some kinds only if they are given."""
    out = edges.where(F.col("dst_id" if incoming else "src_id") == node)
    return out.where(F.col("rel_type").isin(*kinds)) if kinds else out


def node_cells(nodes: DataFrame) -> DataFrame:
    """(cell_id, label, name, lat, lon, elev_m) of nodes that have a place; the height is 10 where none is known."""
    return nodes.where("lat is not null and lon is not null").select(F.col("id").alias("cell_id"), "label", F.coalesce("name", "id").alias("name"), "lat", "lon", F.coalesce("elev_m", F.lit(10.0)).alias("elev_m"))


def explained_cells(ranked: DataFrame) -> DataFrame:
    """(key, parts): the ranked attributions of each cell as a map from group to contribution; ``ranked`` as
    ``evaluation.attributions`` returns it, its first column being the key."""
    key = ranked.columns[0]
    entries = F.transform(F.sort_array(F.collect_list(F.struct("rank", "grp", "contribution"))), lambda x: F.struct(x["grp"], x["contribution"]))
    return ranked.groupBy(key).agg(F.map_from_entries(entries).alias("parts"))


def recall(expected: Column, found: Column) -> Column:
    """Share of expected ids that were found; null if none was expected."""
    return F.size(F.array_intersect(expected, found)) / F.nullif(F.size(F.array_distinct(expected)), F.lit(0))


def recommendations(impacted: DataFrame, chokes: DataFrame, routes: DataFrame) -> DataFrame:
    """(aoi_id, priority_rank, action_type, target, text, hours): three orders per area from its cascade, its
    choke points and its bypass.

    ``impacted``: aoi_id, place, asset_id, asset_type, hours, exposure; ``chokes``: aoi_id, node_id,
    criticality; ``routes``: aoi_id, eta_s, avoided (array), bridge_id. Of each type the first asset counts.
    """
    first = lambda kind: F.min_by("asset_id", F.when(F.col("asset_type") == kind, F.col("place")))
    hours = lambda kind: F.min_by("hours", F.when(F.col("asset_type") == kind, F.col("place")))
    a = impacted.groupBy("aoi_id").agg(
        F.coalesce(first("Substation"), F.min_by("asset_id", "place")).alias("sub"), F.coalesce(first("Culvert"), first("DrainageNode")).alias("culvert"), F.coalesce(first("Hospital"), F.max_by("asset_id", "place")).alias("hospital"),
        F.coalesce(hours("Substation"), F.min_by("hours", "place")).alias("sub_hours"), F.coalesce(hours("Hospital"), F.max_by("hours", "place"), F.lit(3.0)).alias("hospital_hours"),
        F.coalesce(F.min_by("exposure", F.when(F.col("asset_type") == "Hospital", F.col("place"))), F.max_by("exposure", "place"), F.lit(40)).alias("exposed"), F.sum("exposure").alias("total"),
    )
    top = chokes.groupBy("aoi_id").agg(F.min_by("node_id", F.struct(-F.col("criticality"), F.col("node_id"))).alias("choke"))
    r = a.join(top, "aoi_id", "left").join(routes, "aoi_id", "left").withColumn("culvert", F.coalesce("culvert", "sub")).withColumn("choke", F.coalesce("choke", "culvert")).withColumn("bridge", F.coalesce("bridge_id", "culvert"))
    eta = F.format_string("%.1f", F.bround(F.coalesce("eta_s", F.lit(480.0)) / 60.0, 1))
    avoid = F.coalesce(F.nullif(F.array_join(F.slice("avoided", 1, 2), ", "), F.lit("")), F.lit("inundated low-line junctions"))
    # The orders' texts.
    one = F.format_string("Deploy SDRF clearance & sandbagging crew to %s and articulation point %s to prevent feeder submergence at %s.", "culvert", "choke", "sub")
    two = F.format_string("Dispatch diesel bowser to %s (%s critical ICU/inpatients, %.2f hrs DG backup remaining) via A* bypass (ETA %s min, avoiding %s).", "hospital", F.col("exposed").cast("string"), "hospital_hours", eta, avoid)
    three = F.format_string("Task CoE-AWRDS autonomous USV/UAV unit to inspect scour & debris at %s (%s critical occupants in cascade zone).", "bridge", F.col("total").cast("string"))
    order = lambda rank, action, target, text, h: F.struct(F.lit(rank).alias("priority_rank"), F.lit(action).alias("action_type"), F.col(target).alias("target"), text.alias("text"), h.alias("hours"))
    orders = F.array(
        order(1, "SANDBAG_CHOKEPOINT", "culvert", one, F.greatest(F.lit(0.5), F.coalesce("sub_hours", F.lit(1.5)))), order(2, "REROUTE_FUEL", "hospital", two, F.col("hospital_hours")), order(3, "DEPLOY_UAV_USV", "bridge", three, F.lit(2.5))
    )
    return r.select("aoi_id", F.explode(orders).alias("o")).select("aoi_id", "o.*")


def mission(lon: Column, lat: Column, target: Column, platform: str = "USV_SONAR") -> Column:
    """An inspection mission around a node as a GeoJSON text: four waypoints and the corridor between them."""
    # Half the width of a mission by platform, roles of waypoints.
    d = 0.0012 if platform == "USV_SONAR" else 0.0025
    sensor = "MULTIBEAM_SONAR_BATHYMETRY" if platform == "USV_SONAR" else "RGB_THERMAL_NADIR"
    roles = (("LAUNCH_STAGING", -d, -d), ("TARGET_CHOKEPOINT_SCAN", 0.0, 0.0), ("DOWNSTREAM_OUTFLOW_SWEEP", d, -d), ("RTB_RECOVERY", -d, -d))
    at = lambda dx, dy: F.array(F.round(lon + dx, 6), F.round(lat + dy, 6))
    feature = lambda kind, coordinates, properties: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))
    points = [
        feature("Point", at(dx, dy), F.struct(F.lit(i).alias("waypoint_seq"), F.lit(role).alias("role"), target.alias("target_node_id"), F.lit(platform).alias("platform_type"), F.lit(sensor).alias("sensor_mode")))
        for i, (role, dx, dy) in enumerate(roles, 1)
    ]
    corridor = feature("LineString", F.array(*[at(dx, dy) for _, dx, dy in roles]), F.struct(F.concat(F.lit(platform + ":"), target).alias("mission_corridor")))
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *points, corridor), F.lit("]}"))


def robotic_updates(readings: DataFrame) -> DataFrame:
    """Node updates from robots' readings: id, water_depth_m, blockage_pct, integrity, is_passable, mission_id, observed_at.

    ``readings``: mission_id, node_id, depth, blockage, integrity, observed_at; the newest per node counts.
    """
    last = readings.groupBy("node_id").agg(F.max_by(F.struct("mission_id", "depth", "blockage", "integrity", "observed_at"), F.struct("observed_at", "mission_id")).alias("r"))
    passable = (F.col("r.depth") < 0.45) & (F.col("r.blockage") < 65.0)
    return last.select(F.col("node_id").alias("id"), F.round("r.depth", 3).alias("water_depth_m"), F.round("r.blockage", 1).alias("blockage_pct"), F.round("r.integrity", 3).alias("integrity"), passable.alias("is_passable"), "r.mission_id", "r.observed_at")


def merge_nodes(nodes: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with the updates' values where they are set; updates of unknown nodes are left out, columns that
    nodes lack are added."""
    new = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in new])
    out = nodes.join(u, key, "left")
    value = lambda c: F.coalesce(f"_{c}", c) if c in nodes.columns else F.col(f"_{c}")
    return out.select(key, *[value(c).alias(c) if c in new else F.col(c) for c in [*[c for c in nodes.columns if c != key], *[c for c in new if c not in nodes.columns]]])


def saved_plan_id(created_at: Column, body: Column) -> Column:
    """A name-based UUID (version 5, URL namespace) of a plan's time (ISO text) and canonical JSON."""
    # Fixed value: the namespace of URLs.
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.concat_ws(":", created_at, body).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def stored_reports(reports: DataFrame, aoi_id: str | None = None, status: str | None = None) -> DataFrame:
    """Reports of a store, filtered where asked, newest first."""
    for column, value in (("aoi_id", aoi_id), ("status", status)):
        reports = reports.where(F.col(column) == value) if value is not None else reports
    return reports.orderBy(F.desc("created_at"), F.desc("id"))


def latest_rows(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The newest ``k`` rows of each key, newest first in ``place``: what a client keeps of a stream of ticks."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("place") <= k)


def register_functions(spark: SparkSession) -> list[str]:
    """Make the scalar rules available to SQL, as SQL functions that the optimizer inlines; their names."""
    rules = {
        "id_threshold(hours DOUBLE)": f"{C.ID_COEFFICIENT} * pow(hours, {C.ID_EXPONENT})",
        "ed_threshold(hours DOUBLE)": f"CASE WHEN hours > {C.ED_MIN_HOURS} AND hours < {C.ED_MAX_HOURS} THEN {C.ED_OFFSET} + {C.ED_SLOPE} * hours END",
        "risk_stage(p DOUBLE)": f"CASE WHEN p >= {C.RED} THEN 'RED' WHEN p >= {C.ORANGE} THEN 'ORANGE' WHEN p >= {C.YELLOW} THEN 'YELLOW' ELSE 'GREEN' END",
        "fuse_risk(model DOUBLE, exceedance DOUBLE)": "greatest(model, least(1D, greatest(0D, exceedance)))",
    }
    for head, body in rules.items():
        kind = "STRING" if head.startswith("risk_stage") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in rules]
