"""Assets, cards and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import risk as R
from ..operators import assets as A
from ..operators import windows as W
from ..sources import feeds as X
from ..sources import tables as T
from .network import _HEAD as _ROADS
from .network import _simple
from .risk import _HEAD, _HOURLY, _obs


def cascade_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as assets in the order in which their nation's failure needs attention."""
    k = F.col("s_suppkey")
    label = F.element_at(F.array(*map(F.lit, ("Hospital", "TelecomTower", "Substation"))), (k % 3 + 1).cast("int"))
    hours = A.survival_hours(label, F.when(k % 6 != 0, k * 3.0), F.lit(150.0), F.when(k % 5 != 0, k * 2.0), (k % 7).cast("double"), F.lit(1.5))
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("trigger"), k.alias("asset"), (k % 3).alias("hop"), hours.alias("survival"), (k % 40).alias("exposure"))
    return A.cascade_order(rows)


def gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers whose lines cite parts: what passes, and the state of each answer."""
    li = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    cited = F.when(F.col("supp") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array("part"))
    rec = li.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("rank"), F.col("part").alias("target"), cited.alias("cited"))
    allowed = T.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"))
    passed, status = A.gate(rec, allowed)
    last = passed.groupBy("answer_id").agg(F.max("new_rank").alias("last_rank"), F.sum("rank").alias("ranks"))
    return status.join(last, "answer_id", "left")


def village_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest hospital and shelter of every village."""
    k = F.col("site_id")
    t = T.sites(spark, sf_dir).select(k.alias("target_id"), F.when(k % 3 == 0, "hospital").otherwise("shelter").alias("kind"), "lon", "lat")
    return A.nearest_per_kind(T.villages(spark, sf_dir).select(F.col("village_id").alias("place_id"), "lon", "lat"), t)


def village_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Villages' places from the survey, the exposure layer, or the ring."""
    v = T.villages(spark, sf_dir)
    out = A.positions(v, v.where("village_id % 3 = 0"), v.where("village_id % 2 = 0").withColumn("lat", F.col("lat") + 1), (92.7, 23.7))
    return out.select("village_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "position_is_real")


def hotspot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six riskiest cells from 0.5 on with their place and first driver: a report, so limited before the join."""
    rows = _obs(spark, sf_dir).select(F.col("pixel_id").cast("long").alias("cell_id"), R.fuse(F.col("ml"), F.col("ratio")).alias("p"), F.when(F.col("ratio") > F.col("ml"), "rain").otherwise("model").alias("driver"))
    top = rows.where("p >= 0.5").orderBy(F.desc("p"), "cell_id").limit(6)
    return top.join(T.terrain(spark, sf_dir).select("cell_id", "x", "y"), "cell_id").select("cell_id", F.round("p", 6).alias("p_fail"), "driver", "x", "y")


def tick_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst exceedance over all cells, hour by hour."""
    h = W.rolling(W.hourly(T.rain(spark, sf_dir)), "pixel_id", "hour", "mm", {"r1": 1, "r6": 6, "r24": 24, "r72": 72})
    ratio = R.exceedance_ratio({1: F.col("r1"), 6: F.col("r6"), 24: F.col("r24"), 72: F.col("r72")})
    return h.groupBy("hour").agg(F.round(F.max(ratio), 6).alias("ratio"), F.count(F.lit(1)).alias("cells"))


def whatif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storm's counts in one row: severe and elevated cells, roads and villages hit, people isolated."""
    t = T.terrain(spark, sf_dir).select((F.col("slope") / 50).alias("p"))
    r = T.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20 / 20).alias("p"))
    v = T.villages(spark, sf_dir).select("pop", (F.col("village_id") % 4 == 0).alias("cut"))
    cells = t.agg(F.count_if(F.col("p") >= 0.75).alias("severe"), F.count_if(F.col("p") >= 0.55).alias("elevated"))
    roads = r.agg(F.count_if(F.col("p") >= 0.3).alias("roads"), F.count_if(F.col("p") >= C.P_CRIT_ROAD).alias("severed"))
    people = v.agg(F.count_if("cut").alias("isolated"), F.coalesce(F.sum(F.when(F.col("cut"), F.col("pop"))), F.lit(0)).alias("people"))
    return cells.join(roads).join(people)  # one row each


def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial folds of villages by nation, with those whose training rows have one class."""
    return A.fold_report(T.villages(spark, sf_dir).select((F.col("nation") % 5).alias("block"), (F.col("nation") % 5 == 2).cast("int").alias("y")))


def negatives_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain cells that may serve as negatives: positives come from orders' keys, some of them missing."""
    k = F.col("cell_id")
    c = T.terrain(spark, sf_dir).select("cell_id", (k % 9 != 0).alias("has_terrain"), (k % 13 == 0).alias("in_holdout"))
    p = T.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 5000).alias("cell_id"))
    return A.negatives_pool(c, p).select("cell_id")


def routable_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of open roads with risk and slope (a third of the roads have no slope)."""
    s = _simple(spark, sf_dir).where("NOT severed")
    slope = F.when((F.col("a") + F.col("b")) % 3 != 0, (F.col("a") + F.col("b")) / 48.0)
    return s.select("a", "b", F.round(A.edge_cost(F.col("length"), F.col("p_blocked"), slope, C.ROUTE_ALPHA, C.ROUTE_BETA), 4).alias("cost"))


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain cells as the model's columns; some have no class, some a text for a number."""
    k = F.col("cell_id")
    t = T.terrain(spark, sf_dir)
    cover = F.when(k % 13 != 0, F.element_at(F.array(*map(F.lit, A.LAND_COVER)), (k % 11 + 1).cast("int")))
    own = {"aspect_mean_deg": F.col("aspect"), "land_cover_class": cover, "elevation_m": F.col("elevation"), "slope_mean_deg": F.col("slope"), "lithology_class": F.when(k % 5 == 0, "shale").otherwise((k % 7).cast("string"))}
    cells = t.select("cell_id", *[own.get(c, F.lit(None).cast("double")).alias(c) for c in (*A.NUMERIC, "aspect_mean_deg", "land_cover_class")])
    f = A.model_features(cells)
    return f.select("cell_id", "elevation_m", "lithology_class", F.round("aspect_sin", 6).alias("aspect_sin"), F.round("aspect_cos", 6).alias("aspect_cos"), *[f"land_cover_{c}" for c in A.LAND_COVER], F.lit(len(f.columns) - 1).cast("long").alias("n_columns"))


def forecast_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severed roads and priorities of villages over five days."""
    days = F.broadcast(spark.range(1).select(F.posexplode(F.array(*map(F.lit, C.FORECAST_FACTORS))).alias("day", "factor")))
    r = T.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20 / 20).alias("p")).join(days).groupBy("day").agg(F.count_if(F.round(A.evolved(F.col("p"), F.col("factor")), 9) >= 0.7).alias("severed"))
    cells = T.terrain(spark, sf_dir).select((F.col("slope") / 60).alias("p")).join(days).groupBy("day").agg(F.max(A.evolved(F.col("p"), F.col("factor"))).alias("worst"))
    v = T.villages(spark, sf_dir).select((F.col("village_id") % 11 / 10).alias("eps"), (F.col("village_id") % 7 / 6).alias("p")).join(F.broadcast(cells))
    eps = v.groupBy("day").agg(F.round(F.sum(A.evolved_eps(F.col("eps"), F.col("p"), F.col("worst"))), 5).alias("eps_sum"))
    return r.join(eps, "day")


def synthetic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform storm over every cell, its antecedents on top of what fell before."""
    depth, hours = F.col("cell_id") % 5 * 40.0 + 20, F.col("cell_id") % 3 * 30.0 + 6
    rain = {w: R.uniform_storm(depth, hours, w) for w in (1, 6, 24, 72)}
    extra = F.when(F.col("cell_id") % 2 == 0, 15.0)
    return T.terrain(spark, sf_dir).select("cell_id", *[F.round(rain[w], 6).alias(f"rain_{w}h") for w in rain], F.round(rain[72] + F.coalesce(extra, F.lit(0.0)), 6).alias("antecedent_7d"))


def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of orders as canonical JSON, keys in order, nulls kept."""
    o = T.table(spark, sf_dir, "orders")
    body = A.canonical_json({"status": F.col("o_orderstatus"), "cust": F.col("o_custkey"), "note": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))})
    return o.select("o_orderkey", F.sha2(body, 256).alias("digest"))


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of suppliers as nodes to a question."""
    k = F.col("s_suppkey")
    tokens = A.query_tokens(F.lit("Is supplier 0001, or NATION? of an x supplier;  safe"))
    label = F.when(k % 2 == 0, "Hospital").otherwise("Depot")
    score = A.relevance(tokens, F.concat_ws(" ", "s_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))), label, F.when(k % 3 == 0, "OFFLINE"))
    return T.table(spark, sf_dir, "supplier").select(k.alias("id"), F.round(score, 4).alias("score"))


_CARRY = ("water", "medicines")


def _card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("village_id")
    p = k % 20 / 20
    avoid = F.when(k % 4 == 0, F.array(F.lit("NH-6"), F.lit("A & B"))).otherwise(F.array().cast("array<string>"))
    at = F.to_timestamp_ntz(F.lit("2024-01-29 12:00:00")) + F.make_dt_interval(hours=(k % 24).cast("int"))
    return T.villages(spark, sf_dir).select("village_id", R.stage(p).alias("stage"), p.alias("p_fail"), at.alias("issued_at"), F.when(k % 5 != 0, F.concat(F.lit("Shelter "), (k % 9).cast("string"))).alias("shelter_name"), avoid.alias("avoid"))


def full_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all villages with their texts and lists."""
    c = A.cards(_card_rows(spark, sf_dir), _CARRY)
    return c.select("alert_id", "headline", "reason", "shelter_name", F.array_join("roads_to_avoid", "; ").alias("avoid"), "valid_until")


def cap_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as CAP alerts: values read back from the XML, and a digest of the whole text."""
    rows = _card_rows(spark, sf_dir)
    # Few bytes but much work for each row: dealt to all tasks, however few files they come from.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "village_id")
    c = A.cards(rows, _CARRY).withColumn("xml", A.cap_alert())
    text = lambda *tags: F.xpath("xml", F.lit("//*[" + " or ".join(f"local-name()='{t}'" for t in tags) + "]/text()"))
    # In the order of the text; the first three are never empty. One reading serves all four.
    told = c.select("village_id", "xml", text("sent", "urgency", "certainty", "instruction").alias("told"), F.size(text("responseType")).cast("long").alias("responses"))
    got = {k: F.get("told", F.lit(i)) for i, k in enumerate(("sent", "urgency", "certainty", "instruction"))}
    return told.select("village_id", *[got[k].alias(k) for k in ("urgency", "certainty", "sent", "instruction")], "responses", F.md5("xml").alias("xml_md5"))


def edge_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edges from supplier to part: of one pair the line of the newest order counts."""
    order = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    e = T.table(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.col("l_suppkey") % 40, F.col("l_partkey") % 300).alias("edge_id"), "l_orderkey", "l_linenumber", "l_quantity", order.alias("seq"))
    return A.latest_edges(e, "seq").drop("seq")


def trusted_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of trusted accuracy inside the box, per category."""
    accuracy = F.element_at(F.array(*map(F.lit, ("exact", "1km", "5km", "25km", "unknown"))), (F.col("id") % 5 + 1).cast("int"))
    r = T.reports(spark, sf_dir).withColumn("accuracy", accuracy)
    return r.where(X.inside(F.col("lon"), F.col("lat"), (92.65, 23.65, 92.8, 23.8)) & F.col("accuracy").isin("exact", "1km", "5km")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def observed_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed cells that the terrain knows and those it does not; of repeated cells the last observation counts."""
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), "event_id", "value")
    last = e.groupBy("cell_id").agg(F.max_by("value", "event_id").alias("value"))
    t = T.terrain(spark, sf_dir).where("cell_id % 4 <> 0").select("cell_id", F.lit(True).alias("known"))
    return last.join(t, "cell_id", "left").select("cell_id", "value", F.coalesce("known", F.lit(False)).alias("matched"))


def rain_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stand-in for a model: risk by the last hour's rain alone."""
    o = _obs(spark, sf_dir)
    return o.select("pixel_id", F.round(R.clamp01(F.col("rain_1h") / 30.0), 6).alias("p_fail"), F.lit(0.5).alias("confidence"))


def newest_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest 200 orders of every area, each customer's newest, in the order in which they are met."""
    o = T.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("area"), F.col("o_custkey").alias("village_id"), "o_orderkey")
    kept = o.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("o_orderkey")))).where("place <= 200")
    return kept.groupBy("area", "village_id").agg(F.max("o_orderkey").alias("card"), F.min("place").alias("place"))


QUERIES = {f.__name__: f for f in (
    cascade_order, gated_answers, village_targets, village_positions, hotspot_cells, tick_trajectory, whatif_summary, fold_report, negatives_pool, routable_costs, model_features, forecast_impact, synthetic_frames,
    payload_hashes, relevance_scores, full_cards, cap_alerts, edge_upserts, trusted_positives, observed_terrain, rain_stub, newest_cards,
)}

_CARD = """cd AS (SELECT *, 'card-' || village_id || '-' || strftime(at_t, '%Y-%m-%dT%H:%M:%S') AS alert_id, CASE WHEN p >= 0.75 THEN 'RED' WHEN p >= 0.5 THEN 'ORANGE' WHEN p >= 0.25 THEN 'YELLOW' ELSE 'GREEN' END AS stage,
    CASE WHEN village_id % 5 <> 0 THEN 'Shelter ' || (village_id % 9) ELSE 'No usable shelter route available — contact DDMA for guidance' END AS shelter_name, village_id % 4 = 0 AND village_id % 5 <> 0 AS avoids
    FROM (SELECT c_custkey AS village_id, (c_custkey % 20) / 20.0::DOUBLE AS p, TIMESTAMP '2024-01-29 12:00:00' + to_hours(c_custkey % 24) AS at_t FROM customer)),
    cx AS (SELECT *, CASE stage WHEN 'RED' THEN 'Evacuate Now' WHEN 'ORANGE' THEN 'Evacuation Ready' WHEN 'YELLOW' THEN 'Prepare to Evacuate' ELSE 'Monitor — No Action Needed' END AS headline,
        upper(left(stage, 1)) || lower(substr(stage, 2)) || ': modelled failure probability ' || round_even(p * 100, 0)::BIGINT || '% for the slopes above this village.' AS reason FROM cd)"""
_CAP = """w AS (SELECT *, CASE stage WHEN 'RED' THEN 'Immediate' WHEN 'GREEN' THEN 'Future' ELSE 'Expected' END AS urgency, CASE stage WHEN 'RED' THEN 'Extreme' WHEN 'ORANGE' THEN 'Severe' WHEN 'YELLOW' THEN 'Moderate' ELSE 'Minor' END AS severity,
        CASE stage WHEN 'RED' THEN 'Observed' WHEN 'GREEN' THEN 'Possible' ELSE 'Likely' END AS certainty, CASE stage WHEN 'RED' THEN ['Evacuate'] WHEN 'ORANGE' THEN ['Prepare'] WHEN 'YELLOW' THEN ['Prepare', 'Monitor'] ELSE ['Monitor'] END AS rt,
        strftime(at_t, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS sent, strftime(at_t + INTERVAL 6 HOUR, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS ends, 'Go to ' || shelter_name || '.' || CASE WHEN avoids THEN ' Avoid: NH-6, A & B.' ELSE '' END || ' Carry: water, medicines.' AS instruction FROM cx),
    x AS (SELECT *, '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>' || alert_id || '</identifier><sender>slopeline-ews</sender><sent>' || sent || '</sent><status>Actual</status><msgType>Alert</msgType><scope>Public</scope><info><language>en-US</language><category>Geo</category><category>Safety</category><event>Landslide</event>'
        || array_to_string(list_transform(rt, lambda r: '<responseType>' || r || '</responseType>'), '') || '<urgency>' || urgency || '</urgency><severity>' || severity || '</severity><certainty>' || certainty || '</certainty><effective>' || sent || '</effective><expires>' || ends || '</expires><headline>' || headline
        || '</headline><description>' || reason || '</description><instruction>' || replace(instruction, '&', '&amp;') || '</instruction><parameter><valueName>stage</valueName><value>' || stage || '</value></parameter><parameter><valueName>shelter_name</valueName><value>' || shelter_name
        || '</value></parameter><area><areaDesc>Village ' || village_id || '</areaDesc><geocode><valueName>village_id</valueName><value>' || village_id || '</value></geocode></area></info></alert>' AS xml FROM w)"""

ORACLES = {
    "cascade_order": """WITH a AS (SELECT s_nationkey AS trigger, s_suppkey AS asset, s_suppkey % 3 AS hop, s_suppkey % 40 AS exposure, CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 6 <> 0 THEN round_even(greatest(0, s_suppkey * 3.0::DOUBLE / (0.28::DOUBLE * 150) - 1.5), 2) ELSE s_suppkey % 7 END
            WHEN 1 THEN CASE WHEN s_suppkey % 5 <> 0 THEN round_even(greatest(0, 48.0::DOUBLE * (s_suppkey * 2.0::DOUBLE) * 0.80::DOUBLE / 1000 / 2.75 - 1.5), 2) ELSE s_suppkey % 7 END ELSE s_suppkey % 7 END::DOUBLE AS survival FROM supplier)
        SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY hop, survival, exposure DESC, asset)::INT AS place FROM a""",
    "gated_answers": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey AS answer_id, l_linenumber AS rank, part % 3 <> 0 AND part IN (SELECT p_partkey FROM part) AND supp % 4 <> 0 AS ok FROM l)
        SELECT answer_id, count(*) FILTER (NOT ok) AS blocked, count(*) FILTER (ok) AS verified, CASE WHEN bool_or(ok) THEN 'VERIFIED' ELSE 'GUARDRAIL_REDACTED' END AS status, nullif(count(*) FILTER (ok), 0)::INT AS last_rank, (sum(rank) FILTER (ok))::BIGINT AS ranks FROM r GROUP BY 1""",
    "village_targets": f"""{T.with_tables('villages', 'sites')} SELECT village_id AS place_id, CASE WHEN site_id % 3 = 0 THEN 'hospital' ELSE 'shelter' END AS kind, arg_min(site_id, (sqrt(pow(v.lon - s.lon, 2) + pow(v.lat - s.lat, 2)), site_id)) AS target_id FROM villages v, sites s GROUP BY 1, 2""",
    "village_positions": f"""{T.with_tables('villages')}, h AS (SELECT *, radians((list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(village_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 360)::DOUBLE) AS a FROM villages)
        SELECT village_id, round(CASE WHEN village_id % 6 IN (0, 2, 3, 4) THEN lon ELSE 92.7::DOUBLE + 0.05::DOUBLE * cos(a) END, 6) AS lon, round(CASE WHEN village_id % 3 = 0 THEN lat WHEN village_id % 2 = 0 THEN lat + 1 ELSE 23.7::DOUBLE + 0.05::DOUBLE * sin(a) END, 6) AS lat, village_id % 6 IN (0, 2, 3, 4) AS position_is_real FROM h""",
    "hotspot_cells": f"""{_HEAD}, t AS ({T.SQL['terrain']}), k AS (SELECT CAST(pixel_id AS BIGINT) AS cell_id, greatest(ml, least(1, greatest(0, ratio))) AS p, CASE WHEN ratio > ml THEN 'rain' ELSE 'model' END AS driver FROM obs)
        SELECT cell_id, round(p, 6) AS p_fail, driver, x, y FROM (SELECT * FROM k WHERE p >= 0.5 ORDER BY p DESC, cell_id LIMIT 6) JOIN t USING (cell_id)""",
    "tick_trajectory": f"{T.with_tables('rain')}, {_HOURLY} SELECT hour, round(max(ratio), 6) AS ratio, count(*) AS cells FROM traj GROUP BY 1",
    "whatif_summary": f"""{T.with_tables('terrain', 'villages')} SELECT (SELECT count(*) FROM terrain WHERE slope / 50 >= 0.75) AS severe, (SELECT count(*) FROM terrain WHERE slope / 50 >= 0.55) AS elevated, (SELECT count(*) FROM supplier WHERE s_suppkey % 20 >= 6) AS roads,
        (SELECT count(*) FROM supplier WHERE s_suppkey % 20 >= 14) AS severed, (SELECT count(*) FROM villages WHERE village_id % 4 = 0) AS isolated, (SELECT coalesce(sum(pop), 0) FROM villages WHERE village_id % 4 = 0)::BIGINT AS people""",
    "fold_report": f"""{T.with_tables('villages')}, b AS (SELECT nation % 5 AS block, count(*) AS n_test, count(*) FILTER (nation % 5 = 2) AS n_test_pos FROM villages GROUP BY 1)
        SELECT block, (sum(n_test) OVER () - n_test)::BIGINT AS n_train, n_test, n_test_pos, sum(n_test_pos) OVER () - n_test_pos IN (0, sum(n_test) OVER () - n_test) AS skipped FROM b""",
    "negatives_pool": f"""{T.with_tables('terrain')} SELECT cell_id FROM terrain WHERE cell_id % 9 <> 0 AND cell_id % 13 <> 0 AND cell_id NOT IN (SELECT o_orderkey % 5000 FROM orders WHERE o_orderkey % 4 <> 0)""",
    "routable_costs": f"""{_ROADS} SELECT a, b, round(length * (1 + 3.0::DOUBLE * p_blocked + CASE WHEN (a + b) % 3 <> 0 THEN (a + b) / 48.0::DOUBLE ELSE 0 END), 4) AS cost FROM sev WHERE NOT severed""",
    "model_features": f"""{T.with_tables('terrain')} SELECT cell_id, elevation AS elevation_m, CASE WHEN cell_id % 5 <> 0 THEN (cell_id % 7)::DOUBLE END AS lithology_class, round(sin(radians(aspect)), 6) AS aspect_sin, round(cos(radians(aspect)), 6) AS aspect_cos,
        {', '.join(f"(cell_id % 13 <> 0 AND cell_id % 11 = {i})::INT::DOUBLE AS land_cover_{c}" for i, c in enumerate(A.LAND_COVER))}, 25::BIGINT AS n_columns FROM terrain""",
    "forecast_impact": f"""{T.with_tables('terrain', 'villages')}, d AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.14), (2, 0.96), (3, 0.74), (4, 0.56)) d(day, f)),
        r AS (SELECT day, count(*) FILTER (round(least(1, (s_suppkey % 20) / 20.0::DOUBLE * (0.72::DOUBLE + 0.28::DOUBLE * f)), 9) >= 0.7) AS severed FROM supplier, d GROUP BY 1),
        w AS (SELECT day, max(least(1, slope / 60 * (0.72::DOUBLE + 0.28::DOUBLE * f))) AS worst FROM terrain, d GROUP BY 1),
        e AS (SELECT day, round(sum(least(1, greatest(0, (village_id % 11) / 10.0::DOUBLE - 0.35::DOUBLE * ((village_id % 7) / 6.0::DOUBLE) + 0.35::DOUBLE * worst))), 5) AS eps_sum FROM villages, w GROUP BY 1)
        SELECT day::INT AS day, severed, eps_sum FROM r JOIN e USING (day)""",
    "synthetic_frames": f"""{T.with_tables('terrain')}, s AS (SELECT cell_id, cell_id % 5 * 40.0::DOUBLE + 20 AS d, cell_id % 3 * 30.0::DOUBLE + 6 AS h FROM terrain)
        SELECT cell_id, round(d / h * least(1, h), 6) AS rain_1h, round(d / h * least(6, h), 6) AS rain_6h, round(d / h * least(24, h), 6) AS rain_24h, round(d / h * least(72, h), 6) AS rain_72h, round(d / h * least(72, h) + CASE WHEN cell_id % 2 = 0 THEN 15 ELSE 0 END, 6) AS antecedent_7d FROM s""",
    "payload_hashes": """SELECT o_orderkey, sha256('{"cust":' || o_custkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""",
    "relevance_scores": """SELECT s_suppkey AS id, round(0.5::DOUBLE * (contains(lower(s_name), 'supplier')::INT + contains(lower(s_name) || ' nation ' || s_nationkey, '0001')::INT + 1 + contains(lower(s_name) || ' nation', 'safe')::INT)
        + CASE WHEN s_suppkey % 2 = 0 THEN 0.45::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN s_suppkey % 3 = 0 THEN 0.35::DOUBLE ELSE 0 END, 4) AS score FROM supplier""",
    "full_cards": f"WITH {_CARD} SELECT alert_id, headline, reason, shelter_name, CASE WHEN avoids THEN 'NH-6; A & B' ELSE '' END AS avoid, at_t + INTERVAL 6 HOUR AS valid_until FROM cx",
    "cap_alerts": f"WITH {_CARD}, {_CAP} SELECT village_id, urgency, certainty, sent, instruction, len(rt) AS responses, md5(xml) AS xml_md5 FROM x",
    "edge_upserts": """SELECT (l_suppkey % 40) || '_' || (l_partkey % 300) AS edge_id, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 40, l_partkey % 300 ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""",
    "trusted_positives": f"{T.with_tables('reports')} SELECT category, count(*) AS n, min(id) AS first FROM reports WHERE lon BETWEEN 92.65 AND 92.8 AND lat BETWEEN 23.65 AND 23.8 AND id % 5 < 3 GROUP BY 1",
    "observed_terrain": f"""{T.with_tables('terrain')}, l AS (SELECT user_id AS cell_id, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT l.cell_id, value, t.cell_id IS NOT NULL AS matched FROM l LEFT JOIN terrain t ON t.cell_id = l.cell_id AND t.cell_id % 4 <> 0""",
    "rain_stub": f"{_HEAD} SELECT pixel_id, round(least(1, greatest(0, rain_1h / 30)), 6) AS p_fail, 0.5::DOUBLE AS confidence FROM obs",
    "newest_cards": """WITH k AS (SELECT o_custkey % 20 AS area, o_custkey AS village_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey DESC)::INT AS place FROM orders QUALIFY place <= 200)
        SELECT area, village_id, max(o_orderkey) AS card, min(place) AS place FROM k GROUP BY 1, 2""",
}
