"""Reports for people: cards, labels, announcements, retrieval, lineage of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X
from ..operators import graph as G
from ..operators import joins as J
from ..operators import state as S
from ..sources import tables as T


def action_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards for villages in ORANGE or RED: id, headline, validity of six hours, first target."""
    v = T.villages(spark, sf_dir).withColumns({"p": F.col("village_id") % 20 / 20, "at": F.to_timestamp_ntz(F.lit("2024-01-29 12:00:00")) + F.make_dt_interval(hours=F.col("village_id") % 24)})
    v = v.withColumn("stage", R.stage(F.col("p"))).where(F.col("stage").isin("ORANGE", "RED"))  # before anything costly
    headline = F.when(F.col("stage") == "RED", "Evacuate now").otherwise("Prepare to evacuate")
    return v.select(
        "village_id", F.concat(F.lit("card-"), F.col("village_id").cast("string"), F.lit("-"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).alias("alert_id"), "stage", headline.alias("headline"),
        (F.col("at") + F.make_dt_interval(hours=F.lit(6))).alias("valid_until"), F.when(F.col("village_id") % 6 == 0, "no open route").otherwise(F.concat(F.lit("shelter "), (F.col("village_id") % 9).cast("string"))).alias("route"),
    )


def report_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per recommendation."""
    r = T.reports(spark, sf_dir)
    full = r.join(J.hotspots(r), "id", "left").join(J.duplicates(r), "id", "left")
    quality, relevance = F.col("id") % 9 / 8, F.col("id") % 10 / 10
    urgency = R.urgency(F.col("id") % 5 + 1, relevance, quality, F.coalesce("hotspot_count", F.lit(1)), F.col("id") % 21 / 20, F.col("duplicate_of").isNotNull())
    category = F.when(F.col("category") == "click", "Blocked road").otherwise(F.col("category"))
    return full.select("id", X.recommendation(category, urgency, quality, relevance, F.col("duplicate_of"), F.col("hotspot_count")).alias("what"))


def forecast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day label of the five days from the latest order."""
    o = T.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    last = F.broadcast(o.agg(F.date_sub(F.max("day"), 4).alias("today")))
    return o.join(last).where("day >= today").groupBy(X.day_label(F.col("day"), F.col("today")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def ring_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A steady place for every customer by the hash of its name."""
    h = X.fnv1a(F.col("c_name"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", h.alias("hash"), (h % 360).alias("angle"), X.title_id(F.lower("c_mktsegment")).alias("title"))


def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per client key; the header is made from the event's neighbours."""
    e = T.table(spark, sf_dir, "events")
    header = F.when(F.col("event_id") % 3 == 0, F.concat_ws(", ", F.col("user_id").cast("string"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")), F.lit(" ")))
    host = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sock"), (F.col("user_id") % 4).cast("string")))
    return e.groupBy(X.client_key(header, host).alias("client")).agg(F.count(F.lit(1)).alias("n"))


def driver_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two weightiest drivers of each cell in words."""
    t = T.terrain(spark, sf_dir)
    part = lambda name, x: F.struct(F.lit(name).alias("label"), x.alias("x"))
    s = X.top_drivers(F.array(part("slope", (F.col("slope") - 25) / 50), part("height", (F.col("elevation") - 1200) / 4000), part("soil moisture", (F.col("cell_id") % 9 - 4) / 16.0)))
    return t.select("cell_id", X.caveat(s, F.lit("drivers")).alias("sentence"))


def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per road under its flood depth, and roads that can't be passed, by class."""
    r = T.roads(spark, sf_dir).withColumn("cost", X.dynamic_cost(F.col("length") / 4, F.col("p_blocked") * 0.8, F.col("u") * 2.0, 0.45))
    return r.groupBy("class").agg(F.count(F.lit(1)).alias("roads"), F.count_if(F.col("cost").isNull()).alias("closed"), F.round(F.sum("cost"), 2).alias("seconds"))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood-depth claims against their surroundings: rejected if all lower neighbours are dry.

    A claim of half a metre or more is rejected where two or more places within two steps downhill
    exist, all of them dry, and the reporter has no authority; authority verifies.
    """
    e = T.roads(spark, sf_dir).where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    height = lambda c: c * 7 % 11
    low = G.two_hops(e).where((F.col("src") != F.col("dst")) & (height(F.col("dst")) <= height(F.col("src")) - 1.5))
    around = low.groupBy(F.col("src").alias("place")).agg(F.count(F.lit(1)).alias("lower"), F.bool_and(F.col("dst") % 3 != 0).alias("dry"))
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"), F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 20 / 10).alias("depth"), (F.col("c_custkey") % 4 == 0).alias("authority"))
    reject = (F.col("depth") >= 0.5) & (F.coalesce("lower", F.lit(0)) >= 2) & F.col("dry") & ~F.col("authority")
    state = F.when(reject, "REJECTED").when(F.col("authority"), "VERIFIED").otherwise("PENDING")
    return c.join(around, "place", "left").select("report_id", state.alias("state"), F.when(reject, 0.05).when(F.col("authority"), 0.96).otherwise(0.78).alias("confidence"))


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that a newer one of the same user and type replaces: the next of at least their confidence or with authority."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", (F.col("event_id") % 8 / 8).alias("confidence"), (F.col("event_id") % 5 == 0).alias("authority"))
    rows = e.select(F.concat_ws("|", "user_id", "event_type").alias("who"), "ts", "event_id", "confidence", "authority")
    return S.superseding(rows, "who").drop("who")


def newest_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of every customer, newest first within a priority."""
    o = T.table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderpriority", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.*")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))


def retrieval_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-scoring assets and all critical ones of a query, cut at eleven: a report, so limited."""
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 17 / 4 + F.when(F.col("s_nationkey") % 5 == 0, 0.45).otherwise(0.1)).alias("score"), (F.col("s_nationkey") % 5 == 0).alias("critical"))
    top = s.orderBy(F.desc("score"), "id").limit(5).withColumn("tier", F.lit(0))
    rest = s.where("critical").orderBy("id").limit(11).withColumn("tier", F.lit(1))
    return top.unionByName(rest).orderBy("tier", F.when(F.col("tier") == 0, -F.col("score")), "id").limit(11).select("tier", "id", F.round("score", 6).alias("score"))


def sdg_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People served by water-type parts and hours of lead by region."""
    ps = T.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(T.table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    n = T.table(spark, sf_dir, "supplier").join(T.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    g = ps.join(n, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_regionkey").agg(F.sum(F.when(F.col("p_size") > 25, F.col("l_quantity")).otherwise(0.0)).alias("q"), F.countDistinct("l_suppkey").alias("mitigated"))
    return g.select("n_regionkey", (F.greatest(F.lit(300.0), F.col("q")) * 6.0).alias("water"), (38.5 + 9.5 * F.col("mitigated")).alias("lead_hours"))


def replay_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest per user of all events in order: equal for equal replays."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("h"))
    return S.digests(e, "user_id", "event_id", "h")


QUERIES = {f.__name__: f for f in (
    action_cards, report_recommendations, forecast_labels, ring_positions, client_keys, driver_sentences, edge_costs, claim_verdicts, superseded, newest_announcements, retrieval_anchors, sdg_scorecard, replay_hash,
)}

from .impact import _DUP, _HOT  # noqa: E402

ORACLES = {
    "action_cards": """WITH v AS (SELECT c_custkey AS village_id, (c_custkey % 20) / 20.0::DOUBLE AS p, TIMESTAMP '2024-01-29 12:00:00' + to_hours(c_custkey % 24) AS at_t FROM customer)
        SELECT village_id, 'card-' || village_id || '-' || strftime(at_t, '%Y-%m-%dT%H:%M:%S') AS alert_id, CASE WHEN p >= 0.75 THEN 'RED' ELSE 'ORANGE' END AS stage, CASE WHEN p >= 0.75 THEN 'Evacuate now' ELSE 'Prepare to evacuate' END AS headline,
        at_t + INTERVAL 6 HOUR AS valid_until, CASE WHEN village_id % 6 = 0 THEN 'no open route' ELSE 'shelter ' || (village_id % 9) END AS route FROM v WHERE p >= 0.5""",
    "report_recommendations": f"""{T.with_tables('reports')}, {_DUP}, {_HOT}, u AS (SELECT r.id, (r.id % 9) / 8.0::DOUBLE AS q, (r.id % 10) / 10.0::DOUBLE AS rel, category, dup.id IS NOT NULL AS d, m[2] AS of_id, n FROM reports r JOIN hot USING (id) LEFT JOIN dup USING (id)),
        s AS (SELECT *, greatest(0, least(100, (id % 5 + 1) * 10 + round_even(rel * 12, 0) + round_even(q * 8, 0) + least(15, greatest(0, n - 1) * 3) + round_even((id % 21) / 20.0::DOUBLE * 20, 0) - CASE WHEN d THEN 8 ELSE 0 END)) AS urgency FROM u)
        SELECT id, CASE WHEN rel < 0.35 OR q < 0.25 THEN '{X.HOLD}' WHEN d THEN printf('{X.LINK}', of_id::VARCHAR) WHEN urgency >= 70 THEN printf('{X.HIGH}', CASE WHEN category = 'click' THEN '{X.CLOSURE}' ELSE '{X.RESTRICT}' END)
            WHEN urgency >= 45 OR n >= 4 THEN '{X.PRIORITISE}' ELSE '{X.ACKNOWLEDGE}' END AS what FROM s""",
    "forecast_labels": """WITH o AS (SELECT o_orderdate::DATE AS day FROM orders), t AS (SELECT max(day) - 4 AS today FROM o)
        SELECT CASE day - today WHEN 0 THEN 'TODAY' WHEN 1 THEN 'TOMORROW' ELSE upper(strftime(day, '%a')) END AS label, count(*) AS n FROM o, t WHERE day >= today GROUP BY 1""",
    "ring_positions": """WITH h AS (SELECT c_custkey, c_mktsegment AS m, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM customer)
        SELECT c_custkey, hash, hash % 360 AS angle, upper(left(m, 1)) || lower(substr(m, 2)) AS title FROM h""",
    "driver_sentences": f"""{T.with_tables('terrain')}, p AS (SELECT cell_id, unnest(['slope', 'height', 'soil moisture']) AS g, unnest([(slope - 25) / 50, (elevation - 1200) / 4000, (cell_id % 9 - 4) / 16.0::DOUBLE]) AS x FROM terrain),
        k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(x) DESC, g) AS r FROM p),
        s AS (SELECT cell_id, string_agg(g || ' (' || CASE WHEN x >= 0 THEN '+' ELSE '-' END || abs(round(x * 100))::BIGINT || '%)', ', ' ORDER BY r) AS t FROM k WHERE r <= 2 GROUP BY 1)
        SELECT cell_id, t || CASE WHEN contains(t, 'soil moisture') THEN ' (modelled)' ELSE '' END AS sentence FROM s""",
    "client_keys": """SELECT CASE WHEN event_id % 3 = 0 THEN 'h' || (user_id % 5) WHEN event_id % 2 = 0 THEN 'sock' || (user_id % 4) ELSE 'unknown' END AS client, count(*) AS n FROM events GROUP BY 1""",
    "edge_costs": f"""{T.with_tables('roads')}, c AS (SELECT class, p_blocked * 0.8::DOUBLE AS d, length / 4 AS base, u * 2.0::DOUBLE AS slope FROM roads), k AS (SELECT class, CASE WHEN d < 0.45 THEN base * (1 + 4 * pow(d / (0.45::DOUBLE - d + 0.05), 2) + 2.5 * greatest(slope - 18, 0) / 18) END AS cost FROM c)
        SELECT class, count(*) AS roads, count(*) FILTER (cost IS NULL) AS closed, round(sum(cost), 2) AS seconds FROM k GROUP BY 1""",
    "claim_verdicts": f"""{T.with_tables('roads')}, e AS (SELECT DISTINCT u AS src, v AS dst FROM roads WHERE u < v), t AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
        l AS (SELECT src, count(*) AS lower, bool_and(dst % 3 <> 0) AS dry FROM t WHERE src <> dst AND dst * 7 % 11 <= src * 7 % 11 - 1.5 GROUP BY 1),
        c AS (SELECT c_custkey AS report_id, c_custkey % 4 = 0 AS auth, (c_custkey % 20) / 10.0::DOUBLE >= 0.5 AND coalesce(lower, 0) >= 2 AND coalesce(dry, false) AND c_custkey % 4 <> 0 AS rej FROM customer LEFT JOIN l ON src = c_nationkey)
        SELECT report_id, CASE WHEN rej THEN 'REJECTED' WHEN auth THEN 'VERIFIED' ELSE 'PENDING' END AS state, CASE WHEN rej THEN 0.05::DOUBLE WHEN auth THEN 0.96 ELSE 0.78 END AS confidence FROM c""",
    "superseded": """WITH p AS (SELECT a.event_id, b.event_id AS superseded_by, a.ts, b.ts AS bts FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts AND (b.event_id % 5 = 0 OR b.event_id % 8 >= a.event_id % 8)
        QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) = 1) SELECT event_id, superseded_by, floor((epoch_us(bts) - epoch_us(ts)) / 1000000)::BIGINT AS seconds FROM p""",
    "newest_announcements": """WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM l""",
    "retrieval_anchors": """WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 17) / 4.0::DOUBLE + CASE WHEN s_nationkey % 5 = 0 THEN 0.45 ELSE 0.1 END AS score, s_nationkey % 5 = 0 AS critical FROM supplier),
        a AS (SELECT 0 AS tier, id, score FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT 1, id, score FROM s WHERE critical)
        SELECT tier, id, round(score, 6) AS score FROM a ORDER BY tier, CASE WHEN tier = 0 THEN -score END NULLS FIRST, id LIMIT 11""",
    "sdg_scorecard": """SELECT n_regionkey, greatest(300.0::DOUBLE, sum(CASE WHEN p_size > 25 THEN l_quantity ELSE 0 END)) * 6.0 AS water, 38.5::DOUBLE + 9.5 * count(DISTINCT l_suppkey) AS lead_hours
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "replay_hash": "SELECT user_id, sha256(string_agg(sha256(event_id || '|' || event_type), '' ORDER BY event_id)) AS digest, count(*)::INT AS events FROM events GROUP BY 1",
}
