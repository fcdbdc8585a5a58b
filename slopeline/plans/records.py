"""Evaluation tables, ordered state, text and audit records, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import joins as J
from ..operators import state as S
from ..operators import trends as L
from ..sources import tables as T


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(T.scored(spark, sf_dir)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(T.scored(spark, sf_dir)).withColumn("caught", F.round("caught", 6))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(T.scored(spark, sf_dir)).select(F.round("auc", 8).alias("auc"))


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(T.scored(spark, sf_dir)).select(F.round("ap", 8).alias("ap"))


def quadrant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, positives and complement of each spatial block."""
    q = E.quadrants(T.villages(spark, sf_dir)).withColumn("y", (F.col("pop") > 500).cast("int"))
    b = q.groupBy("block").agg(F.count(F.lit(1)).alias("n_test"), F.sum("y").alias("n_pos"))
    total = q.agg(F.count(F.lit(1)).alias("n"))
    return b.join(F.broadcast(total)).select("block", "n_test", "n_pos", (F.col("n") - F.col("n_test")).alias("n_train"))


def terrain_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.strata(T.terrain(spark, sf_dir), "slope")
    n = s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def stratified_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives per positive (every 40th cell), spread over strata like the positives."""
    s = E.strata(T.terrain(spark, sf_dir), "slope")
    wanted = s.where("cell_id % 40 = 0").groupBy("stratum").agg((F.count(F.lit(1)) * 3).alias("n"))
    return E.stratified(s.where("cell_id % 40 <> 0").select("cell_id", "stratum"), wanted, "cell_id")


def top_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups of features move each cell most."""
    t = T.terrain(spark, sf_dir).select("cell_id", (F.col("slope") - 25).alias("s"), (F.col("relief") / 50 - 2).alias("r"), F.cos(F.radians("aspect")).alias("a"), (F.col("elevation") / 1000 - 1).alias("e"), (F.col("cell_id") % 7 - 3).cast("double").alias("k"))
    out = E.attributions(t, "cell_id", {"slope": ["s"], "shape": ["r", "a"], "height": ["e"], "soil": ["k"]}, top=2)
    return out.select("cell_id", "rank", "grp", F.round("contribution", 6).alias("contribution"), F.round("pct", 4).alias("pct"))


def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect as sine and cosine, cover one-hot (null is all zero), compass octant, wetness."""
    t = T.terrain(spark, sf_dir)
    hot = [F.coalesce((F.col("cover") == f"Brand#{i}").cast("int"), F.lit(0)).alias(f"cover_{i}") for i in range(1, 6)]
    return t.select("cell_id", F.round(F.sin(F.radians("aspect")), 6).alias("sin_a"), F.round(F.cos(F.radians("aspect")), 6).alias("cos_a"), *hot, R.compass(F.col("aspect")).alias("octant"), F.round(R.twi(F.lit(2.0), F.lit(30.0), F.col("slope")), 6).alias("twi"))


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence quality of pages taken as photos by their size."""
    n = F.length("html")
    p = T.table(spark, sf_dir, "pages").select("page_id", R.image_quality(n * 20, n % 1100, n % 777).alias("q"))
    return p.select("page_id", F.col("q").alias("quality"))


def escalation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("t"), F.least(F.lit(1.0), F.col("value") / 500).alias("p"))
    out = S.escalations(e, "user_id", "p", "t")
    return out.select("user_id", "seq", F.col("t.ts").alias("ts"), "from_stage", "to_stage")


def first_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each entity first reached each stage."""
    t = escalation_transitions(spark, sf_dir)
    first = lambda s: F.min(F.when(F.col("to_stage") == s, F.col("ts"))).alias(s.lower())
    return t.groupBy("user_id").agg(first("YELLOW"), first("ORANGE"), first("RED"), F.count(F.lit(1)).alias("changes"))


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.coalesce("props", F.lit("")).alias("payload"))
    return S.hash_chain(e, "user_id", "event_id")


def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains, links, and links that fail when each is hashed again, after some have been tampered with:
    a changed kind breaks its own link, a changed hash also the link behind it."""
    c = audit_chain(spark, sf_dir)
    kind = F.when(F.col("event_id") % 97 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind"))
    told = S.verify_chain(c.withColumn("kind", kind).withColumn("hash", F.when(F.col("event_id") % 101 == 0, F.reverse("hash")).otherwise(F.col("hash"))), "user_id")
    return told.agg(F.countDistinct("user_id").alias("chains"), F.count(F.lit(1)).alias("links"), F.count_if(~F.col("ok")).alias("broken"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed and rejected calls per client at two an hour, and the longest wait."""
    e = T.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    r = S.rate_limited(e, "user_id", "at", 2, 3600.0)
    return r.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"), F.round(F.max("retry_after"), 3).alias("longest_wait"))


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per client and breaker state; errors and clicks of small value count as failures."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").between(0, 300).alias("ok"))
    return S.circuit(e, "user_id", "event_id", 3, 86400.0).groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"))


# Keywords by category in order, and words of severity.
KEYWORDS = {
    "Slope crack": ("crack", "fissure", "split", "slope opening"),
    "Blocked road": ("blocked road", "road blocked", "cannot pass", "traffic stopped"),
    "Rockfall or debris": ("rockfall", "rocks", "debris", "mudslide", "landslide"),
    "Water seepage": ("seepage", "water", "spring", "leak", "saturated"),
    "Retaining wall damage": ("retaining wall", "wall damage", "bulging wall", "collapsed wall"),
}
SEVERE = ("urgent", "collapsed", "people trapped", "impassable", "large crack", "active rockfall")
MILD = ("small", "minor", "hairline", "slow seepage")


def _any(text, words):
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def keyword_classify(spark: SparkSession, sf_dir: str, categories: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """Category, severity and relevance of every document by the first keyword list that hits."""
    text = F.lower("text")
    category = F.lit("Other")
    for name, words in reversed(list(categories.items())):
        category = F.when(_any(text, words), name).otherwise(category)
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text", category.alias("category"), F.when(_any(text, SEVERE), 5).when(_any(text, MILD), 2).otherwise(3).alias("severity"))
    return d.select("doc_id", "category", "severity", F.when(F.col("category") != "Other", 0.78).when(F.length("text") > 0, 0.5).otherwise(0.25).alias("relevance"))


def lexical_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents with most of the query's words in their text: a report, so limited."""
    tokens = ("license", "rights", "the", "general", "public", "version")
    text = F.lower("text")
    hits = sum((F.contains(text, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    d = T.table(spark, sf_dir, "documents").select("doc_id", (0.5 * hits + F.when(F.col("lang") == "en", 0.45).otherwise(0.1)).alias("score"))
    return d.orderBy(F.desc("score"), "doc_id").limit(5)


def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, whether the parts it names are all among the first 1500, and its rank among those that pass."""
    li = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("cited"))
    ok = F.size("cited") > 0
    bad = F.size(F.filter("cited", lambda x: x > 1500))
    return li.groupBy((ok & (bad == 0)).alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cited")).alias("citations"), F.sum(bad).alias("outside"))


def chat_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten turns of each conversation, with their characters."""
    c = T.table(spark, sf_dir, "conversations")
    late = G.per_key_top(c, "conv_id", [F.desc("turn")], 10)
    return late.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("from_turn"), F.sum(F.length("text")).alias("chars"))


def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of conversation turns: in all, by role, and by size class."""
    n = F.coalesce(F.length("text"), F.lit(0))
    t_in, t_out = F.greatest(F.lit(12), F.floor(n / 4)), F.greatest(F.lit(8), F.floor(n / 8))
    heavy = F.col("turn") % 2 == 0
    cost = (t_in * F.when(heavy, 0.80).otherwise(0.15) + t_out * F.when(heavy, 2.40).otherwise(0.60)) / 1e6
    c = T.table(spark, sf_dir, "conversations").select("role", F.when(heavy, "heavy").otherwise("fast").alias("tier"), t_in.alias("t_in"), t_out.alias("t_out"), F.round(cost, 7).alias("cost"))
    g = c.groupingSets([[], [F.col("role")], [F.col("tier")]], "role", "tier").agg(F.count(F.lit(1)).alias("steps"), F.sum("t_in").cast("long").alias("t_in"), F.sum("t_out").cast("long").alias("t_out"), F.round(F.sum("cost"), 6).alias("cost"))
    return g


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances with those of one segment replaced by new ones."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") + 100, 2).alias("c_acctbal"))
    return J.upsert(c, new, "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def merge_left_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their road-severed neighbours, an empty list where none, and the driving one."""
    r = T.roads(spark, sf_dir).where("p_blocked >= 0.5").groupBy(F.col("u").alias("n_nationkey")).agg(F.sort_array(F.collect_set("v")).alias("cut"), F.max_by("v", F.struct("p_blocked", -F.col("v"))).alias("driver"))
    n = T.table(spark, sf_dir, "nation").join(r, "n_nationkey", "left")
    return n.select("n_nationkey", F.coalesce(F.concat_ws(",", F.transform("cut", lambda x: x.cast("string"))), F.lit("")).alias("cut"), "driver")


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders by segment, and orders by whether their customer is known: semi and anti joins."""
    c, o = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "orders")
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    some = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return none.withColumn("ordered", F.lit(False)).unionByName(some.withColumn("ordered", F.lit(True)))


def channel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients, deliveries and acknowledgements by channel: of each user's events of a type the last counts."""
    last = T.table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("channel")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.count(F.lit(1)).alias("sent"))
    return last.groupBy("channel").agg(F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("v") > 50).alias("delivered"), F.count_if(F.col("v") > 250).alias("acknowledged"), F.sum("sent").alias("sent"))


def cap_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert message in XML for every settlement: urgency by stage, text escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    s = T.table(spark, sf_dir, "supplier").withColumn("stage", R.stage(F.col("s_suppkey") % 20 / 20))
    urgency = F.when(F.col("stage") == "RED", "Immediate").when(F.col("stage") == "ORANGE", "Expected").when(F.col("stage") == "YELLOW", "Future").otherwise("Past")
    xml = F.concat(F.lit("<info><event>Landslide "), F.col("stage"), F.lit("</event><urgency>"), urgency, F.lit("</urgency><headline>"), esc(F.concat_ws(" & ", "s_name", "stage")), F.lit("</headline></info>"))
    return s.select("s_suppkey", xml.alias("xml"))


def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pipe tables in documents: lines with three cells or more, counted by document."""
    line = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cells = F.filter(F.transform(F.split("line", "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    return line.where(F.contains("line", F.lit("|"))).select("doc_id", F.size(cells).alias("c")).where("c >= 3").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("c").alias("widest"))


def frame_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events, by id, do not move forward in time: how often and the worst step back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = T.table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w)).where("ts <= before")
    back = F.unix_micros(F.col("before").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(back / 1000000)).alias("worst_s"))


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that should be unique but are not, per table."""
    parts = []
    for name, key in (("nation", "n_name"), ("customer", "c_name"), ("part", "p_name"), ("documents", "text")):
        t = T.table(spark, sf_dir, name).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(t.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn("tbl", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers, with suppliers, with both, with either, and with customers alone."""
    c = T.table(spark, sf_dir, "customer").where("c_acctbal > 900").select(F.col("c_nationkey").alias("k"))
    s = T.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys")).withColumn("what", F.lit(n))
    out = count(c.distinct(), "customers").unionByName(count(s.distinct(), "suppliers"))
    return out.unionByName(count(c.intersect(s), "both")).unionByName(count(c.union(s).distinct(), "either")).unionByName(count(c.subtract(s), "customers only"))


def sql_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of each supplier's unit price over the days, told in SQL by the registered functions."""
    L.register_trends(spark)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    points = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), days.cast("double").alias("x"), price.alias("y"))
    return spark.sql(
        """SELECT CAST(key AS BIGINT) AS supplier, trend_count(s) AS n, round(trend_slope(s), 6) AS slope, round(trend_intercept(s), 3) AS intercept, round(trend_fit(s), 6) AS fit
        FROM (SELECT key, trend_merge(state) AS s FROM trend_states(TABLE({points})) GROUP BY key)""",
        points=points,
    )


QUERIES = {f.__name__: f for f in (
    sql_trends,
    calibration, confusion, auc_rank, avg_precision, quadrant_blocks, terrain_strata, stratified_negatives, top_attributions, engineered_features, image_scores, escalation_transitions,
    first_escalations, audit_chain, audit_chain_verify, rate_limit, circuit_breaker, keyword_classify, lexical_retrieval, citation_gate, chat_last10, telemetry_rollup, keyed_upsert,
    merge_left_display, unmatched, channel_totals, cap_messages, md_tables, frame_order_violations, unique_violations, set_algebra,
)}

_STRATA = "q AS (SELECT quantile_cont(slope, 1/3.0::DOUBLE) AS q1, quantile_cont(slope, 2/3.0::DOUBLE) AS q2 FROM terrain), s AS (SELECT t.*, (CASE WHEN slope <= q1 THEN 0 WHEN slope <= q2 THEN 1 ELSE 2 END)::INT AS stratum FROM terrain t, q)"
_ESC = """e AS (SELECT user_id, ts, least(1, value / 500) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT *, CASE WHEN p >= 0.75 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 1 ELSE 0 END AS raw FROM e),
    f AS (SELECT user_id, 0::BIGINT AS rn, 0 AS was, 0 AS now, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT f.user_id, r.rn, f.now, CASE WHEN raw > now THEN raw WHEN raw < now AND p < now * 0.25 - 0.1 THEN raw ELSE now END, r.ts FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1),
    g AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY rn) - 1)::INT AS seq, ts, (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[was + 1] AS from_stage, (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[now + 1] AS to_stage FROM f WHERE was <> now)"""
_CHAIN = """e AS (SELECT user_id, event_id, event_type AS kind, sha256(coalesce(props, '')) AS input_hash, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
    c AS (SELECT user_id, seq, event_id, kind, input_hash, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ':' || input_hash || ':' || event_id || ':' || kind) AS hash FROM e WHERE seq = 0
        UNION ALL SELECT e.user_id, e.seq, e.event_id, e.kind, e.input_hash, c.hash, sha256(c.hash || ':' || e.input_hash || ':' || e.event_id || ':' || e.kind) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)"""


def _like(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(t, '{w}')" for w in words)


ORACLES = {
    "sql_trends": """SELECT l_suppkey AS supplier, regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 6) AS fit
        FROM (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS x, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS y FROM lineitem) GROUP BY l_suppkey""",
    "calibration": f"{T.with_tables('scored')} SELECT CASE WHEN p <= 0.25 THEN 0.25::DOUBLE WHEN p <= 0.5 THEN 0.5 WHEN p <= 0.75 THEN 0.75 WHEN p <= 1 THEN 1 END AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM scored GROUP BY 1",
    "confusion": f"""{T.with_tables('scored')} SELECT threshold, count(*) FILTER (p >= threshold AND y > 0) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y > 0) AS fn,
        count(*) FILTER (p < threshold AND y = 0) AS tn, round(count(*) FILTER (p >= threshold AND y > 0) / count(*) FILTER (y > 0), 6) AS caught FROM scored, (VALUES (0.3::DOUBLE), (0.5), (0.7)) t(threshold) GROUP BY 1""",
    "auc_rank": f"""{T.with_tables('scored')}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scored)
        SELECT round((sum(rk) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y = 0)), 8) AS auc FROM r""",
    "avg_precision": f"""{T.with_tables('scored')}, s AS (SELECT p, count(*) FILTER (y > 0) AS pos, count(*) AS n FROM scored GROUP BY p), w AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM s)
        SELECT round(sum(pos * tp / seen) / sum(pos), 8) AS ap FROM w""",
    "quadrant_blocks": f"""{T.with_tables('villages')}, q AS (SELECT CASE WHEN lat >= (SELECT median(lat) FROM villages) THEN 'N' ELSE 'S' END || CASE WHEN lon >= (SELECT median(lon) FROM villages) THEN 'E' ELSE 'W' END AS block, pop FROM villages)
        SELECT block, count(*) AS n_test, count(*) FILTER (pop > 500) AS n_pos, (SELECT count(*) FROM q) - count(*) AS n_train FROM q GROUP BY 1""",
    "terrain_strata": f"{T.with_tables('terrain')}, {_STRATA} SELECT stratum, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1",
    "stratified_negatives": f"""{T.with_tables('terrain')}, {_STRATA}, w AS (SELECT stratum, count(*) * 3 AS n FROM s WHERE cell_id % 40 = 0 GROUP BY 1),
        r AS (SELECT cell_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256(cell_id::VARCHAR), cell_id) AS rk FROM s WHERE cell_id % 40 <> 0) SELECT stratum, cell_id FROM r JOIN w USING (stratum) WHERE rk <= n""",
    "top_attributions": f"""{T.with_tables('terrain')}, g AS (SELECT cell_id, unnest(['slope', 'shape', 'height', 'soil']) AS grp, unnest([slope - 25, relief / 50 - 2 + cos(radians(aspect)), elevation / 1000 - 1, (cell_id % 7 - 3)::DOUBLE]) AS x FROM terrain),
        r AS (SELECT *, (row_number() OVER (PARTITION BY cell_id ORDER BY abs(x) DESC, grp) - 1)::INT AS rank, sum(abs(x)) OVER (PARTITION BY cell_id) AS total FROM g)
        SELECT cell_id, rank, grp, round(x, 6) AS contribution, round(100 * abs(x) / CASE WHEN total > 0 THEN total ELSE 1 END, 4) AS pct FROM r WHERE rank < 2""",
    "engineered_features": f"""{T.with_tables('terrain')} SELECT cell_id, round(sin(radians(aspect)), 6) AS sin_a, round(cos(radians(aspect)), 6) AS cos_a, coalesce((cover = 'Brand#1')::INT, 0) AS cover_1, coalesce((cover = 'Brand#2')::INT, 0) AS cover_2,
        coalesce((cover = 'Brand#3')::INT, 0) AS cover_3, coalesce((cover = 'Brand#4')::INT, 0) AS cover_4, coalesce((cover = 'Brand#5')::INT, 0) AS cover_5,
        (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[floor(((aspect % 360) + 22.5) / 45)::INT % 8 + 1] AS octant, round(ln(60 / tan(radians(greatest(slope, 0.1)))), 6) AS twi FROM terrain""",
    "image_scores": """SELECT page_id, round(least(1, 0.15 + CASE WHEN n * 20 >= 20000 THEN 0.2 ELSE 0 END + CASE WHEN n * 20 >= 100000 THEN 0.15 ELSE 0 END + CASE WHEN w > 0 AND h > 0 THEN
        CASE WHEN least(w, h) >= 480 THEN 0.25 WHEN least(w, h) >= 320 THEN 0.12 ELSE 0 END + CASE WHEN greatest(w, h) >= 640 THEN 0.15 ELSE 0 END + CASE WHEN greatest(w, h) >= 960 THEN 0.25 ELSE 0 END ELSE 0 END)::DOUBLE, 3) AS quality
        FROM (SELECT page_id, length(html) AS n, length(html) % 1100 AS w, length(html) % 777 AS h FROM pages)""",
    "escalation_transitions": f"WITH RECURSIVE {_ESC} SELECT * FROM g",
    "first_escalations": f"WITH RECURSIVE {_ESC} SELECT user_id, min(ts) FILTER (to_stage = 'YELLOW') AS yellow, min(ts) FILTER (to_stage = 'ORANGE') AS orange, min(ts) FILTER (to_stage = 'RED') AS red, count(*) AS changes FROM g GROUP BY 1",
    "audit_chain": f"WITH RECURSIVE {_CHAIN} SELECT user_id, seq::INT AS seq, event_id, kind, input_hash, prev_hash, hash FROM c",
    "audit_chain_verify": f"""WITH RECURSIVE {_CHAIN}, x AS (SELECT user_id, seq, event_id, CASE WHEN event_id % 97 = 0 THEN kind || '!' ELSE kind END AS kind, input_hash, prev_hash, CASE WHEN event_id % 101 = 0 THEN reverse(hash) ELSE hash END AS hash FROM c),
        v AS (SELECT *, hash = sha256(prev_hash || ':' || input_hash || ':' || event_id || ':' || kind) AND prev_hash = coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY seq), repeat('0', 64)) AS ok FROM x)
        SELECT count(DISTINCT user_id) AS chains, count(*) AS links, count(*) FILTER (NOT ok) AS broken FROM v""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
        f AS (SELECT user_id, 0::BIGINT AS rn, []::DOUBLE[] AS hits, true AS ok, 0.0::DOUBLE AS wait FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL SELECT user_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, sec) ELSE live END, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE live[1] + 3600 - sec END
            FROM (SELECT e.user_id, e.rn, e.sec, list_filter(f.hits, lambda h: h > e.sec - 3600) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
        SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS rejected, round(max(wait), 3) AS longest_wait FROM f WHERE rn > 0 GROUP BY 1""",
    "circuit_breaker": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, value BETWEEN 0 AND 300 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        f AS (SELECT user_id, 0::BIGINT AS rn, 'CLOSED' AS state, 0 AS bad, 0.0::DOUBLE AS since FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL SELECT user_id, rn, CASE WHEN blocked OR opens THEN 'OPEN' WHEN ok THEN 'CLOSED' ELSE state END, CASE WHEN blocked THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN opens THEN sec ELSE since END
            FROM (SELECT *, NOT blocked AND NOT ok AND (trial OR bad + 1 >= 3) AS opens FROM (SELECT e.*, f.state, f.bad, f.since, f.state = 'OPEN' AND e.sec - f.since >= 86400 AS trial, f.state = 'OPEN' AND e.sec - f.since < 86400 AS blocked
                FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))
        SELECT user_id, state, count(*) AS n FROM f WHERE rn > 0 GROUP BY 1, 2""",
    "keyword_classify": f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, t, CASE {' '.join(f"WHEN {_like(w)} THEN '{k}'" for k, w in KEYWORDS.items())} ELSE 'Other' END AS category,
        CASE WHEN {_like(SEVERE)} THEN 5 WHEN {_like(MILD)} THEN 2 ELSE 3 END AS severity FROM d) SELECT doc_id, category, severity, CASE WHEN category <> 'Other' THEN 0.78::DOUBLE WHEN length(t) > 0 THEN 0.5 ELSE 0.25 END AS relevance FROM c""",
    "lexical_retrieval": """SELECT doc_id, 0.5::DOUBLE * (contains(t, 'license')::INT + contains(t, 'rights')::INT + contains(t, 'the')::INT + contains(t, 'general')::INT + contains(t, 'public')::INT + contains(t, 'version')::INT)
        + CASE WHEN lang = 'en' THEN 0.45::DOUBLE ELSE 0.1 END AS score FROM (SELECT doc_id, lang, lower(text) AS t FROM documents) ORDER BY score DESC, doc_id LIMIT 5""",
    "citation_gate": """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (l_partkey > 1500) AS bad FROM lineitem GROUP BY 1)
        SELECT bad = 0 AS passed, count(*) AS n, sum(n)::BIGINT AS citations, sum(bad)::BIGINT AS outside FROM c GROUP BY 1""",
    "chat_last10": """SELECT conv_id, count(*) AS turns, min(turn) AS from_turn, sum(length(text))::BIGINT AS chars FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) GROUP BY 1""",
    "telemetry_rollup": """WITH t AS (SELECT role, CASE WHEN turn % 2 = 0 THEN 'heavy' ELSE 'fast' END AS tier, greatest(12, coalesce(length(text), 0) // 4) AS t_in, greatest(8, coalesce(length(text), 0) // 8) AS t_out FROM conversations),
        c AS (SELECT *, round((t_in * CASE tier WHEN 'heavy' THEN 0.80::DOUBLE ELSE 0.15 END + t_out * CASE tier WHEN 'heavy' THEN 2.40::DOUBLE ELSE 0.60 END) / 1e6, 7) AS cost FROM t)
        SELECT role, tier, count(*) AS steps, sum(t_in)::BIGINT AS t_in, sum(t_out)::BIGINT AS t_out, round(sum(cost), 6) AS cost FROM c GROUP BY GROUPING SETS ((), (role), (tier))""",
    "keyed_upsert": "SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 100, 2) ELSE c_acctbal END), 2) AS total FROM customer GROUP BY 1",
    "merge_left_display": f"""{T.with_tables('roads')}, r AS (SELECT u, list_sort(list(DISTINCT v)) AS cut, arg_max(v, (p_blocked, -v)) AS driver FROM roads WHERE p_blocked >= 0.5 GROUP BY 1)
        SELECT n_nationkey, coalesce(array_to_string(cut, ','), '') AS cut, driver FROM nation LEFT JOIN r ON u = n_nationkey""",
    "unmatched": "SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS ordered, count(*) AS n FROM customer GROUP BY 1, 2",
    "channel_totals": """WITH l AS (SELECT user_id, event_type AS channel, arg_max(value, (ts, event_id)) AS v, count(*) AS sent FROM events GROUP BY 1, 2)
        SELECT channel, count(*) AS recipients, count(*) FILTER (v > 50) AS delivered, count(*) FILTER (v > 250) AS acknowledged, sum(sent)::BIGINT AS sent FROM l GROUP BY 1""",
    "cap_messages": """WITH s AS (SELECT s_suppkey, s_name, CASE WHEN p >= 0.75 THEN 'RED' WHEN p >= 0.5 THEN 'ORANGE' WHEN p >= 0.25 THEN 'YELLOW' ELSE 'GREEN' END AS stage FROM (SELECT *, (s_suppkey % 20) / 20.0::DOUBLE AS p FROM supplier))
        SELECT s_suppkey, '<info><event>Landslide ' || stage || '</event><urgency>' || CASE stage WHEN 'RED' THEN 'Immediate' WHEN 'ORANGE' THEN 'Expected' WHEN 'YELLOW' THEN 'Future' ELSE 'Past' END || '</urgency><headline>'
            || replace(replace(replace(s_name || ' & ' || stage, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</headline></info>' AS xml FROM s""",
    "md_tables": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, len(list_filter(string_split(line, '|'), lambda x: trim(x) <> ''))::INT AS c FROM l WHERE contains(line, '|'))
        SELECT doc_id, count(*) AS rows, max(c) AS widest FROM c WHERE c >= 3 GROUP BY 1""",
    "frame_order_violations": """WITH w AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
        SELECT user_id, count(*) AS n, max(floor((epoch_us(before) - epoch_us(ts)) / 1000000))::BIGINT AS worst_s FROM w WHERE ts <= before GROUP BY 1""",
    "unique_violations": " UNION ALL ".join(
        f"SELECT count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS rows, '{t}' AS tbl FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in (("nation", "n_name"), ("customer", "c_name"), ("part", "p_name"), ("documents", "text"))
    ),
    "set_algebra": """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 900), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0),
        a AS (SELECT 'customers' AS what, k FROM c UNION ALL SELECT 'suppliers', k FROM s UNION ALL SELECT 'both', k FROM (FROM c INTERSECT FROM s) UNION ALL SELECT 'either', k FROM (FROM c UNION FROM s) UNION ALL SELECT 'customers only', k FROM (FROM c EXCEPT FROM s))
        SELECT w.what, count(k) AS n, coalesce(sum(k), 0)::BIGINT AS keys FROM (VALUES ('customers'), ('suppliers'), ('both'), ('either'), ('customers only')) w(what) LEFT JOIN a USING (what) GROUP BY 1""",
}
