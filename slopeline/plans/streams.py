"""Streaming queries, run over what is there and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators import windows as W
from ..session import shared_dir
from ..sources import replay as R
from ..streaming import processors as P
from ..streaming import tick


def _run(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = P.event_stream(spark, f"{sf_dir}/events.parquet", watermark="60 days")
    return P.drain(make(stream), base + "/table", base + "/state", mode)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, P.tumbling, "complete").withColumn("start", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, P.sliding, "complete").withColumn("start", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, P.sessions, "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, P.distinct_reports).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


def stream_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, P.escalation_stream)
    return out.groupBy("user_id", "from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows in append mode over events in three files, the last of which holds rows that come days
    behind the first: with a watermark of an hour they are left out, as are windows still open. (Spark
    filters by the watermark that the batch before last has set, hence three.)"""
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i, part in enumerate(("event_id % 10 NOT IN (3, 5)", "event_id % 10 = 5", "event_id % 10 = 3")):
        e.where(part).coalesce(1).write.parquet(f"{base}/in/batch={i}")
    stream = P.event_stream(spark, f"{base}/in/batch=*/part-*.parquet", watermark="1 hour")
    out = P.drain(P.tumbling(stream), base + "/table", base + "/state")
    return out.withColumn("start", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


def stream_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that repeat an earlier one nearby, as they come in one batch: what the batch operator finds."""
    base = f"{shared_dir(spark)}/dup-{uuid.uuid4().hex}"
    stream = P.event_stream(spark, f"{sf_dir}/events.parquet", watermark="60 days")
    k = F.col("event_id")
    reports = stream.select(
        k.alias("id"), F.col("event_type").alias("category"), F.when(k % 7 == 0, "actioned").when(k % 11 == 0, "dismissed").otherwise("open").alias("status"),
        F.col("ts").alias("t"), (23.6 + (k * 37 % 1000) / 4000).alias("lat"), (92.6 + (k * 91 % 1000) / 4000).alias("lon"),
    )
    out = P.drain(P.near_duplicates(reports), base + "/table", base + "/state")
    return out.select("id", "duplicate_of", F.round("km", 6).alias("km"))


_AREAS = ("click", "view", "purchase", "signup", "error")


def tick_stream(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """All frames of five areas through the tick, as files that come one after the other; the stream is
    stopped half way and started again on its checkpoint.

    A frame is six hours of events of one type, a cell is a user, a village is a customer. A last file
    holds the frame of another area a month later, which lets the watermark pass all others.
    """
    base = f"{shared_dir(spark)}/tick-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("t")
    cells = e.groupBy(F.col("event_type").alias("aoi"), t, F.col("user_id").alias("cell_id")).agg((F.sum("value") / 500).alias("ratio"))
    cell = F.struct("cell_id", F.struct(F.least(F.lit(1.0), F.col("ratio")).alias("p"), F.col("ratio")).alias("v"))
    frames = cells.groupBy("aoi", "t").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    frames.write.parquet(f"{base}/frames")
    frames = spark.read.parquet(f"{base}/frames")
    at = F.unix_seconds("t")
    low, high = frames.agg(F.min(at), F.max(at)).first()
    told = frames.withColumn("part", F.floor((at - low) * parts / (high - low + 1)))
    villages = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("village_id"), (F.col("c_custkey") % 150 + 1).alias("cell_id"), F.element_at(F.array(*map(F.lit, _AREAS)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("aoi"))

    def run() -> DataFrame:
        with tick.rocks(spark):
            rows = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in/*").withWatermark("t", "6 hours")
            return P.drain(tick.ticks(rows, villages), base + "/table", base + "/state")

    for i in range(parts):
        told.where(F.col("part") == i).drop("part").repartition(2, "aoi").write.parquet(f"{base}/in/{i}")
        if i == parts // 2:
            run()
    last = told.agg(F.lit("clock").alias("aoi"), (F.max("t") + F.expr("INTERVAL 30 DAYS")).alias("t"), F.create_map().cast(frames.schema["cells"].dataType).alias("cells"))
    last.drop("part").write.parquet(f"{base}/in/{parts}")
    found = W.safe_window(S.verify_chain(run(), "aoi"))
    flagged = F.col("kind") == "AI_FLAGGED"
    shown = lambda c, digits: F.when(flagged, F.round(c, digits)).alias(c)
    return found.select("aoi", "seq", F.to_timestamp_ntz(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("t"), "kind", "village_id", "payload", "ok", F.when(flagged, F.col("basis")).alias("basis"), shown("lo_h", 4), shown("hi_h", 4), shown("confidence", 4))


def replayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as frames of six hours played from the replay source: half of them, then, on the same
    checkpoint, a seek back to the tenth frame and all to the end. Each position with its rows."""
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    spark.dataSource.register(R.ReplaySource)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.window("ts", "6 hours").start.cast("timestamp_ntz")
    frames = e.select("event_id", "value", t.alias("t")).repartitionByRange("t").sortWithinPartitions("t")
    frames.write.option("parquet.block.size", 1 << 20).parquet(f"{base}/frames")
    controls = R.Controls(f"{base}/control.json", f"{base}/frames")

    def run() -> DataFrame:
        rows = spark.readStream.format("replay").option("path", f"{base}/frames").option("control", f"{base}/control.json").load()
        return P.drain(rows, base + "/table", base + "/state")

    controls.advance(len(controls.times) // 2)
    run()
    controls.seek(controls.times[min(9, len(controls.times) - 1)])
    controls.advance(len(controls.times))
    out = run().groupBy("position").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("event_id").alias("events"))
    return out.withColumn("t", F.to_timestamp_ntz(F.date_format("t", "yyyy-MM-dd HH:mm:ss")))


QUERIES = {f.__name__: f for f in (tick_stream, replayed_frames, stream_tumbling, stream_sliding, stream_sessions, stream_dedup, stream_escalation, stream_late, stream_near_duplicates)}

from .impact import ORACLES as _IMPACT  # noqa: E402

ORACLES = {
    "replayed_frames": """WITH f AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS t, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_id) AS events FROM events GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS frames FROM f)
        SELECT i AS position, t, n, total, events FROM o WHERE i < frames // 2
        UNION ALL SELECT frames // 2 + i - least(9, frames - 1), t, n, total, events FROM o WHERE i >= least(9, frames - 1)""",
    "tick_stream": """WITH RECURSIVE e AS (SELECT event_type AS aoi, time_bucket(INTERVAL 6 HOUR, ts) AS t, user_id AS cell_id, sum(value) / 500 AS ratio FROM events GROUP BY 1, 2, 3),
        f AS (SELECT aoi, t, count(*) AS cells, max(least(1, ratio)) AS p, max(ratio) AS ratio FROM e GROUP BY 1, 2),
        v AS (SELECT c_custkey AS village_id, c_custkey % 150 + 1 AS cell_id, (['click', 'view', 'purchase', 'signup', 'error'])[c_custkey % 5 + 1] AS aoi FROM customer),
        o AS (SELECT f.aoi, f.t, v.village_id, least(1, coalesce(e.ratio, 0)) AS p, row_number() OVER (PARTITION BY v.village_id ORDER BY f.t) AS rn
            FROM f JOIN v USING (aoi) LEFT JOIN e ON e.aoi = f.aoi AND e.t = f.t AND e.cell_id = v.cell_id),
        r AS (SELECT *, CASE WHEN p >= 0.75 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 1 ELSE 0 END AS raw FROM o),
        g AS (SELECT village_id, NULL::VARCHAR AS aoi, NULL::TIMESTAMP AS t, 0::BIGINT AS rn, 0 AS was, 0 AS now FROM v
            UNION ALL SELECT g.village_id, r.aoi, r.t, r.rn, g.now, CASE WHEN raw > now THEN raw WHEN raw < now AND p < now * 0.25 - 0.1 THEN raw ELSE now END FROM g JOIN r ON r.village_id = g.village_id AND r.rn = g.rn + 1),
        m AS (SELECT aoi, t, village_id, village_id || ':' || (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[was + 1] || ':' || (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[now + 1] AS payload FROM g WHERE was <> now),
        x AS (SELECT *, date_diff('second', min(t) OVER (PARTITION BY aoi), t) / 3600.0::DOUBLE AS x FROM f),
        fit AS (SELECT *, count(*) OVER w AS n, regr_slope(ratio, x) OVER w AS slope, regr_intercept(ratio, x) OVER w AS intercept, CASE WHEN var_pop(ratio) OVER w > 0 THEN greatest(0, regr_r2(ratio, x) OVER w) ELSE 0 END AS r2
            FROM x WINDOW w AS (PARTITION BY aoi ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
        c AS (SELECT *, CASE WHEN slope > 0 THEN (1 - intercept) / slope - x END AS hit FROM fit),
        b AS (SELECT *, CASE WHEN ratio >= 1 THEN 'critical now' WHEN n < 3 THEN 'too few points' WHEN coalesce(slope, 0) <= 0 THEN 'flat or falling'
            WHEN hit <= 0 THEN 'trend is past critical' WHEN hit > 72 THEN 'beyond the horizon' ELSE 'projected' END AS basis FROM c),
        s AS (SELECT aoi, t, 'AI_FLAGGED' AS kind, NULL::BIGINT AS village_id, cells || ':' || round(p * 1000000)::BIGINT AS payload, basis,
                round(CASE WHEN basis IN ('critical now', 'trend is past critical') THEN 0 WHEN basis = 'projected' THEN greatest(0, hit - greatest(0.25 * hit, 0.5)) END, 4) AS lo_h,
                round(CASE WHEN basis IN ('critical now', 'trend is past critical') THEN 1 WHEN basis = 'projected' THEN hit + greatest(0.25 * hit, 0.5) END, 4) AS hi_h,
                round(CASE basis WHEN 'critical now' THEN 1 WHEN 'trend is past critical' THEN least(r2, 0.95) WHEN 'projected' THEN least(0.95, r2 * least(1, n / 5)) ELSE 0 END, 4) AS confidence FROM b
            UNION ALL SELECT aoi, t, 'ESCALATED', village_id, payload, NULL, NULL, NULL, NULL FROM m)
        SELECT aoi, row_number() OVER (PARTITION BY aoi ORDER BY t, kind, village_id) - 1 AS seq, t, kind, village_id, payload, true AS ok, basis, lo_h, hi_h, confidence FROM s""",
    "stream_near_duplicates": _IMPACT["report_dedup"],
    "stream_late": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events WHERE event_id % 10 NOT IN (3, 5))
        SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m WHERE (event_id % 10 <> 3 OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > w)
            AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= greatest(w, (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) GROUP BY 1, 2""",
    "stream_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": """WITH w AS (SELECT unnest(range(6)) AS k), e AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, user_id, value / 100 AS mm FROM events, w)
        SELECT start, user_id, round(sum(mm), 4) AS mm FROM e GROUP BY 1, 2""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), n AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM n GROUP BY 1""",
    "stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "stream_escalation": """WITH RECURSIVE e AS (SELECT user_id, value / 500 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        r AS (SELECT *, CASE WHEN p >= 0.75 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 1 ELSE 0 END AS raw FROM e),
        f AS (SELECT user_id, 0::BIGINT AS rn, 0 AS was, 0 AS now FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL SELECT f.user_id, r.rn, f.now, CASE WHEN raw > now THEN raw WHEN raw < now AND p < now * 0.25 - 0.1 THEN raw ELSE now END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
        SELECT user_id, (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[was + 1] AS from_stage, (['GREEN', 'YELLOW', 'ORANGE', 'RED'])[now + 1] AS to_stage, count(*) AS n FROM f WHERE was <> now GROUP BY 1, 2, 3""",
}
