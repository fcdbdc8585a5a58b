"""Rainfall risk: trailing features, exceedance, stages, storms, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import risk as R
from ..operators import windows as W
from ..sources import tables as T


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trailing_sums(T.rain(spark, sf_dir), F.to_timestamp_ntz(F.lit(T.NOW)))


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each pixel as observations of a cell, with their exceedance ratio."""
    ratio = R.exceedance_ratio({1: F.col("rain_1h"), 6: F.col("rain_6h"), 24: F.col("rain_24h"), 72: F.col("rain_72h")})
    return _features(spark, sf_dir).withColumn("ratio", ratio).withColumn("ml", F.col("pixel_id").cast("long") % 10 / 10)


_FEATURES = """features AS (SELECT pixel_id,
    sum(CASE WHEN ts >= n - INTERVAL 1 HOUR THEN precip_mm ELSE 0 END) AS rain_1h, sum(CASE WHEN ts >= n - INTERVAL 6 HOUR THEN precip_mm ELSE 0 END) AS rain_6h,
    sum(CASE WHEN ts >= n - INTERVAL 24 HOUR THEN precip_mm ELSE 0 END) AS rain_24h, sum(CASE WHEN ts >= n - INTERVAL 72 HOUR THEN precip_mm ELSE 0 END) AS rain_72h,
    sum(CASE WHEN ts >= n - INTERVAL 168 HOUR THEN precip_mm ELSE 0 END) AS antecedent_7d, sum(CASE WHEN ts >= n - INTERVAL 360 HOUR THEN precip_mm ELSE 0 END) AS antecedent_15d,
    sum(CASE WHEN ts >= n - INTERVAL 720 HOUR THEN precip_mm ELSE 0 END) AS antecedent_30d, min(ts) AS first_ts
    FROM (SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS n FROM rain) GROUP BY pixel_id)"""
_OBS = """obs AS (SELECT *, greatest(rain_1h / 1 / (5.8294 * pow(1, -0.4141)), rain_6h / 6 / (5.8294 * pow(6, -0.4141)), rain_24h / 24 / (5.8294 * pow(24, -0.4141)),
    rain_72h / 72 / (5.8294 * pow(72, -0.4141)), rain_72h / (-11.10 + 0.62 * 72)) AS ratio, (CAST(pixel_id AS BIGINT) % 10) / 10.0::DOUBLE AS ml FROM features)"""
_HEAD = f"{T.with_tables('rain')}, {_FEATURES}, {_OBS}"
_STAGE = "CASE WHEN p >= 0.75 THEN 'RED' WHEN p >= 0.5 THEN 'ORANGE' WHEN p >= 0.25 THEN 'YELLOW' ELSE 'GREEN' END"


def exceedance_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: trailing rain to exceedance, fused probability, confidence and stage of every cell."""
    p = R.fuse(F.col("ml"), F.col("ratio"))
    rows = _obs(spark, sf_dir).withColumn("p", p)
    return rows.select(
        F.col("pixel_id").alias("cell_id"), F.round("ratio", 6).alias("ratio"), F.round("p", 6).alias("p_fail"), F.round(R.entropy_confidence(F.col("p")), 6).alias("confidence"), R.stage(F.col("p")).alias("stage")
    )


def trailing_rain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return f.select("pixel_id", *[F.round(c, 6).alias(c) for c in f.columns if c.startswith(("rain", "ante"))], "first_ts")


def stage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per stage, stages without cells included."""
    counts = exceedance_fusion(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.sql("SELECT posexplode(array('GREEN', 'YELLOW', 'ORANGE', 'RED')) AS (rank, stage)")
    return dim.join(counts, "stage", "left").select("rank", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six riskiest cells at or above 0.5: a report, so limited."""
    rows = _obs(spark, sf_dir).select("pixel_id", R.fuse(F.col("ml"), F.col("ratio")).alias("p"))
    return rows.where("p >= 0.5").orderBy(F.desc("p"), "pixel_id").limit(6).select("pixel_id", F.round("p", 6).alias("p_fail"))


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, the worst probability (0 without cells), the mean, and the riskiest cell."""
    rows = _obs(spark, sf_dir).select("pixel_id", R.fuse(F.col("ml"), F.col("ratio")).alias("p"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.coalesce(F.max("p"), F.lit(0.0)), 6).alias("max_p"), F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 6).alias("mean_p"),
        F.min_by("pixel_id", F.struct(-F.col("p"), F.col("pixel_id"))).alias("worst"),
    )


def hourly_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling sums for hours that have rain, and the worst ratio per pixel and hour."""
    h = W.hourly(T.rain(spark, sf_dir))
    r = W.rolling(h, "pixel_id", "hour", "mm", {"r1": 1, "r6": 6, "r24": 24, "r72": 72})
    ratio = R.exceedance_ratio({1: F.col("r1"), 6: F.col("r6"), 24: F.col("r24"), 72: F.col("r72")})
    return r.select("pixel_id", "hour", F.round("r6", 6).alias("r6"), F.round("r72", 6).alias("r72"), F.round(ratio, 6).alias("ratio"))


_HOURLY = """hourly AS (SELECT pixel_id, date_trunc('hour', ts) AS hour, sum(precip_mm) AS mm FROM rain GROUP BY 1, 2),
    rolled AS (SELECT *, mm AS r1, sum(mm) OVER (w RANGE INTERVAL 5 HOUR PRECEDING) AS r6, sum(mm) OVER (w RANGE INTERVAL 23 HOUR PRECEDING) AS r24, sum(mm) OVER (w RANGE INTERVAL 71 HOUR PRECEDING) AS r72
    FROM hourly WINDOW w AS (PARTITION BY pixel_id ORDER BY hour)),
    traj AS (SELECT *, greatest(r1 / 5.8294, r6 / 6 / (5.8294 * pow(6, -0.4141)), r24 / 24 / (5.8294 * pow(24, -0.4141)),
    r72 / 72 / (5.8294 * pow(72, -0.4141)), r72 / 33.54) AS ratio FROM rolled)"""


def soil_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = W.rolling(W.hourly(T.rain(spark, sf_dir)), "pixel_id", "hour", "mm", {"r72": 72})
    return W.soil_proxy(h, "pixel_id", "r72").select("pixel_id", "hour", "soil_moisture")


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = W.rolling(W.hourly(T.rain(spark, sf_dir)), "pixel_id", "hour", "mm", {"r1": 1, "r6": 6, "r24": 24, "r72": 72})
    ratio = R.exceedance_ratio({1: F.col("r1"), 6: F.col("r6"), 24: F.col("r24"), 72: F.col("r72")})
    return W.trend(h.withColumn("ratio", ratio / 20), "pixel_id", "hour", "ratio")


def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fit(spark, sf_dir)
    return f.select("pixel_id", "n", *[F.round(c, 6).alias(c) for c in ("x_last", "y_last", "slope", "intercept", "r2")])


def safe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.safe_window(_fit(spark, sf_dir))
    return s.select("pixel_id", "basis", *[F.round(c, 4).alias(c) for c in ("lo_h", "hi_h", "confidence")])


_FIT = """late AS (SELECT pixel_id, hour, ratio / 20 AS ratio, row_number() OVER (PARTITION BY pixel_id ORDER BY hour DESC) AS rn FROM traj),
    pts AS (SELECT *, date_diff('second', min(hour) OVER (PARTITION BY pixel_id), hour) / 3600.0::DOUBLE AS x FROM late WHERE rn <= 50),
    fit AS (SELECT pixel_id, count(*) AS n, max(x) AS x_last, arg_max(ratio, hour) AS y_last, regr_slope(ratio, x) AS slope, regr_intercept(ratio, x) AS intercept,
    CASE WHEN var_pop(ratio) > 0 THEN greatest(0, regr_r2(ratio, x)) ELSE 0 END AS r2 FROM pts GROUP BY pixel_id)"""


def hyetographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's storm of 24 steps for every pixel with rain, as deep as its last month."""
    storms = _features(spark, sf_dir).select(F.col("pixel_id").alias("storm"), F.col("antecedent_30d").alias("total_mm"), F.lit(24).alias("n_steps"), (F.col("pixel_id").cast("int") % 24).alias("peak"))
    return W.hyetograph(storms).select("storm", "step", F.round("mm", 6).alias("mm"))


def whatif_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even storms of several depths and durations over every terrain cell, counted by stage."""
    depths = spark.sql("SELECT d.depth, h.hours FROM (SELECT explode(array(50.0D, 100.0D, 200.0D, 400.0D)) AS depth) d CROSS JOIN (SELECT explode(array(6.0D, 24.0D, 72.0D)) AS hours) h")
    ratio = R.exceedance_ratio({w: R.uniform_storm(F.col("depth"), F.col("hours"), w) for w in (1, 6, 24, 72)})
    # The ratio depends on the storm alone; each cell then weighs it by its slope.
    storms = F.broadcast(depths.withColumn("ratio", ratio))  # twelve rows
    cells = T.terrain(spark, sf_dir).join(storms).withColumn("p", R.clamp01(F.col("ratio") * F.col("slope") / 50))
    return cells.groupBy("depth", "hours").agg(
        F.count_if(F.col("p") >= 0.75).alias("severe"), F.count_if(F.col("p") >= 0.55).alias("elevated"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.max("p"), 6).alias("max_p")
    )


def forecast_5day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily worst risk, level and counts over five days of evolving probabilities."""
    days = F.broadcast(spark.range(1).select(F.posexplode(F.array(*map(F.lit, C.FORECAST_FACTORS))).alias("day", "factor")))
    rows = _obs(spark, sf_dir).select("pixel_id", "ratio", R.fuse(F.col("ml"), F.col("ratio")).alias("p0")).join(days)
    rows = rows.withColumn("p", R.clamp01(F.col("p0") * (0.72 + 0.28 * F.col("factor"))))
    day = rows.groupBy("day").agg(F.max("p").alias("top"), F.max(1 - 2 * F.abs(F.col("p") - 0.5)).alias("conf"), F.count_if(F.col("p") >= 0.5).alias("n_high"), F.avg(F.col("ratio") * F.col("factor") * 24).alias("mm"))
    return day.select("day", F.round("top", 6).alias("top"), F.round("conf", 6).alias("conf"), "n_high", F.round("mm", 5).alias("mm"), R.level_label(F.col("top")).alias("level"))


def missing_half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour slots of January that no reading fills."""
    ts = lambda x: F.to_timestamp_ntz(F.lit(x))
    return W.fill_gaps(T.rain(spark, sf_dir), ts("2024-01-01 00:00:00"), ts("2024-01-30 23:30:00"))


def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rain(spark, sf_dir).select("pixel_id", "ts", "event_id", "precip_mm")
    return W.latest(rows, "pixel_id", F.struct("ts", "event_id")).select("pixel_id", "ts", "event_id", F.round("precip_mm", 6).alias("precip_mm"))


def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per pixel by pass and quality: morning before evening, recommended first."""
    rows = T.rain(spark, sf_dir).select("pixel_id", "event_id", (F.hour("ts") >= 12).alias("pm"), (F.col("event_id").bitwiseAND(1) != 0).alias("poor"), "precip_mm")
    best = rows.groupBy("pixel_id").agg(F.min(F.struct("poor", "pm", "event_id", "precip_mm")).alias("b"))
    return best.select("pixel_id", F.when(F.col("b.pm"), "PM").otherwise("AM").alias("pass_name"), (~F.col("b.poor")).alias("recommended"), F.col("b.event_id").alias("event_id"), F.round("b.precip_mm", 6).alias("precip_mm"))


QUERIES = {f.__name__: f for f in (
    exceedance_fusion, trailing_rain_features, stage_histogram, top_cells, flag_summary, hourly_exceedance, soil_moisture, ols_trend, safe_window, hyetographs, whatif_sweep, forecast_5day, missing_half_hours, latest_reading, best_reading,
)}

_P = "greatest(ml, least(1, greatest(0, ratio)))"
_Q = "least(1 - 1e-9, greatest(1e-9, p))"
ORACLES = {
    "exceedance_fusion": f"""{_HEAD} SELECT pixel_id AS cell_id, round(ratio, 6) AS ratio, round(p, 6) AS p_fail,
        round(1 + {_Q} * log2({_Q}) + (1 - {_Q}) * log2(1 - {_Q}), 6) AS confidence, {_STAGE} AS stage FROM (SELECT *, {_P} AS p FROM obs)""",
    "trailing_rain_features": f"""{T.with_tables('rain')}, {_FEATURES} SELECT pixel_id, round(rain_1h, 6) AS rain_1h, round(rain_6h, 6) AS rain_6h, round(rain_24h, 6) AS rain_24h,
        round(rain_72h, 6) AS rain_72h, round(antecedent_7d, 6) AS antecedent_7d, round(antecedent_15d, 6) AS antecedent_15d, round(antecedent_30d, 6) AS antecedent_30d, first_ts FROM features""",
    "stage_histogram": f"""{_HEAD}, c AS (SELECT {_STAGE} AS stage, count(*) AS n FROM (SELECT {_P} AS p FROM obs) GROUP BY 1)
        SELECT rank::INT AS rank, stage, coalesce(n, 0)::BIGINT AS n FROM (VALUES (0, 'GREEN'), (1, 'YELLOW'), (2, 'ORANGE'), (3, 'RED')) d(rank, stage) LEFT JOIN c USING (stage)""",
    "top_cells": f"{_HEAD} SELECT pixel_id, round(p, 6) AS p_fail FROM (SELECT pixel_id, {_P} AS p FROM obs) WHERE p >= 0.5 ORDER BY p DESC, pixel_id LIMIT 6",
    "flag_summary": f"""{_HEAD}, q AS (SELECT pixel_id, {_P} AS p FROM obs) SELECT count(*) AS n_cells, round(coalesce(max(p), 0), 6) AS max_p, round(coalesce(avg(p), 0), 6) AS mean_p,
        (SELECT pixel_id FROM q ORDER BY p DESC, pixel_id LIMIT 1) AS worst FROM q""",
    "hourly_exceedance": f"{T.with_tables('rain')}, {_HOURLY} SELECT pixel_id, hour, round(r6, 6) AS r6, round(r72, 6) AS r72, round(ratio, 6) AS ratio FROM traj",
    "soil_moisture": f"""{T.with_tables('rain')}, {_HOURLY}, m AS (SELECT pixel_id, hour, round(r72, 6) AS r, max(round(r72, 6)) OVER (PARTITION BY pixel_id) AS top FROM traj)
        SELECT pixel_id, hour, CASE WHEN top > 0 THEN round(0.22::DOUBLE + 0.70::DOUBLE * r / top, 4) ELSE 0.22::DOUBLE END AS soil_moisture FROM m""",
    "ols_trend": f"""{T.with_tables('rain')}, {_HOURLY}, {_FIT} SELECT pixel_id, n, round(x_last, 6) AS x_last, round(y_last, 6) AS y_last, round(slope, 6) AS slope,
        round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM fit""",
    "safe_window": f"""{T.with_tables('rain')}, {_HOURLY}, {_FIT}, c AS (SELECT *, CASE WHEN slope > 0 THEN (1 - intercept) / slope - x_last END AS hit FROM fit),
        b AS (SELECT *, CASE WHEN y_last >= 1 THEN 'critical now' WHEN n < 3 THEN 'too few points' WHEN x_last = 0 THEN 'one timestamp' WHEN coalesce(slope, 0) <= 0 THEN 'flat or falling'
            WHEN hit <= 0 THEN 'trend is past critical' WHEN hit > 72 THEN 'beyond the horizon' ELSE 'projected' END AS basis FROM c)
        SELECT pixel_id, basis, round(CASE WHEN basis IN ('critical now', 'trend is past critical') THEN 0 WHEN basis = 'projected' THEN greatest(0, hit - greatest(0.25 * hit, 0.5)) END, 4) AS lo_h,
            round(CASE WHEN basis IN ('critical now', 'trend is past critical') THEN 1 WHEN basis = 'projected' THEN hit + greatest(0.25 * hit, 0.5) END, 4) AS hi_h,
            round(CASE basis WHEN 'critical now' THEN 1 WHEN 'trend is past critical' THEN least(r2, 0.95) WHEN 'projected' THEN least(0.95, r2 * least(1, n / 5)) ELSE 0 END, 4) AS confidence FROM b""",
    "hyetographs": f"""{T.with_tables('rain')}, {_FEATURES}, s AS (SELECT pixel_id AS storm, antecedent_30d AS total, CAST(pixel_id AS INT) % 24 AS peak, unnest(range(24))::INT AS step FROM features),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY storm ORDER BY CASE WHEN step = peak THEN 0
            WHEN step > peak THEN CASE WHEN step - peak <= peak THEN 2 * (step - peak) - 1 ELSE step - peak + peak END
            ELSE CASE WHEN peak - step <= 23 - peak THEN 2 * (peak - step) ELSE peak - step + 23 - peak END END) AS r FROM s)
        SELECT storm, step, round(total * (pow(r / 24, 0.5859) - pow((r - 1) / 24, 0.5859)), 6) AS mm FROM ranked""",
    "whatif_sweep": f"""{T.with_tables('terrain')}, s AS (SELECT depth::DOUBLE AS depth, hours::DOUBLE AS hours FROM (VALUES (50), (100), (200), (400)) a(depth), (VALUES (6), (24), (72)) b(hours)),
        a AS (SELECT *, depth / hours * least(1, hours) AS r1, depth / hours * least(6, hours) AS r6, depth / hours * least(24, hours) AS r24, depth / hours * least(72, hours) AS r72 FROM s),
        r AS (SELECT *, greatest(r1 / 5.8294, r6 / 6 / (5.8294 * pow(6, -0.4141)), r24 / 24 / (5.8294 * pow(24, -0.4141)), r72 / 72 / (5.8294 * pow(72, -0.4141)), r72 / 33.54) AS ratio FROM a),
        c AS (SELECT depth, hours, least(1, greatest(0, ratio * slope / 50)) AS p FROM terrain, r)
        SELECT depth, hours, count(*) FILTER (p >= 0.75) AS severe, count(*) FILTER (p >= 0.55) AS elevated, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p FROM c GROUP BY 1, 2""",
    "forecast_5day": f"""{_HEAD}, e AS (SELECT day, factor, ratio, least(1, greatest(0, {_P} * (0.72 + 0.28 * factor))) AS p
            FROM obs, (VALUES (0, 1.0::DOUBLE), (1, 1.14), (2, 0.96), (3, 0.74), (4, 0.56)) d(day, factor)),
        g AS (SELECT day::INT AS day, max(p) AS top, max(1 - 2 * abs(p - 0.5)) AS conf, count(*) FILTER (p >= 0.5) AS n_high, avg(ratio * factor * 24) AS mm FROM e GROUP BY 1)
        SELECT day, round(top, 6) AS top, round(conf, 6) AS conf, n_high, round(mm, 5) AS mm,
            CASE WHEN top >= 0.75 THEN 'VERY HIGH' WHEN top >= 0.5 THEN 'HIGH' WHEN top >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS level FROM g""",
    "missing_half_hours": """SELECT slot FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:30:00', INTERVAL 30 MINUTE)) AS slot)
        WHERE slot NOT IN (SELECT time_bucket(INTERVAL 30 MINUTE, ts) FROM events)""",
    "latest_reading": f"{T.with_tables('rain')} SELECT pixel_id, ts, event_id, round(precip_mm, 6) AS precip_mm FROM rain QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY ts DESC, event_id DESC) = 1",
    "best_reading": f"""{T.with_tables('rain')} SELECT pixel_id, CASE WHEN hour(ts) >= 12 THEN 'PM' ELSE 'AM' END AS pass_name, event_id % 2 = 0 AS recommended, event_id, round(precip_mm, 6) AS precip_mm
        FROM rain QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY event_id % 2, hour(ts) >= 12, event_id) = 1""",
}
