"""The driver's tables seen as hazard tables: pure projections, each with its SQL twin.

``SQL`` holds the same projections for the SQL side of a query, as CTE bodies by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-29 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, ts, precip_mm): events as rain readings of a pixel."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pixel_id"), "ts", (F.col("value") / 100).alias("precip_mm"), "event_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, status, lat, lon, t): events as citizen reports."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("event_type").alias("category"),
        F.when(e % 7 == 0, "actioned").when(e % 11 == 0, "dismissed").otherwise("open").alias("status"),
        (23.6 + (e * 37 % 1000) / 4000).alias("lat"),
        (92.6 + (e * 91 % 1000) / 4000).alias("lon"),
        F.col("ts").alias("t"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, lat, lon, pop): suppliers as settlements."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("site_id"), (23.6 + (k * 53 % 997) / 3988).alias("lat"), (92.6 + (k * 71 % 991) / 3964).alias("lon"), F.floor(F.abs("s_acctbal")).cast("long").alias("pop")
    )


def villages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(village_id, lat, lon, pop, nation): customers as villages."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("village_id"), (23.6 + (k * 29 % 1009) / 4036).alias("lat"), (92.6 + (k * 83 % 1013) / 4052).alias("lon"), F.floor(F.abs("c_acctbal") / 10).cast("long").alias("pop"), F.col("c_nationkey").alias("nation")
    )


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, x, y, elevation, slope, aspect, relief, cover): parts as grid cells of 500 m."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("cell_id"), (k % 50 * 500.0).alias("x"), (F.floor(k / 50) * 500.0).alias("y"), F.col("p_retailprice").alias("elevation"),
        F.col("p_size").cast("double").alias("slope"), (F.col("p_size") * 7 % 360).cast("double").alias("aspect"), (F.col("p_size") * 4.0).alias("relief"), F.col("p_brand").alias("cover"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, p): labels with a score derived from the text's length."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100).alias("p")), "doc_id")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, edge_id, length, p_blocked, is_bridge, class): trade between nations as roads.

    A road joins nations whose keys are 1 or 5 apart; both directions are edges of their own.
    """
    t = lambda n: table(spark, sf_dir, n)
    trade = (
        t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    )
    u, v = F.col("u"), F.col("v")
    kind = F.element_at(F.array(*map(F.lit, ("trunk", "primary", "secondary", "tertiary", "residential", "service", "track"))), (u * v % 7 + 1).cast("int"))
    return trade.where(F.abs(u - v).isin(1, 5)).select(
        "u", "v", F.concat_ws("_", "u", "v").alias("edge_id"), (1e6 / F.col("n")).alias("length"), (F.col("n") % 100 / 100.0).alias("p_blocked"), ((u + v) % 4 == 0).alias("is_bridge"), kind.alias("class")
    )


SQL = {
    "rain": "SELECT CAST(user_id AS VARCHAR) AS pixel_id, ts, value / 100 AS precip_mm, event_id FROM events",
    "reports": """SELECT event_id AS id, event_type AS category,
        CASE WHEN event_id % 7 = 0 THEN 'actioned' WHEN event_id % 11 = 0 THEN 'dismissed' ELSE 'open' END AS status,
        23.6::DOUBLE + (event_id * 37 % 1000) / 4000.0::DOUBLE AS lat, 92.6::DOUBLE + (event_id * 91 % 1000) / 4000.0::DOUBLE AS lon, ts AS t FROM events""",
    "sites": """SELECT s_suppkey AS site_id, 23.6::DOUBLE + (s_suppkey * 53 % 997) / 3988.0::DOUBLE AS lat, 92.6::DOUBLE + (s_suppkey * 71 % 991) / 3964.0::DOUBLE AS lon,
        CAST(floor(abs(s_acctbal)) AS BIGINT) AS pop FROM supplier""",
    "villages": """SELECT c_custkey AS village_id, 23.6::DOUBLE + (c_custkey * 29 % 1009) / 4036.0::DOUBLE AS lat, 92.6::DOUBLE + (c_custkey * 83 % 1013) / 4052.0::DOUBLE AS lon,
        CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS pop, c_nationkey AS nation FROM customer""",
    "terrain": """SELECT p_partkey AS cell_id, (p_partkey % 50) * 500.0::DOUBLE AS x, (p_partkey // 50) * 500.0::DOUBLE AS y, p_retailprice AS elevation,
        p_size::DOUBLE AS slope, (p_size * 7 % 360)::DOUBLE AS aspect, p_size * 4.0::DOUBLE AS relief, p_brand AS cover FROM part""",
    "scored": "SELECT l.doc_id, l.quality AS y, (d.n_chars % 100) / 100.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)",
    "roads": """SELECT u, v, u || '_' || v AS edge_id, 1e6 / n AS length, (n % 100) / 100.0::DOUBLE AS p_blocked, (u + v) % 4 = 0 AS is_bridge,
        (['trunk', 'primary', 'secondary', 'tertiary', 'residential', 'service', 'track'])[u * v % 7 + 1] AS class
        FROM (SELECT c_nationkey AS u, s_nationkey AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        WHERE abs(u - v) IN (1, 5)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The head of an SQL query that names these projections."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
