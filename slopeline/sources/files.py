"""File sources and sinks of hazard data, with schemas fixed and rows checked by queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIO = """id string, aoi_id string, held_out_of_training boolean,
    provenance struct<confidence:string, method:string, sources:array<string>, disclaimer:string>,
    clock struct<start:timestamp, end:timestamp, frame_interval_minutes:int, default_speed_factor:double>,
    frames array<struct<t:timestamp, defaults:map<string,string>, cells:array<map<string,string>>>>,
    name string, event_date date, hazard_type string, trigger string, ground_truth string"""

# What every observation must hold.
REQUIRED = ("rain_1h", "rain_6h", "rain_24h", "rain_72h", "antecedent_7d", "antecedent_15d", "antecedent_30d")


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario file, frames nested."""
    return spark.read.schema(SCENARIO).option("multiLine", True).json(path)


def catalogue(found: DataFrame) -> DataFrame:
    return found.select("id", "aoi_id", F.size("frames").alias("frame_count"), F.col("clock.start").alias("start"), F.col("clock.end").alias("end"), F.col("provenance.confidence").alias("confidence"))


def observations(found: DataFrame) -> DataFrame:
    """A row per frame and cell: a cell's own values, else the frame's defaults; a value set to null
    by the cell stays null. ``missing`` lists required values that neither has."""
    cells = found.select("id", "aoi_id", F.explode("frames").alias("f")).select("id", "aoi_id", "f.t", "f.defaults", F.explode("f.cells").alias("cell"))
    get = lambda k: F.when(F.map_contains_key("cell", k), F.col("cell")[k]).otherwise(F.coalesce("defaults", F.create_map().cast("map<string,string>"))[k])
    out = cells.select("id", "aoi_id", "t", F.col("cell")["cell_id"].alias("cell_id"), *[get(k).try_cast("double").alias(k) for k in (*REQUIRED, "soil_moisture")])
    lacks = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED]), lambda x: x.isNotNull())
    return out.withColumns({"source": F.concat(F.lit("scenario:"), "id"), "is_reconstructed": F.lit(True), "missing": lacks})


def violations(found: DataFrame) -> DataFrame:
    """(id, rule): what a scenario breaks of the honesty, order and metadata rules."""
    made = F.col("provenance.confidence") == "reconstructed"
    held = F.coalesce("held_out_of_training", F.lit(False))
    times = F.transform("frames", lambda f: f["t"])
    pairs = F.zip_with(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a < b)
    rules = {
        "held out without reconstructed sources": held & ~(F.coalesce(made, F.lit(False)) & (F.size(F.coalesce("provenance.sources", F.array().cast("array<string>"))) > 0)),
        "reconstructed but not held out": F.coalesce(made, F.lit(False)) & ~held,
        "no frames": F.coalesce(F.size("frames"), F.lit(0)) <= 0,
        "ends before it starts": F.col("clock.end") < F.col("clock.start"),
        "frames out of order": ~F.forall(pairs, lambda ok: ok),
        "frame outside the clock": F.exists(times, lambda t: (t < F.col("clock.start")) | (t > F.col("clock.end"))),
        "held out without metadata": held & (F.col("name").isNull() | F.col("event_date").isNull() | F.col("hazard_type").isNull() | F.col("trigger").isNull() | F.col("ground_truth").isNull()),
    }
    each = F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()])
    return found.select("id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("rule"))


def seek(frames: DataFrame, to: str) -> DataFrame:
    """Frames from the first one at or after a time; from the last one if none is."""
    at = F.to_timestamp(F.lit(to))
    start = frames.agg(F.coalesce(F.min(F.when(F.col("t") >= at, F.col("t"))), F.max("t")).alias("start"))
    return frames.join(F.broadcast(start), F.col("t") >= F.col("start")).drop("start")


def graph_bundle(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, aoi_id, props) and (edge_id, rel_type, src_id, dst_id, props) of two JSON maps of lists."""
    whole = lambda p: spark.read.text(p, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = lambda p: whole(p).select(F.explode("m").alias("kind", "rows")).select("kind", F.explode("rows").alias("js"))
    get = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object("js", f"$.{k}"), F.lit("")) for k in keys])
    n = rows(nodes).select(get("id", "osmid", "node_id").alias("id"), F.col("kind").alias("label"), get("aoi_id").alias("aoi_id"), F.col("js").alias("props"))
    e = rows(edges).select(get("edge_id").alias("edge_id"), F.col("kind").alias("rel_type"), get("src_id", "u_id").alias("src_id"), get("dst_id", "v_id").alias("dst_id"), F.col("js").alias("props"))
    return n, e


def geojson(rows: DataFrame, coordinates: str, kind: str = "LineString") -> DataFrame:
    """(value): each row as a feature; other columns are its properties."""
    rest = [c for c in rows.columns if c != coordinates]
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def replace_partition(rows: DataFrame, path: str, key: str = "aoi_id") -> None:
    """Write rows so that the areas they hold are replaced and others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_series(rows: DataFrame, path: str) -> None:
    """Add readings to a store that is partitioned by day."""
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)
