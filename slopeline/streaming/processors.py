"""Structured Streaming twins of the batch operators: same rules, state kept by Spark."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..functions.geo import cell_of, km_cells
from ..sources.files import observations, scenarios


def event_stream(spark: SparkSession, path: str, *, watermark: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of files; ``ts`` becomes a timestamp with a zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + f"[{path[-1]}]")  # as a pattern, so that one file will do too
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(rows: DataFrame, size: str = "6 hours") -> DataFrame:
    """Events and their value per window and type. In append mode a window is told once, when the watermark
    has passed it, and rows later than that are left out; in complete mode nothing is."""
    w = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(rows: DataFrame, size: str = "6 hours", step: str = "1 hour") -> DataFrame:
    w = rows.groupBy(F.window("ts", size, step), "user_id").agg((F.sum("value") / 100).alias("mm"))
    return w.select(F.col("window.start").alias("start"), "user_id", F.round("mm", 4).alias("mm"))


def sessions(rows: DataFrame, gap: str = "12 hours") -> DataFrame:
    w = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_reports(rows: DataFrame) -> DataFrame:
    """The first event of a user and type within the watermark's span."""
    return rows.dropDuplicatesWithinWatermark(["user_id", "event_type"])


_ALERTS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("from_stage", T.StringType()), T.StructField("to_stage", T.StringType())])
_ENTRY = (0.0, C.YELLOW, C.ORANGE, C.RED)


def next_stage(now: int, p: float) -> int:
    """The stage after a reading: up at once, down only when clearly below the current entry."""
    raw = sum(p >= e for e in _ENTRY) - 1
    return raw if raw > now or (raw < now and p < _ENTRY[now] - C.HYSTERESIS) else now


def escalate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One entity's readings of a micro-batch, in order of time; state is the stage it is in."""
    now = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        new = next_stage(now, r.value / 500)
        if new != now:
            out.append((key[0], r.event_id, C.STAGES[now], C.STAGES[new]))
        now = new
    state.update((now,))
    yield pd.DataFrame(out, columns=_ALERTS.fieldNames())


def escalation_stream(rows: DataFrame) -> DataFrame:
    """Changes of stage per user as they happen. Within a micro-batch readings are put in order; one that
    comes in a later batch than a newer reading of its user is taken as it comes, as a live feed does."""
    return rows.groupBy("user_id").applyInPandasWithState(escalate, _ALERTS, "stage int", "append", GroupStateTimeout.NoTimeout)


_DUPLICATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("duplicate_of", T.LongType()), T.StructField("km", T.DoubleType())])


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half = lambda a, b: math.sin(math.radians(b - a) / 2) ** 2
    h = half(lat1, lat2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon1, lon2)
    return 2 * C.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def near_duplicates(reports: DataFrame, *, km: float = C.DEDUP_KM, hours: int = C.DEDUP_HOURS) -> DataFrame:
    """(id, duplicate_of, km): the nearest earlier open report of the category in space and time, as reports come.

    ``reports``: id, category, status, t (timestamp with watermark), lat, lon (up to 60 degrees). State is
    kept per category and grid cell; a report is asked in its own cell and remembered in the nine around
    it, for ``hours`` behind the newest report seen there.
    """
    dlat, dlon = km_cells(km, 60.0)
    span = hours * 3_600_000_000
    y, x = cell_of(F.col("lat"), dlat), cell_of(F.col("lon"), dlon)
    around = F.array(*[F.struct((y + i).alias("cy"), (x + j).alias("cx"), F.lit(i == 0 and j == 0).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    opened = ~F.coalesce(F.col("status").isin(*C.CLOSED), F.lit(False))
    sent = reports.select("id", "category", F.unix_micros("t").alias("at"), "lat", "lon", opened.alias("opened"), F.explode(around).alias("c")).select("id", "category", "at", "lat", "lon", "opened", "c.*")
    # A closed report is only asked, never remembered.
    sent = sent.where("own OR opened")

    def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The open reports (micros, id) of each place as they came, but for old ones. ``least`` leaves out those that a
        # later one with a smaller id stands in front of, so its first one has the smallest id.
        held: dict[tuple, deque] = {}
        least: dict[tuple, deque] = {}
        mixed = set()  # places whose reports came out of order: an earlier micro-batch was ahead of this one
        apart: dict[tuple, list] = {}  # for each place asked the places within reach with their distances

        def keep(at: int, id: int, place: tuple) -> None:
            if place not in held:
                held[place], least[place] = deque(), deque()
                for asked, near in apart.items():
                    if (d := _km(*asked, *place)) <= km:
                        near.append((d, place))
            rest, front = held[place], least[place]
            if rest and rest[-1] > (at, id):
                mixed.add(place)
            while rest and rest[0][0] < at - span and place not in mixed:
                rest.popleft()
            rest.append((at, id))
            while front and front[-1][1] > id:
                front.pop()
            front.append((at, id))

        def smallest(at: int, id: int, place: tuple) -> int | None:
            """The smallest id of a place's open reports before one report."""
            rest, front = held[place], least[place]
            if place in mixed or rest[-1] >= (at, id):
                return min((i for t, i in rest if t >= at - span and (t, i) < (at, id)), default=None)
            while front and front[0][0] < at - span:
                front.popleft()
            return front[0][1] if front else None

        if state.exists:
            for id, at, lat, lon in zip(*state.get):
                keep(at, id, (lat, lon))
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for id, at, lat, lon, opened, own in zip(*(rows[c].tolist() for c in ("id", "at", "lat", "lon", "opened", "own"))):
            place, newest = (lat, lon), at
            if own:
                if place not in apart:
                    apart[place] = [(d, p) for p in held if (d := _km(lat, lon, *p)) <= km]
                near = min(((d, first) for d, p in apart[place] if (first := smallest(at, id, p)) is not None), default=None)
                if near:
                    out.append((id, near[1], near[0]))
            if opened:
                keep(at, id, place)
        left = [(id, at, *p) for p, rest in held.items() for at, id in rest if at >= newest - span]
        left.sort(key=lambda h: (h[1], h[0]))
        state.update(tuple(map(list, zip(*left))) if left else ([], [], [], []))
        yield pd.DataFrame(out, columns=_DUPLICATE.fieldNames())

    kept = "ids array<long>, micros array<long>, lats array<double>, lons array<double>"
    return sent.groupBy("category", "cy", "cx").applyInPandasWithState(remember, _DUPLICATE, kept, "append", GroupStateTimeout.NoTimeout)


_VERDICT = T.StructType([T.StructField(n, k) for n, k in (("report_id", T.LongType()), ("state", T.StringType()), ("confidence", T.DoubleType()), ("supersedes", T.LongType()))])


def claim_stream(claims: DataFrame) -> DataFrame:
    """(report_id, state, confidence, supersedes): verdicts on claims about a place as they come.

    ``claims``: place, report_id, ts, depth, authority, lower, dry (its lower surroundings; see the batch
    rule). A claim of the place that stands is superseded by a newer one with authority or at least its
    confidence; rejected claims supersede nothing.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        standing = state.get if state.exists else None  # (report, confidence)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "report_id"]).itertuples():
            rejected = r.depth >= 0.5 and r.lower >= 2 and bool(r.dry) and not r.authority
            verdict, confidence = ("REJECTED", 0.05) if rejected else ("VERIFIED", 0.96) if r.authority else ("PENDING", 0.78)
            replaced = None
            if not rejected and (standing is None or r.authority or confidence >= standing[1]):
                replaced = standing[0] if standing else None
                standing = (r.report_id, confidence)
            out.append((r.report_id, verdict, confidence, replaced))
        if standing:
            state.update(standing)
        yield pd.DataFrame(out, columns=_VERDICT.fieldNames()).astype({"supersedes": "Int64"})

    return claims.groupBy("place").applyInPandasWithState(judge, _VERDICT, "report_id long, confidence double", "append", GroupStateTimeout.NoTimeout)


def live_stub(spark: SparkSession, aoi_id: str = "aizawl", rows_per_second: int = 1) -> DataFrame:
    """A stand-in for a live feed: every tick nine cells with the same observation, marked as fabricated."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.format_string("stub_%03d", i)))
    values = {"rain_1h": 2.0, "rain_6h": 8.0, "rain_24h": 20.0, "rain_72h": 40.0, "antecedent_7d": 60.0, "antecedent_15d": 90.0, "antecedent_30d": 140.0, "soil_moisture": 0.4}
    return ticks.select(F.col("timestamp").alias("t"), F.lit(aoi_id).alias("aoi_id"), cell.alias("cell_id"), *[F.lit(v).alias(k) for k, v in values.items()], F.lit("fabricated").alias("source"), F.lit(False).alias("is_reconstructed"))


def source(spark: SparkSession, mode: str, path: str | None = None, aoi_id: str = "aizawl") -> DataFrame:
    """Observations of a mode: LIVE a stream, REPLAY the frames of scenario files in a folder."""
    if mode == "LIVE":
        return live_stub(spark, aoi_id)
    if mode != "REPLAY" or path is None:
        raise ValueError("the mode is LIVE, or REPLAY with a path")
    return observations(scenarios(spark, path))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a table, and read the table."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a batch that is retried replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
