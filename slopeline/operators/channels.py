"""Simulated delivery over alert channels, photos as data URLs, and tree models on terrain and rain.

These need what built-in functions lack (a seeded generator, a walk over image markers, boosted
trees); they run in Arrow batches or through Spark's own machine learning.
"""

from __future__ import annotations

import hashlib
import random
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channels by least and largest latency in seconds, delivery rate, and acknowledgement rate of what is delivered.
CHANNELS = {"cell_broadcast": (2.0, 15.0, 0.97, 0.55), "sms": (5.0, 120.0, 0.90, 0.40), "push": (1.0, 20.0, 0.75, 0.60), "mesh": (60.0, 1800.0, 0.60, 0.30)}


def seed_of(alert_id: str, channel: str) -> int:
    """The generator's seed of an alert and channel: the same on every run."""
    return int.from_bytes(hashlib.sha256(f"{alert_id}:{channel}".encode()).digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF


def send(alert_id: str, channel: str, recipients: int) -> tuple[int, int, float]:
    """Delivered, acknowledged and the longest latency of one simulated sending."""
    if recipients < 0:
        raise ValueError("recipients must not be negative")
    low, high, delivery, ack = CHANNELS[channel]
    rng = random.Random(seed_of(alert_id, channel))
    delivered = acknowledged = 0
    longest = 0.0
    for _ in range(recipients):
        got = rng.random() < delivery
        seen = got and rng.random() < ack  # a draw only for what was delivered
        longest = max(longest, rng.uniform(low, high))
        delivered += got
        acknowledged += seen
    return delivered, acknowledged, longest


_RESULT = "alert_id string, channel string, recipients long, delivered long, acknowledged long, longest_s double"


def channel_results(alerts: DataFrame, channels: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
    """(alert_id, channel, recipients, delivered, acknowledged, longest_s) of alerts (alert_id, recipients)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, c, n or 0, *send(a, c, n or 0)) for a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in channels]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["alert_id", "channel", "recipients", "delivered", "acknowledged", "longest_s"])

    return alerts.where("alert_id is not null").select("alert_id", F.col("recipients").cast("long")).mapInArrow(run, _RESULT)


def photo(url: Column) -> dict[str, Column]:
    """Parts of a photo given as a base64 data URL: data, mime, width and height; data is null if it is not one.

    JPEG sides need ``jpeg_sides``; those of PNG and extended WebP are read here.
    """
    head, body = F.substring_index(url, ",", 1), F.when(F.contains(url, F.lit(",")), F.substring(url, F.instr(url, ",") + 1, F.length(url)))
    declared = F.lower(F.substring_index(F.substring(head, 6, F.length(head)), ";", 1))
    data = F.when(F.startswith(head, F.lit("data:")) & F.contains(head, F.lit(";base64")), F.try_to_binary(body, F.lit("base64")))
    hexed = lambda at, n: F.hex(F.substring(data, at, n))
    found = F.when(hexed(1, 8) == "89504E470D0A1A0A", "image/png").when(hexed(1, 3) == "FFD8FF", "image/jpeg").when((hexed(1, 4) == "52494646") & (hexed(9, 4) == "57454250"), "image/webp")
    ok = (found == declared) & (F.octet_length(data) <= 6 << 20)  # Fixed value: the largest upload.
    number = lambda h: F.conv(h, 16, 10).cast("long")
    little = lambda at: number(F.concat(hexed(at + 2, 1), hexed(at + 1, 1), hexed(at, 1)))
    webp = (found == "image/webp") & (hexed(13, 4) == "56503858")
    side = lambda png_at, webp_at: F.when(ok & (found == "image/png") & (F.octet_length(data) >= 24), number(hexed(png_at, 4))).when(ok & webp & (F.octet_length(data) >= 30), little(webp_at) + 1)
    return {"data": F.when(ok, data), "mime": F.when(ok, found), "width": side(17, 25), "height": side(21, 28)}


_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}  # markers of frame headers
_BARE = frozenset({0x00, 0x01, 0xFF, *range(0xD0, 0xDA)})  # markers without a segment behind them


def _sides(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the first frame header of a JPEG: hop from segment to segment."""
    at = data.find(b"\xff")
    while 0 <= at <= len(data) - 9:
        length, _, height, width = struct.unpack_from(">HBHH", data, at + 2)
        if data[at + 1] in _FRAMES:
            return width, height
        at = data.find(b"\xff", at + 1 if data[at + 1] in _BARE else at + 2 + max(length, 2))
    return None, None


def jpeg_sides(photos: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, width, height) of JPEG data; null where there is no frame header."""
    kind = photos.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sides(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], [key, "width", "height"])

    return photos.select(key, data).mapInArrow(run, f"{key} {kind}, width long, height long")


def fit_trees(rows: DataFrame, features: list[str], label: str, *, depth: int = 3, trees: int = 50, rate: float = 0.1, seed: int = 42):
    """A boosted-tree model of a 0/1 label by Spark's own learner; null features count as their column's -1.

    The model's ``transform`` adds a probability; ``scored`` gives it as a column.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="_features"), GBTClassifier(featuresCol="_features", labelCol=label, maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed)]
    return Pipeline(stages=steps).fit(rows.na.fill(-1.0, features))


def scored(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with model_p, the chance of label 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.na.fill(-1.0, features))
    return out.withColumn("model_p", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def occlusion(model, rows: DataFrame, key: str, features: list[str], baseline: dict[str, float]) -> DataFrame:
    """(key, feature, contribution): how a row's chance falls when a feature takes its baseline value: what
    ``evaluation.attributions`` ranks. One pass per feature over the model, all in one plan."""
    whole = scored(model, rows, features).select(key, F.col("model_p").alias("_p"))
    each = rows.select(key, *features, F.explode(F.array(*map(F.lit, features))).alias("feature"))
    each = each.select(key, "feature", *[F.when(F.col("feature") == f, F.lit(float(baseline[f]))).otherwise(F.col(f).cast("double")).alias(f) for f in features])
    told = scored(model, each, features).select(key, "feature", "model_p")
    return told.join(whole, key).select(key, "feature", (F.col("_p") - F.col("model_p")).alias("contribution"))
