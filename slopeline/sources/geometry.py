"""Layers of geometries in parquet files: cells, points and roads as well-known binary, read and written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wkb as W


def layer(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """A layer with what its geometries say: ``kind`` (1 point, 2 line, 3 polygon), ``x`` and ``y`` (a point's place, a
    line's first point, a polygon's centroid), ``area`` and ``length``, null where they do not apply.

    Other columns stay; rows without a geometry have nulls.
    """
    rows = spark.read.parquet(path)
    data = F.col(geometry)
    rows = rows.withColumns({"kind": W.kind(data), "_p": W.point(data), "_l": W.line(data), "_a": W.area_and_centroid(W.rings(data))})
    first = F.get("_l", F.lit(0))
    place = lambda c: F.coalesce(F.col("_p")[c], first[c], F.col("_a")[c])
    return rows.withColumns({"x": place("x"), "y": place("y"), "area": F.col("_a.area"), "length": W.length(F.col("_l"))}).drop("_p", "_l", "_a")


def road_segments(spark: SparkSession, path: str, key: str, geometry: str = "geometry") -> DataFrame:
    """(key, part, ux, uy, vx, vy): the straight parts of each line of a layer, in order from 0."""
    points = W.line(F.col(geometry))
    pairs = F.zip_with(F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda p, q: F.struct(p["x"].alias("ux"), p["y"].alias("uy"), q["x"].alias("vx"), q["y"].alias("vy")))
    return spark.read.parquet(path).select(key, points.alias("_l")).select(key, F.posexplode(pairs).alias("part", "s")).select(key, "part", "s.*")


def encoded(rows: DataFrame, points: Column, kind: int) -> DataFrame:
    """``rows`` with ``geometry``: a point, line or polygon of one ring from an array of structs (x, y)."""
    names = rows.columns
    packed = rows.select(*names, F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("_xy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xy in batch.column(len(names)).to_numpy(zero_copy_only=False):
                if xy is None:
                    out.append(None)
                    continue
                n = np.array([len(xy) // 2], "<u4").tobytes()
                head = {W.POINT: b"", W.LINE: n, W.POLYGON: np.array([1], "<u4").tobytes() + n}[kind]
                out.append(b"\x01" + np.array([kind], "<u4").tobytes() + head + np.asarray(xy, "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.binary())], [*names, "geometry"])

    return packed.mapInArrow(run, rows.schema.add("geometry", "binary"))
