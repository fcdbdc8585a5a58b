"""Functions for SQL: a table function that folds each partition to states, an aggregate that merges them.

A trend is a straight line through points (x, y) of a key. Its state is (n, mean of x, mean of y, sum of squares
of x, of products, of squares of y, each about the means): six numbers that merge in any order. So no key's points
ever meet in one task: ``trend_states`` keeps one state per key of what a partition holds, only states are
shuffled, and ``trend_merge`` joins those of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, arrow_udtf

_STATE = pa.list_(pa.float64())

#: Keys whose states a task holds before it hands them on.
_HELD = 200_000


def merged(which: np.ndarray, states: np.ndarray, size: int) -> np.ndarray:
    """One state (row of six) per number below ``size``: those of ``states`` whose ``which`` is that number.

    Means are taken as distances from one of them, so equal values have a spread of exactly zero.
    """
    out = np.zeros((size, 6))
    some = states[:, 0] > 0
    which, states = which[some], states[some]
    n = out[:, 0] = np.bincount(which, states[:, 0], size)
    base = np.zeros((size, 2))
    base[which[::-1]] = states[::-1, 1:3]
    off = states[:, 1:3] - base[which]
    mean = np.stack([np.bincount(which, states[:, 0] * off[:, i], size) / np.maximum(n, 1) for i in (0, 1)], axis=1)
    out[:, 1:3] = base + mean
    dx, dy = (off - mean[which]).T
    for i, extra in ((3, dx * dx), (4, dx * dy), (5, dy * dy)):
        out[:, i] = np.bincount(which, states[:, i] + states[:, 0] * extra, size)
    return out


@arrow_udtf(returnType=T.StructType([T.StructField("key", T.StringType()), T.StructField("state", T.ArrayType(T.DoubleType()))]))
class TrendStates:
    """Rows (key string, x double, y double) to (key, state), one row per key and task (more beyond 200 000 keys).

    Points without x or y don't count; their key is told all the same. A null key is a key.
    """

    def __init__(self):
        self.place: dict[str | None, int] = {}
        self.state = np.zeros((0, 6))

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        codes = rows.column(0).cast(pa.string()).dictionary_encode(null_encoding="encode")
        x, y = (rows.column(i).cast(pa.float64()) for i in (1, 2))
        known = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
        points = np.zeros((len(codes), 6))
        points[:, 0] = known
        points[:, 1] = x.fill_null(0.0)
        points[:, 2] = y.fill_null(0.0)
        at = np.array([self.place.setdefault(k, len(self.place)) for k in codes.dictionary.to_pylist()], np.int64)
        which = np.concatenate([np.arange(len(self.state)), at[codes.indices.to_numpy()]])
        self.state = merged(which, np.concatenate([self.state, points]), len(self.place))
        if len(self.place) > _HELD:
            yield from self.terminate()
            self.place, self.state = {}, np.zeros((0, 6))

    def terminate(self) -> Iterator[pa.Table]:
        if self.place:
            yield pa.table({"key": pa.array(list(self.place), pa.string()), "state": pa.array(list(self.state), _STATE)})


@arrow_udf(T.ArrayType(T.DoubleType()))
def trend_merge(states: pa.Array) -> pa.Scalar:
    states = states.drop_null()
    rows = states.flatten().to_numpy(zero_copy_only=False).reshape(len(states), 6)
    return pa.scalar(merged(np.zeros(len(rows), np.int64), rows, 1)[0].tolist(), _STATE)


#: What can be asked of a state.
_TOLD = {
    "trend_count": ("BIGINT", "CAST(s[0] AS BIGINT)"),
    "trend_slope": ("DOUBLE", "CASE WHEN s[0] > 0 AND s[3] > 0 THEN s[4] / s[3] END"),
    "trend_intercept": ("DOUBLE", "CASE WHEN s[0] > 0 AND s[3] > 0 THEN s[2] - s[4] / s[3] * s[1] END"),
    "trend_fit": ("DOUBLE", "CASE WHEN s[0] > 0 AND s[3] > 0 THEN CASE WHEN s[5] > 0 THEN s[4] * s[4] / (s[3] * s[5]) ELSE 1D END END"),
}


def register_trends(spark: SparkSession) -> list[str]:
    """Make ``trend_states(TABLE(...))``, ``trend_merge(state)`` and what is told of a state available to SQL.

    ``SELECT key, trend_slope(trend_merge(state)) FROM trend_states(TABLE(points)) GROUP BY key``. Null where a line
    isn't determined (no points, or one x for all).
    """
    spark.udtf.register("trend_states", TrendStates)
    spark.udf.register("trend_merge", trend_merge)
    for name, (kind, body) in _TOLD.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s ARRAY<DOUBLE>) RETURNS {kind} RETURN {body}")
    return ["trend_states", "trend_merge", *_TOLD]
