"""Exact path attribution of boosted trees: the Shapley values of a row's margin.

A model is taken apart into a table of nodes, and that into a table of leaf paths: for each leaf the
distinct features on its path, with the interval each must lie in and the share of training rows
that pass where the feature is not known. For one leaf the game is a product over its features: one
factor for each, 1 or 0 where the feature is known, the share where it is not. The Shapley value of a
product is a sum over sizes of subsets, whose terms are the coefficients of a polynomial in one
variable, so no subset is enumerated and the values are exact. All rows of a batch are worked on
side by side; what is sent to the tasks is bounded by the model (trees * leaves).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Leaves of a model whose paths are sent to the tasks.
MOST_PATHS = 100_000


def tree_nodes(model) -> DataFrame:
    """(tree, weight, node, left, right, feature, threshold, value, cover) of a boosted-tree model or of a
    pipeline that ends in one. Leaves have no feature; a row goes left where feature <= threshold.
    The nodes are those of the model's own saved form."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    trees = model.stages[-1] if hasattr(model, "stages") else model
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    weight = F.element_at(F.array(*map(F.lit, trees.treeWeights)), F.col("treeID").cast("int") + 1)
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    split = n["split"]
    return nodes.select(
        F.col("treeID").cast("int").alias("tree"), weight.alias("weight"), n["id"].alias("node"), F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        F.when(inner, split["featureIndex"]).alias("feature"), F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"),
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, steps): every leaf, its value times its tree's weight, and for each distinct
    feature of its path a struct (feature, low, high, share): low < x <= high passes. One join a level."""
    steps = F.array().cast("array<struct<feature:int,low:double,high:double,share:double>>")
    whole = nodes.where("node = 0").select("tree", "weight", "node", "left", "right", "feature", "threshold", "value", "cover", steps.alias("steps"))
    below = nodes.select("tree", F.col("node").alias("c_node"), *[F.col(c).alias("c_" + c) for c in ("left", "right", "feature", "threshold", "value", "cover")])
    found = None
    at = whole
    while True:
        leaves = at.where("feature IS NULL").select("tree", F.col("node").alias("leaf"), (F.col("value") * F.col("weight")).alias("value"), "steps")
        found = leaves if found is None else found.unionByName(leaves)
        inner = at.where("feature IS NOT NULL")
        if inner.isEmpty():
            return found
        step = lambda side: F.struct(
            F.col("feature"), F.when(F.lit(side == "right"), F.col("threshold")).otherwise(float("-inf")).alias("low"), F.when(F.lit(side == "left"), F.col("threshold")).otherwise(float("inf")).alias("high")
        )
        sides = inner.withColumn("s", F.explode(F.array(*[F.struct(F.col(side).alias("c_node"), step(side).alias("step")) for side in ("left", "right")]))).withColumn("c_node", F.col("s.c_node"))
        both = sides.join(below, ["tree", "c_node"])
        mine = F.get(F.filter("steps", lambda x: x["feature"] == F.col("feature")), F.lit(0))
        new = F.struct(
            F.col("feature"), F.greatest(F.col("s.step.low"), F.coalesce(mine["low"], F.lit(float("-inf")))).alias("low"), F.least(F.col("s.step.high"), F.coalesce(mine["high"], F.lit(float("inf")))).alias("high"),
            (F.coalesce(mine["share"], F.lit(1.0)) * F.col("c_cover") / F.col("cover")).alias("share"),
        )
        grown = F.concat(F.filter("steps", lambda x: x["feature"] != F.col("feature")), F.array(new))
        # In a step of its own: the names below are given anew.
        both = both.withColumn("steps", grown)
        at = both.select("tree", "weight", F.col("c_node").alias("node"), *[F.col("c_" + c).alias(c) for c in ("left", "right", "feature", "threshold", "value", "cover")], "steps")


def _shapley(x: np.ndarray, paths: list[tuple[float, list[tuple[int, float, float, float]]]]) -> tuple[np.ndarray, float]:
    """(values by row and feature, the margin that no feature explains)."""
    out, base = np.zeros(x.shape), 0.0
    for value, steps in paths:
        m = len(steps)
        known = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in steps]
        share = [s for _, _, _, s in steps]
        base += value * float(np.prod(share))
        weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for i, (feature, _, _, _) in enumerate(steps):
            terms = [np.ones(len(x))]  # by the number of known features: the product of (share + known * t) over the others
            for j in range(m):
                if j != i:
                    terms = [(terms[k] * share[j] if k < len(terms) else 0.0) + (terms[k - 1] * known[j] if k else 0.0) for k in range(len(terms) + 1)]
            out[:, feature] += value * (known[i] - share[i]) * sum(w * t for w, t in zip(weight, terms))
    return out, base


def shapley(model, rows: DataFrame, key: str, features: list[str], missing: float = -1.0) -> DataFrame:
    """(key, base, margin, a column for each feature): what each feature adds to the margin of a row.

    base + the sum of all features = margin, the model's raw sum of trees; null features count as
    ``missing``, as in training. The values are those of the game in which an unknown feature follows
    the training rows down both branches.
    """
    found = leaf_paths(tree_nodes(model)).limit(MOST_PATHS + 1).collect()
    if len(found) > MOST_PATHS:
        raise ValueError(f"the model has more than {MOST_PATHS} leaves")
    sent = rows.sparkSession.sparkContext.broadcast([(r["value"], [tuple(s) for s in r["steps"]]) for r in found])
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if batch.num_rows else np.zeros((0, len(features)))
            values, base = _shapley(x, sent.value)
            parts = [pa.array(values[:, i]) for i in range(len(features))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), pa.array(base + values.sum(1)), *parts], [key, "base", "margin", *features])

    given = rows.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(missing)).alias(f) for f in features])
    return given.mapInArrow(run, f"{key} {kind}, base double, margin double, " + ", ".join(f"`{f}` double" for f in features))
