"""Trained models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import channels as H
from ..operators import evaluation as E
from ..session import cut
from ..sources import tables as T

_FEATURES = ["elevation", "slope", "aspect", "relief", "load", "visits"]
_GROUPS = {"height": ["elevation"], "shape": ["slope", "aspect", "relief"], "load": ["load"], "traffic": ["visits"]}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells with their terrain and their order lines; a cell has failed where more lines than
    usual came back."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.avg("l_quantity").alias("load"), F.count(F.lit(1)).alias("visits"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("back"))
    cells = T.terrain(spark, sf_dir).select("cell_id", "elevation", "slope", "aspect", "relief").join(lines, "cell_id", "left")
    return cells.withColumn("failed", (F.coalesce("back", F.lit(0.0)) > 0.25).cast("int"))


def model_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees trained on all cells, and for every cell the groups of features that weigh most in its
    margin by exact path attribution, with the chance that the margin stands for."""
    cells = cut(_cells(spark, sf_dir))
    model = H.fit_trees(cells, _FEATURES, "failed", trees=10)
    told = cut(AT.shapley(model, cells, "cell_id", _FEATURES))
    ranked = E.attributions(told, "cell_id", _GROUPS)
    chance = told.select("cell_id", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("p"), "base")
    return ranked.join(chance, "cell_id").select("cell_id", "rank", "grp", F.round("contribution", 6).alias("contribution"), F.round("pct", 4).alias("pct"), F.round("p", 6).alias("p"), F.round("base", 6).alias("base"))


QUERIES = {"model_attributions": model_attributions}
ORACLES: dict[str, str] = {}
