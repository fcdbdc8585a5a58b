"""Path attribution against enumeration over all subsets of features."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from slopeline.operators import attribution as AT
from slopeline.operators import channels as H
from slopeline.plans import models as M

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def trained(spark):
    rows = spark.range(300).select("id", (F.col("id") * 37 % 101).cast("double").alias("a"), F.when(F.col("id") % 9 != 0, F.col("id") * 53 % 89).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("c"))
    rows = rows.withColumn("y", ((F.col("a") > 40) & (F.coalesce("b", F.lit(0)) < 50) | (F.col("c") > 5)).cast("int")).cache()
    return rows, H.fit_trees(rows, FEATURES, "y", depth=3, trees=4)


def expected(nodes, at, x, known):
    """A tree's value where features outside ``known`` follow the training rows."""
    n = nodes[at]
    if n.feature is None:
        return n.value * n.weight
    if n.feature in known:
        return expected(nodes, n.left if x[n.feature] <= n.threshold else n.right, x, known)
    return sum(nodes[c].cover / n.cover * expected(nodes, c, x, known) for c in (n.left, n.right))


def test_shapley_values_by_enumeration(spark, trained):
    rows, model = trained
    trees = {}
    for n in AT.tree_nodes(model).collect():
        trees.setdefault(n.tree, {})[n.node] = n
    got = {r.id: r for r in AT.shapley(model, rows, "id", FEATURES).collect()}
    assert len(got) == 300 and len(trees) == 4
    for r in rows.where("id % 23 = 0").collect():
        x = [-1.0 if v is None else v for v in (r.a, r.b, r.c)]
        game = lambda s: sum(expected(t, 0, x, s) for t in trees.values())  # noqa: B023, E731
        for i, name in enumerate(FEATURES):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (game({*s, i}) - game(set(s))) for k in range(3) for s in itertools.combinations(rest, k))
            assert got[r.id][name] == pytest.approx(want, abs=1e-9)
        assert got[r.id].base == pytest.approx(game(set()), abs=1e-9) and got[r.id].margin == pytest.approx(game({0, 1, 2}), abs=1e-9)


def test_margin_is_the_model_s(spark, trained):
    rows, model = trained
    told = AT.shapley(model, rows, "id", FEATURES).withColumn("p", 1 / (1 + F.exp(-2 * F.col("margin")))).select("id", "p")
    wrong = told.join(H.scored(model, rows, FEATURES).select("id", "model_p"), "id").where("abs(p - model_p) > 1e-9")
    assert wrong.isEmpty()
    assert AT.shapley(model, rows.where("id < 0"), "id", FEATURES).isEmpty()


def test_model_of_one_leaf(spark):
    rows = spark.range(20).select("id", F.lit(1.0).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    got = AT.shapley(H.fit_trees(rows, ["a"], "y", trees=2), rows, "id", ["a"]).collect()
    assert all(r.a == 0 and r.margin == r.base for r in got)


def test_model_query(spark):
    sf = "/root/testdata/sf0.001"
    got = M.model_attributions(spark, sf).collect()
    assert len({r.cell_id for r in got}) == spark.read.parquet(f"{sf}/part.parquet").count() and len(got) == 4 * len({r.cell_id for r in got})
    assert all(0 <= r.p <= 1 for r in got) and any(r.contribution for r in got)
