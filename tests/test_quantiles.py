"""Exact quantiles by refinement against numpy."""

import random

import numpy as np
import pytest

from slopeline.operators import evaluation as E


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "one", "wide"])
def test_quantiles(spark, kind):
    rng = random.Random(2)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(3001)], "ties": [float(rng.randrange(4)) for _ in range(500)], "skewed": [1e-9 * rng.random() for _ in range(999)] + [1e12],
        "one": [7.5], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0, 1.0],
    }[kind]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    fractions = [0.0, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    got = E.quantiles(rows, "v", fractions)
    if kind == "wide":  # numpy's interpolation overflows
        assert (got[0], got[2], got[-1]) == (-1.7e308, 0.5, 1.7e308)
    else:
        assert got == pytest.approx(np.quantile(values, fractions).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert E.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_stratified_sample_is_exact(spark):
    rows = spark.range(4000).selectExpr("id", "CAST(id % 3 AS INT) AS stratum")
    wanted = spark.createDataFrame([(0, 5), (1, 1000), (2, 5000)], "stratum int, n long")
    import hashlib

    order = sorted(range(4000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    want = {i for s, n in ((0, 5), (1, 1000), (2, 5000)) for i in [i for i in order if i % 3 == s][:n]}
    assert {r.id for r in E.stratified(rows, wanted, "id").collect()} == want
