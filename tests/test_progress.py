"""Progress of a replay in hundredths: halves go up on both sides."""

import datetime

import pytest

from slopeline.plans import tick


def test_replay_progress_rounds_halves_up(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    day = datetime.datetime(1996, 1, 1)
    width = [40, 80, 8, 89, 3, 0, 40]
    days = [23, 46, 1, 44, 5, 2, -4]
    orders = [(i, day) for i in range(len(width))]
    lines = [(i, w, day + datetime.timedelta(days=d)) for i, (w, d) in enumerate(zip(width, days))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(0.58, 2), (0.13, 1), (0.49, 1), (1.0, 1), (None, 1), (0.0, 1)}
    assert {tuple(r) for r in tick.replay_progress(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert set(con.execute(tick.ORACLES["replay_progress"]).fetchall()) == want
