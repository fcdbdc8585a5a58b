"""File sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from slopeline.sources import files as S


@pytest.fixture
def scenario(tmp_path):
    base = {k: 1.0 for k in S.REQUIRED}
    good = {
        "id": "good", "aoi_id": "a", "held_out_of_training": False, "provenance": {"confidence": "synthetic", "method": "m", "sources": [], "disclaimer": ""},
        "clock": {"start": "2026-05-27T00:00:00+05:30", "end": "2026-05-27T01:00:00+05:30", "frame_interval_minutes": 60, "default_speed_factor": 1.0},
        "frames": [
            {"t": "2026-05-27T00:00:00+05:30", "defaults": base, "cells": [{"cell_id": "c1", "rain_1h": 2.5}, {"cell_id": "c2", "rain_6h": None}]},
            {"t": "2026-05-27T01:00:00+05:30", "defaults": {}, "cells": [{"cell_id": "c1", **base}]},
        ],
    }
    bad = good | {"id": "bad", "held_out_of_training": True, "frames": good["frames"][::-1]}
    for s in (good, bad):
        (tmp_path / f"{s['id']}.json").write_text(json.dumps(s))
    return str(tmp_path)


def test_scenarios(spark, scenario):
    found = S.scenarios(spark, scenario + "/*.json")
    assert {r.id: r.frame_count for r in S.catalogue(found).collect()} == {"good": 2, "bad": 2}
    rows = S.observations(found.where("id = 'good'")).orderBy("t", "cell_id").collect()
    assert [(r.cell_id, r.rain_1h, r.rain_6h, r.missing) for r in rows] == [("c1", 2.5, 1.0, []), ("c2", 1.0, None, ["rain_6h"]), ("c1", 1.0, 1.0, [])]
    broken = {(r.id, r.rule) for r in S.violations(found).collect()}
    assert broken == {("bad", "held out without reconstructed sources"), ("bad", "frames out of order"), ("bad", "held out without metadata")}
    frames = found.where("id = 'good'").select(F.explode("frames").alias("f")).select("f.t")
    assert S.seek(frames, "2026-05-26 19:00:00").count() == 1 and S.seek(frames, "2030-01-01 00:00:00").count() == 1 and S.seek(frames, "2020-01-01 00:00:00").count() == 2


def test_bundle_and_sinks(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"Hospital": [{"id": "h1", "aoi_id": "x", "beds": 3}], "Junction": [{"osmid": "j1"}]}))
    (tmp_path / "e.json").write_text(json.dumps({"POWERS": [{"edge_id": "e1", "src_id": "j1", "dst_id": "h1"}], "CONNECTS": [{"edge_id": "e2", "u_id": "j1", "v_id": "h1"}]}))
    n, e = S.graph_bundle(spark, f"{tmp_path}/n.json", f"{tmp_path}/e.json")
    assert {(r.id, r.label, r.aoi_id) for r in n.collect()} == {("h1", "Hospital", "x"), ("j1", "Junction", None)}
    assert {(r.edge_id, r.src_id, r.dst_id) for r in e.collect()} == {("e1", "j1", "h1"), ("e2", "j1", "h1")}
    line = S.geojson(spark.sql("SELECT 'r1' AS edge_id, array(array(1.0D, 2.0D), array(3.0D, 4.0D)) AS xy"), "xy").first().value
    assert json.loads(line)["geometry"]["coordinates"] == [[1.0, 2.0], [3.0, 4.0]] and json.loads(line)["properties"] == {"edge_id": "r1"}
    path = f"{tmp_path}/t"
    S.replace_partition(spark.createDataFrame([("a", 1), ("b", 2)], "aoi_id string, v int"), path)
    S.replace_partition(spark.createDataFrame([("a", 9)], "aoi_id string, v int"), path)
    assert {(r.aoi_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}
    S.append_series(spark.sql("SELECT timestamp '2024-01-01 05:00:00' AS ts, 1.0D AS mm"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1
