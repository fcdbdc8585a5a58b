"""The replay source and the streamed tick: controls, seeks, restarts, frames out of order."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from slopeline.operators.state import GENESIS
from slopeline.sources import replay as R
from slopeline.streaming import processors as P
from slopeline.streaming import tick

T0 = datetime.datetime(2024, 1, 1)


def hour(i):
    return T0 + datetime.timedelta(hours=i)


@pytest.fixture
def tape(spark, tmp_path):
    spark.dataSource.register(R.ReplaySource)
    rows = [(i, hour(i // 2)) for i in range(20)]  # ten frames of two rows
    spark.createDataFrame(rows, "id long, t timestamp_ntz").write.parquet(str(tmp_path / "frames"))
    return str(tmp_path / "frames"), str(tmp_path / "control.json"), tmp_path


def played(spark, tape):
    path, control, base = tape
    stream = spark.readStream.format("replay").option("path", path).option("control", control).load()
    out = P.drain(stream, str(base / "table"), str(base / "state"))
    return sorted((r.position, r.id) for r in out.collect())


def test_batch_read_and_seek(spark, tape):
    path = tape[0]
    read = lambda **o: spark.read.format("replay").options(path=path, **o).load()
    assert read().count() == 20 and read().columns == ["position", "id", "t"]
    assert {r.position for r in read(**{"from": "2024-01-01T03:30:00"}).collect()} == {4, 5, 6, 7, 8, 9}
    assert {r.position for r in read(**{"from": "2030-01-01"}).collect()} == {9}  # past the end: the last frame
    assert read(**{"from": "2000-01-01"}).count() == 20


def test_stream_goes_on_after_restarts_and_seeks(spark, tape):
    controls = R.Controls(tape[1], tape[0])
    controls.advance(3)
    want = [(p, 2 * p + j) for p in range(3) for j in (0, 1)]
    assert played(spark, tape) == want
    assert played(spark, tape) == want  # nothing new was released
    controls.seek(hour(1))
    controls.advance(2)
    want += [(3, 2), (3, 3), (4, 4), (4, 5)]
    assert played(spark, tape) == want
    controls.seek(hour(99))
    controls.advance(50)  # only one frame is left
    want += [(5, 18), (5, 19)]
    assert played(spark, tape) == want
    controls.restart()
    controls.advance(1)
    assert played(spark, tape) == [*want, (6, 0), (6, 1)]


def test_clock_of_the_replay(tape, monkeypatch):
    now = [1000.0]
    monkeypatch.setattr(R.time, "time", lambda: now[0])
    controls = R.Controls(tape[1], tape[0])
    released = lambda: R._released(R._state(tape[1]), controls.times)
    controls.set_speed(3600.0)  # an hour of the record a second
    assert released() == 1  # the first frame is due at once
    now[0] += 2.5
    assert released() == 3
    controls.pause()
    now[0] += 100
    assert released() == 3
    controls.resume()
    assert released() == 4
    controls.seek(hour(8))
    assert released() == 5 and R._frame(R._state(tape[1]), 4) == 8
    now[0] += 100
    assert released() == 6  # up to the last frame
    with pytest.raises(ValueError):
        controls.set_speed(0)


def test_frames_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "id long, t timestamp_ntz").write.parquet(str(tmp_path / "none"))
    spark.dataSource.register(R.ReplaySource)
    assert spark.read.format("replay").option("path", str(tmp_path / "none")).load().isEmpty()
    controls = R.Controls(str(tmp_path / "c.json"), str(tmp_path / "none"))
    controls.seek(T0)
    controls.advance(5)
    assert R._released(R._state(str(tmp_path / "c.json")), controls.times) == 0


def test_ticks_out_of_order_are_chained_in_order(spark, tmp_path):
    """Files bring frames out of order within the watermark; the chain follows the time, links hold."""
    schema = "aoi string, t timestamp, cells map<long,struct<p:double,ratio:double>>"
    frame = lambda h, p: ("a", hour(h), {1: (p, p * 2)})
    files = [[frame(0, 0.1), frame(2, 0.9)], [frame(1, 0.3), frame(3, 0.2)], [frame(4, 0.8)], [("z", hour(500), {})]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / f"in/{i}"))
    villages = spark.createDataFrame([("a", 7, 1), ("a", 8, 99)], "aoi string, village_id long, cell_id long")
    with tick.rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withWatermark("t", "10 hours")
        out = P.drain(tick.ticks(stream, villages), str(tmp_path / "table"), str(tmp_path / "state"))
    rows = sorted(out.collect(), key=lambda r: r.seq)
    assert [r.t for r in rows if r.kind == "AI_FLAGGED"] == [hour(i) for i in range(5)]
    # The village's clock does not go back: the frame of hour 1 came behind that of hour 2.
    assert [(r.t, r.payload) for r in rows if r.kind == "ESCALATED"] == [(hour(2), "7:GREEN:RED"), (hour(3), "7:RED:GREEN"), (hour(4), "7:GREEN:RED")]
    last = GENESIS
    for i, r in enumerate(rows):
        digest = hashlib.sha256(r.payload.encode()).hexdigest()
        assert r.seq == i and r.prev_hash == last and r.input_hash == digest
        last = hashlib.sha256(f"{last}:{digest}:{r.event_id}:{r.kind}".encode()).hexdigest()
        assert r.hash == last
    assert [r.n for r in rows if r.kind == "AI_FLAGGED"] == [1, 2, 3, 4, 5]
    assert out.where(F.col("kind") == "AI_FLAGGED").select("slope").first() is not None


def test_villages_of_a_cell_share_its_state(spark, tmp_path):
    """State and rows follow the cells, not the villages: each of 300 villages is told, one state holds them. Villages
    without an observed cell or without any cell stay safe; a cell that is no longer observed goes back."""
    schema = "aoi string, t timestamp, cells map<long,struct<p:double,ratio:double>>"
    rows = [("a", hour(0), {1: (0.9, 1.0), 5: (0.9, 1.0)}), ("a", hour(1), {2: (0.1, 0.1)}), ("z", hour(500), {})]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / f"in/{i}"))
    villages = spark.createDataFrame([("a", v, 1) for v in range(300)] + [("a", 900, 2), ("a", 901, None), ("b", 902, 1)], "aoi string, village_id long, cell_id long")
    found = []
    with tick.rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withWatermark("t", "10 hours")
        query = tick.ticks(stream, villages).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: found.extend(b.collect())).start()
        query.awaitTermination()
    told = sorted((r.t, r.village_id, r.payload) for r in found if r.kind == "ESCALATED")
    assert told == [(hour(0), v, f"{v}:GREEN:RED") for v in range(300)] + [(hour(1), v, f"{v}:RED:GREEN") for v in range(300)]
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < 100


def test_trend_of_points():
    n, x, y, slope, intercept, r2 = tick.fitted([(0, 1.0), (3_600_000, 2.0), (7_200_000, 3.0)])
    assert (n, x, y, slope, intercept, r2) == (3, 2.0, 3.0, 1.0, 1.0, 1.0)
    assert tick.fitted([(5, 4.0)])[3:] == (None, None, 0.0)
