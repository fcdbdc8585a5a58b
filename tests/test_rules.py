"""Rules on tiny inputs: grids at all latitudes, gaps in series, chains, projections, ids, streams."""

import base64
import datetime
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from slopeline.operators import channels as H
from slopeline.operators import decisions as D
from slopeline.operators import graph as G
from slopeline.operators import joins as J
from slopeline.operators import state as S
from slopeline.operators import windows as W
from slopeline.sources import feeds as X
from slopeline.streaming import processors as P


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_pairs_within_a_distance_anywhere_on_earth(spark):
    rng = random.Random(1)
    left = [(i, lat + rng.uniform(-0.2, 0.2), ((lon + rng.uniform(-0.4, 0.4) + 180) % 360) - 180) for i, (lat, lon) in enumerate([(0, 0), (59, 179.9), (-71, -179.9), (84, 10), (89.7, 50), (89.7, -130), (-89.8, 0)] * 12)]
    right = [(i, lat, lon) for i, lat, lon in left[::2]]
    a = spark.createDataFrame(left, "id long, lat double, lon double")
    b = spark.createDataFrame(right, "r_id long, r_lat double, r_lon double")
    got = sorted((r.id, r.r_id) for r in J.within_km(a, b, 25.0).collect())
    assert got == sorted((i, j) for i, *p in left for j, *q in right if km(p, q) <= 25.0) and len(got) > 200


def test_nearest_goes_on_until_it_finds(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(40)] + [(99, 70.0, -40.0), (98, 3.0, 3.0)]
    sites = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(15)] + [(50, 60.0, -40.0)]
    p, s = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(sites, "site long, s_lon double, s_lat double")
    got = {r.id: r.site for r in J.nearest(p, s, key="id", site="site", cell=0.01).collect()}
    assert got == {i: min(sites, key=lambda q: (math.hypot(q[1] - x, q[2] - y), q[0]))[0] for i, x, y in points}
    assert J.nearest(p, s.limit(0), key="id", site="site", cell=0.01).count() == 0


def test_rolling_sums_see_hours_without_rain(spark):
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 0), 10.0), ("a", datetime.datetime(2024, 1, 3, 0), 1.0), ("a", datetime.datetime(2024, 1, 3, 5), 2.0)], "k string, hour timestamp_ntz, mm double")
    got = [r.r6 for r in W.rolling(rows, "k", "hour", "mm", {"r6": 6}).orderBy("hour").collect()]
    assert got == [10.0, 1.0, 3.0]


def test_chain_shows_what_was_tampered_with(spark):
    rows = spark.createDataFrame([("a", i, "k", f"p{i}") for i in range(6)], "alert string, event_id long, kind string, payload string")
    chain = S.hash_chain(rows, "alert", "event_id")
    assert S.verify_chain(chain, "alert").where("NOT ok").count() == 0
    forged = chain.withColumn("input_hash", F.when(F.col("seq") == 2, F.sha2(F.lit("other"), 256)).otherwise(F.col("input_hash")))
    assert [r.seq for r in S.verify_chain(forged, "alert").where("NOT ok").collect()] == [2]
    dropped = chain.where("seq <> 3")
    assert [r.seq for r in S.verify_chain(dropped, "alert").where("NOT ok").collect()] == [4]


def test_superseding_claims_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [("k", datetime.datetime(2024, 1, 1, rng.randrange(6)), i, rng.randrange(4) / 4, rng.random() < 0.15) for i in range(60)]
    got = {r.event_id: r.superseded_by for r in S.superseding(spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long, confidence double, authority boolean"), "k").collect()}
    want = {}
    for _, t, i, c, _ in rows:
        later = [(u, j) for _, u, j, d, auth in rows if u > t and (auth or d >= c)]
        if later:
            want[i] = min(later)[1]
    assert got == want


def test_utm_round_trip(spark):
    """Forward by the opposite series, back by the operator."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    rows = []
    for lat, lon in [(0.0, 93.0), (23.73, 92.72), (23.73, 95.9), (61.2, 90.1), (1.5, 93.5)]:
        p, d = math.radians(lat), math.radians(lon - 93)
        t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
        xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
        x = 500000 + 0.9996 * a * (eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)))
        y = 0.9996 * a * (xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)))
        rows.append((lat, lon, x, y))
    lon, lat = X.utm_to_lonlat(F.col("x"), F.col("y"), 46)
    for r in spark.createDataFrame(rows, "lat double, lon double, x double, y double").select("lat", "lon", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lat - r.lat2) < 1e-7 and abs(r.lon - r.lon2) < 1e-7


def test_plan_ids_are_name_based_uuids(spark):
    rows = [("2026-01-01T00:00:00+00:00", '{"a":1}'), ("x", "y"), ("2026-01-02T00:00:00+00:00", '{"name":"München"}')]
    got = [r.id for r in spark.createDataFrame(rows, "t string, body string").select(D.saved_plan_id(F.col("t"), F.col("body")).alias("id")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{t}:{b}")) for t, b in rows]


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'quoted "text", with comma'), ("2", "two\nlines"), ("3", None)]
    X.write_csv(spark.createDataFrame(rows, "objectid string, event_title string"), f"{tmp_path}/events")
    assert sorted(map(tuple, X.read_csv(spark, f"{tmp_path}/events").collect())) == rows


def test_envelopes_and_districts(spark):
    def read(payload):
        return spark.createDataFrame([(payload,)], "p string").select(X.feed_records(F.col("p")).alias("r")).first().r

    assert len(read('[{"District":"A"},{"District":"B"}]')) == 2 and len(read('{"data":[{"x":1}]}')) == 1 and len(read('{"data":{"x":1}}')) == 1 and len(read('{"Station":"A"}')) == 1
    for wrong in ('{"data":5}', '{"other":1}', "7", '"text"'):
        with pytest.raises(Exception, match="envelope"):
            read(wrong)
    rows = spark.createDataFrame([(['{"District":"B","w":1}', '{"District":" a ","w":2}', '{"District":"A"}'],)], "r array<string>")
    found = X.district_record(F.col("r"), "District", F.lit("A "), ("District", "w"))
    assert rows.select(found.alias("x")).first().x == '{"District":" a ","w":2}'
    with pytest.raises(Exception, match="lacks"):
        rows.select(X.district_record(F.col("r"), "District", F.lit("A"), ("District", "z")).alias("x")).collect()


def test_grid_tiles_and_safe_numbers(spark):
    grid = X.make_grid(spark, "a", (0.0, 0.0, 1200.0, 600.0))
    assert [r.cell_id for r in grid.orderBy("cell_id").collect()] == ["a_000_000", "a_000_001", "a_000_002", "a_001_000", "a_001_001", "a_001_002"]
    tiles = X.map_tiles(spark, (0.0, 0.0, 3.0, 3.0))
    area = F.sum((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    assert tiles.count() == 9 and X.split_tiles(tiles).count() == 36 and abs(X.split_tiles(tiles).agg(area).first()[0] - 9.0) < 1e-9
    got = spark.createDataFrame([("1,234",), (" 7 ",), ("many",), (None,)], "t string").select(X.safe_int(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1234, 7, None, None]


def test_scenario_clock_never_goes_back(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(at(1), 60.0), (at(1), -5.0), (at(9), 3600.0), (at(0), 0.0)]
    d = spark.createDataFrame(rows, "now timestamp, s double")
    got = [r.t for r in d.select(D.scenario_clock(F.col("now"), F.lit(at(1)), F.lit(at(10)), F.col("s"), 60.0).alias("t")).collect()]
    assert got == [at(2), at(1), at(10), at(1)]


def test_rules_as_sql_functions(spark):
    assert set(D.register_functions(spark)) == {"id_threshold", "ed_threshold", "risk_stage", "fuse_risk"}
    r = spark.sql("SELECT id_threshold(1D) AS a, ed_threshold(72D) AS b, risk_stage(0.6D) AS c, fuse_risk(0.2D, 3D) AS d").first()
    assert (r.a, round(r.b, 6), r.c, r.d) == (5.8294, 33.54, "ORANGE", 1.0)


def test_routes_avoid_water(spark):
    nodes = spark.createDataFrame([(1, 0.0, 2.0, True), (2, 0.9, 2.0, True), (3, 0.0, 2.0, True), (4, 0.0, 36.0, True), (5, 0.0, 2.0, False)], "node long, depth double, slope double, passable boolean")
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 4, 10.0), (1, 3, 20.0), (3, 4, 20.0), (3, 5, 1.0), (5, 4, 1.0)], "src long, dst long, base_s double").withColumns({"depth": F.lit(0.0), "passable": F.lit(True)})
    pairs = spark.createDataFrame([(1, 4), (4, 1), (7, 1)], "source long, target long")
    got = {(r.source, r.target): r for r in G.budgeted_routes(pairs, nodes, edges).collect()}
    assert got[1, 4].path == [1, 3, 4] and got[1, 4].eta_s == 20 + 20 * 3.5 and got[1, 4].avoided == [2, 5]
    assert not got[4, 1].reachable and not got[7, 1].reachable


def test_channels_draw_as_seeded(spark):
    rng = random.Random(H.seed_of("a1", "sms"))
    want = [0, 0, 0.0]
    for _ in range(50):
        got = rng.random() < 0.90
        seen = got and rng.random() < 0.40
        late = rng.uniform(5.0, 120.0)
        want = [want[0] + got, want[1] + seen, max(want[2], late)]
    rows = {r.channel: r for r in H.channel_results(spark.createDataFrame([("a1", 50), ("a2", 0), (None, 5)], "alert_id string, recipients long")).where("alert_id = 'a1'").collect()}
    assert (rows["sms"].delivered, rows["sms"].acknowledged, rows["sms"].longest_s) == tuple(want) and len(rows) == 4


def test_photos(spark):
    jpeg = b"\xff\xd8\xff\xe0" + (16).to_bytes(2, "big") + bytes(14) + b"\xff\xc4" + (5).to_bytes(2, "big") + bytes(3) + b"\xff\xff\xc2" + (11).to_bytes(2, "big") + b"\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + bytes(9)
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    url = lambda kind, data: f"data:image/{kind};base64," + base64.b64encode(data).decode()
    rows = [(1, url("jpeg", jpeg)), (2, url("webp", webp)), (3, url("png", jpeg)), (4, "http://x"), (5, "data:image/png;base64,%%%"), (6, None)]
    parts = H.photo(F.col("u"))
    found = spark.createDataFrame(rows, "id long, u string").select("id", *[c.alias(k) for k, c in parts.items()])
    got = {r.id: (r.mime, r.width, r.height) for r in found.collect()}
    assert got == {1: ("image/jpeg", None, None), 2: ("image/webp", 800, 600), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}
    sides = {r.id: (r.width, r.height) for r in H.jpeg_sides(found, "id").collect()}
    assert sides[1] == (640, 480) and sides[6] == (None, None)


def test_boosted_trees_learn_and_explain(spark):
    rng = random.Random(9)
    rows = [(i, a, b, int(a > 0.5)) for i in range(200) for a, b in [(rng.random(), rng.random() if i % 5 else None)]]
    d = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = H.fit_trees(d, ["a", "b"], "y", trees=3)
    got = H.scored(model, d, ["a", "b"]).collect()
    assert all((r.model_p > 0.5) == (r.a > 0.5) for r in got)
    part = {(r.id, r.feature): r.contribution for r in H.occlusion(model, d, "id", ["a", "b"], {"a": 0.0, "b": 0.0}).collect()}
    assert all(part[i, "a"] > 0.2 for i, a, _, _ in rows if a > 0.6) and all(abs(part[i, "b"]) < 0.2 for i, a, _, _ in rows if abs(a - 0.5) > 0.1)


def test_stub_feed_and_factory(spark):
    live = P.source(spark, "LIVE")
    assert live.isStreaming and set(live.columns) >= {"t", "aoi_id", "cell_id", "rain_1h", "source"}
    with pytest.raises(ValueError):
        P.source(spark, "REPLAY")


def test_claims_as_a_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("p", 1, at(0), 0.2, False, 0, True), ("p", 2, at(1), 0.9, False, 3, True), ("p", 3, at(2), 0.9, True, 3, True), ("p", 4, at(3), 0.3, False, 0, True), ("q", 5, at(0), 0.6, False, 1, True)]
    names = "place string, report_id long, ts timestamp, depth double, authority boolean, lower long, dry boolean"
    for i in (0, 1):
        spark.createDataFrame(rows[i::2], names).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(names).parquet(f"{tmp_path}/in/part=*")
    got = {r.report_id: (r.state, r.supersedes) for r in P.drain(P.claim_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got == {1: ("PENDING", None), 2: ("REJECTED", None), 3: ("VERIFIED", 1), 4: ("PENDING", None), 5: ("PENDING", None)}
