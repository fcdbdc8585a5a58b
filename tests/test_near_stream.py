"""Near duplicates as they come, against every pair."""

import datetime
import random
import time

from slopeline.streaming import processors as P

T0 = datetime.datetime(2024, 1, 1)


class State:
    """What Spark would hold for one key."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def handler(monkeypatch, spark):
    """The function that works on one key."""
    found = []
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, f, *rest: found.append(f))
    P.near_duplicates(spark.createDataFrame([], "id long, category string, status string, t timestamp, lat double, lon double"))
    return found[0]


def frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["id", "at", "lat", "lon", "opened", "own"])


def test_batches_out_of_order_equal_every_pair(spark, monkeypatch):
    hour, run = 3_600_000_000, handler(monkeypatch, spark)
    rnd = random.Random(2)
    spots = [(10.0, 20.0), (10.001, 20.0), (10.0025, 20.0)]
    rows = [(i, rnd.randrange(120) * hour, *rnd.choice(spots), rnd.random() < 0.7, rnd.random() < 0.6) for i in rnd.sample(range(1000), 300)]
    batches = [rows[:100], [r for r in rows[100:] if r[1] > 50 * hour], [r for r in rows[100:] if r[1] <= 50 * hour]]
    state, got, want, held = State(), [], [], []
    for batch in batches:
        got += [tuple(r) for out in run(("a", 0, 0), iter([frame(batch)]), state) for r in out.itertuples(index=False)]
        for id, at, lat, lon, opened, own in sorted(batch, key=lambda r: (r[1], r[0])):
            near = [(P._km(lat, lon, *p), i) for t, i, p in held if at - 72 * hour <= t and (t, i) < (at, id) and P._km(lat, lon, *p) <= 0.25]
            if own and near:
                want.append((id, min(near)[1], min(near)[0]))
            if opened:
                held.append((at, id, (lat, lon)))
        last = max(r[1] for r in batch)
        held = [h for h in held if h[0] >= last - 72 * hour]
    assert sorted(got) == sorted(want) and want


def test_crowded_place_takes_no_scan_of_what_is_held(spark, monkeypatch):
    run = handler(monkeypatch, spark)
    rows = [(i, i * 1_000_000, 10.0, 20.0, True, True) for i in range(40_000)]  # all within the hours
    begin = time.time()
    out = next(run(("a", 0, 0), iter([frame(rows)]), State()))
    assert len(out) == 39_999 and set(out["duplicate_of"]) == {0}
    assert time.time() - begin < 20
