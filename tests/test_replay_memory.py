"""Frames are read in small batches, from the row groups that can hold them."""

import datetime

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq

from slopeline.sources import replay as R

T0 = datetime.datetime(2024, 1, 1)


def write(path, hours, names=("id", "t"), **settings):
    t = pa.array([T0 + datetime.timedelta(hours=h) for h in hours], pa.timestamp("us"))
    cols = {"id": pa.array(range(len(hours)), pa.int64()), "t": t, "more": pa.array([1.5] * len(hours))}
    pq.write_table(pa.table({n: cols[n] for n in names}), path, **settings)


def test_memory_does_not_follow_the_row_group(tmp_path):
    """Before, a task held whole decoded row groups and those ahead."""
    n = 1_000_000
    write(tmp_path / "a.parquet", [0] * (n // 2) + [1] * (n // 2), ("id", "t", "more"), row_group_size=n)
    base, most, rows = pa.total_allocated_bytes(), 0, 0
    for batch in R._Rows(str(tmp_path), "t").read(R.Frame(7, T0)):
        rows += batch.num_rows
        most = max(most, pa.total_allocated_bytes() - base)
        assert batch.num_rows <= 1 << 14 and set(batch.column(0).to_pylist()) == {7}
    assert rows == n // 2 and most < 8 << 20
    assert R.instants(str(tmp_path)) == [T0, T0 + datetime.timedelta(hours=1)]


def test_other_row_groups_are_passed_over(tmp_path):
    write(tmp_path / "a.parquet", sorted(list(range(10)) * 100), row_group_size=100)
    where = ds.field("t") == pa.scalar(T0 + datetime.timedelta(hours=3), pa.timestamp("us"))
    assert sum(b.num_rows for b in R._batches(R._dataset(str(tmp_path)), ["id"], where)) == 100


def test_files_of_other_columns_are_read_as_one_table(tmp_path):
    write(tmp_path / "a.parquet", [0, 1, 2], ("id", "t", "more"))
    write(tmp_path / "b.parquet", [1, 2, 2], ("t", "id"))
    write(tmp_path / "c.parquet", [], ("id", "t", "more"))
    got = [tuple(r.values()) for b in R._Rows(str(tmp_path), "t").read(R.Frame(0, T0 + datetime.timedelta(hours=2))) for r in b.to_pylist()]
    two = T0 + datetime.timedelta(hours=2)
    assert sorted(got, key=str) == sorted([(0, 2, two, 1.5), (0, 1, two, None), (0, 2, two, None)], key=str)
