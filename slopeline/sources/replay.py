"""Replay of stored frames as a Spark data source, for batch and stream.

A tape is what is played: position by position, each one a frame (all rows of one instant). The frames of
a folder of parquet files in order of time are the tape; a seek goes on with another frame at the
position that is next, so positions never go back while the frames may. What has been released and
where the tape was cut lies in a small control file, which a program writes (``Controls``) and the
source reads. A stream's offset is a position, so a query that is started again on its checkpoint
goes on where it stopped, whatever was paused, sped up or sought meanwhile.

The driver holds the instants of the frames, the tasks read the rows, one partition for each position. A task
reads the row groups that can hold its frame, batch by batch: files sorted by time in small row groups (and with statistics of the
instant, which Spark's older instants lack) let it pass over the others.
"""

from __future__ import annotations

import bisect
import datetime
import json
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _dataset(path: str) -> ds.Dataset:
    """Parquet files below a path or URI that pyarrow can open (a shared folder, HDFS or an object store)."""
    filesystem, place = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    return ds.dataset(place, filesystem=filesystem, format="parquet")


def _told(kind: pa.DataType) -> pa.DataType:
    """How Spark takes a column: nanoseconds are those of Spark's older instants, which are in UTC."""
    return pa.timestamp("us", "UTC") if kind == pa.timestamp("ns") else kind


_ROWS, _BYTES = 1 << 14, 1 << 18  # rows of a batch, bytes of a column's buffer


def _batches(data: ds.Dataset, columns: Sequence[str], where: ds.Expression | None = None) -> Iterator[pa.RecordBatch]:
    """The columns of all row groups that can hold such rows, unfiltered, a small batch at a time.

    A scan of the data set would decode whole row groups, several ahead; this holds a batch and a buffer a column.
    """
    for piece in data.get_fragments(filter=where):
        groups = [g.id for g in (piece if where is None else piece.subset(where)).row_groups]
        if not groups:
            continue
        with piece.filesystem.open_input_file(piece.path) as f:
            file = pq.ParquetFile(f, buffer_size=_BYTES, pre_buffer=False)
            held = [c for c in columns if c in file.schema_arrow.names]
            for batch in file.iter_batches(_ROWS, row_groups=groups, columns=held, use_threads=False):
                made = [batch.column(c).cast(data.schema.field(c).type) if c in held else pa.nulls(batch.num_rows, data.schema.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays(made, list(columns))
    pa.default_memory_pool().release_unused()


def instants(path: str, column: str = "t") -> list[datetime.datetime]:
    """The instants of all frames in order: one column is read, batch by batch."""
    found: set = set()
    for batch in _batches(_dataset(path), [column]):
        values = batch.column(0)
        found.update(pc.unique(values.cast(pa.timestamp("us", values.type.tz))).drop_null().to_pylist())
    return sorted(found)


def frame_at(times: Sequence[datetime.datetime], to: datetime.datetime) -> int:
    """The first frame at or after an instant; the last one where none is."""
    return min(bisect.bisect_left(times, to), len(times) - 1)


class Controls:
    """What plays: pause, resume, speed, seek, advance and restart, kept in a file.

    Released positions grow by ``advance``, or by the clock once a speed is set (seconds of the record
    for each second that passes).
    """

    def __init__(self, control: str, path: str, column: str = "t"):
        self.control, self.times = control, instants(path, column)

    def _load(self) -> dict:
        return _state(self.control)

    def _store(self, state: dict) -> None:
        filesystem, place = pa.fs.FileSystem.from_uri(self.control) if "://" in self.control else (pa.fs.LocalFileSystem(), self.control)
        with filesystem.open_output_stream(place) as out:
            out.write(json.dumps(state).encode())

    def _fixed(self) -> dict:
        """The state with what the clock has released by now made firm."""
        state = self._load()
        state["released"] = _released(state, self.times)
        state["since"] = time.time()
        return state

    def advance(self, frames: int) -> None:
        state = self._fixed()
        state["released"] = min(state["released"] + frames, _length(state, self.times))
        self._store(state)

    def set_speed(self, speed: float) -> None:
        if speed <= 0:
            raise ValueError("the speed must be above 0")
        self._store(self._fixed() | {"speed": speed})

    def pause(self) -> None:
        self._store(self._fixed() | {"paused": True})

    def resume(self) -> None:
        self._store(self._fixed() | {"paused": False})

    def seek(self, to: datetime.datetime) -> None:
        """The next position shows the first frame at or after ``to``; the last one where none is."""
        state = self._fixed()
        if self.times:
            state["cuts"].append([state["released"], frame_at(self.times, to)])
        self._store(state)

    def restart(self) -> None:
        """The next position shows the first frame; not paused."""
        state = self._fixed()
        state["cuts"].append([state["released"], 0])
        self._store(state | {"paused": False})


def _state(control: str) -> dict:
    filesystem, place = pa.fs.FileSystem.from_uri(control) if "://" in control else (pa.fs.LocalFileSystem(), control)
    fresh = {"cuts": [[0, 0]], "released": 0, "speed": None, "paused": False, "since": 0.0}
    if filesystem.get_file_info(place).type == pa.fs.FileType.NotFound:
        return fresh
    with filesystem.open_input_stream(place) as f:
        return fresh | json.loads(f.read())


def _length(state: dict, times: Sequence) -> int:
    """Positions of the tape as it is cut now: up to the last frame."""
    position, frame = state["cuts"][-1]
    return position + len(times) - frame


def _frame(state: dict, position: int) -> int:
    """The frame that a position shows."""
    cut = max((c for c in enumerate(state["cuts"]) if c[1][0] <= position), key=lambda c: (c[1][0], c[0]))[1]
    return cut[1] + position - cut[0]


def _released(state: dict, times: Sequence[datetime.datetime]) -> int:
    """Positions that may be read: those told, and those whose time has come since."""
    told, end = state["released"], _length(state, times)
    if not state["speed"] or state["paused"] or told >= end:
        return min(told, end)
    first = _frame(state, told)
    upto = times[first] + datetime.timedelta(seconds=(time.time() - state["since"]) * state["speed"])
    return min(told + bisect.bisect_right(times, upto) - first, end)


class Frame(InputPartition):
    def __init__(self, position: int, t: datetime.datetime):
        super().__init__(position)
        self.position, self.t = position, t


class _Rows:
    """Reading of one frame, which tasks do."""

    def __init__(self, path: str, column: str):
        self.path, self.column = path, column

    def read(self, partition: Frame | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a tape without frames
            return
        data = _dataset(self.path)
        t = pa.scalar(partition.t, data.schema.field(self.column).type)
        for batch in _batches(data, data.schema.names, ds.field(self.column) == t):
            batch = batch.filter(pc.equal(batch.column(self.column), t))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(partition.position, pa.int64()), batch.num_rows), *[c.cast(_told(c.type)) for c in batch.columns]], ["position", *batch.schema.names])


class BatchReader(_Rows, DataSourceReader):
    def __init__(self, path: str, column: str, start: str | None):
        super().__init__(path, column)
        self.start = start

    def partitions(self) -> list[Frame]:
        times = instants(self.path, self.column)
        first = frame_at(times, _instant(self.start, times)) if self.start and times else 0
        return [Frame(i, t) for i, t in enumerate(times)][first:]


class StreamReader(_Rows, DataSourceStreamReader):
    def __init__(self, path: str, column: str, control: str):
        super().__init__(path, column)
        self.control, self.times = control, instants(path, column)

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": _released(_state(self.control), self.times)}

    def partitions(self, start: dict, end: dict) -> list[Frame]:
        state = _state(self.control)
        return [Frame(i, self.times[_frame(state, i)]) for i in range(start["position"], end["position"])]

    def commit(self, end: dict) -> None:
        pass


def _instant(text: str, times: Sequence[datetime.datetime]) -> datetime.datetime:
    found = datetime.datetime.fromisoformat(text)
    return found if (times[0].tzinfo is None) == (found.tzinfo is None) else found.replace(tzinfo=times[0].tzinfo)


class ReplaySource(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("replay")``. Options: ``path`` (parquet files with an instant in
    ``column``, by default t); batch: ``from`` (seek to an instant); stream: ``control`` (see ``Controls``).

    Rows are those of the files with the position they were played at in front.
    """

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        stored = _dataset(self.options["path"]).schema
        return from_arrow_schema(pa.schema([pa.field("position", pa.int64()), *[f.with_type(_told(f.type)) for f in stored]]))

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"], self.options.get("column", "t"), self.options.get("from"))

    def streamReader(self, schema: StructType) -> StreamReader:
        if "control" not in self.options:
            raise ValueError("a stream needs the option control")
        return StreamReader(self.options["path"], self.options.get("column", "t"), self.options["control"])
