"""Ordered state per key, streamed: rows are dealt out by key and sorted, and a task carries one key's
state from row to row. The streaming twins are in ``streaming``.

No group is ever gathered: a task holds one Arrow batch and the state of the key at hand, so the
history of an entity may be of any length. A state machine is sequential by nature, so one key is
the work of one task; the rows themselves are spilled by Spark's sort.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def streamed(rows: DataFrame, key: str, order: list[Column | str], schema: str, machine: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """(key, *schema): what a state machine says about each key's rows in order.

    ``machine()`` begins a key and returns a function of a row's other columns (in their order) that
    returns rows of the schema. ``key`` must be the first column; null keys form one group.
    """
    arrow = T.StructType([rows.schema[key], *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = object()
        step = None
        for batch in batches:
            keys, *columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            out: list[tuple] = []
            for k, *values in zip(keys, *columns):
                if step is None or k != now:
                    now, step = k, machine()
                out += [(k, *told) for told in step(*values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), types)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(arrow)
    names, types = target.names, target.types
    dealt = rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, arrow)


def _rank_of(p: float) -> int:
    return 3 if p >= C.RED else 2 if p >= C.ORANGE else 1 if p >= C.YELLOW else 0


_ENTRY = (0.0, C.YELLOW, C.ORANGE, C.RED)


def escalations(rows: DataFrame, key: str, p: str, t: str) -> DataFrame:
    """(key, seq, t, from_stage, to_stage): changes of stage with hysteresis.

    Upgrades happen at once and may skip stages; a downgrade needs p below the entry of the current
    stage by the margin, and lands at the stage of p. Entities begin GREEN.
    """

    def machine():
        now, seq = 0, 0

        def step(at, value):
            nonlocal now, seq
            if value is None or not 0 <= value <= 1:
                raise ValueError("a probability is outside 0..1")
            raw, before = _rank_of(value), now
            if raw > now or (raw < now and value < _ENTRY[now] - C.HYSTERESIS):
                now = raw
            if now == before:
                return []
            seq += 1
            return [(seq - 1, at, C.STAGES[before], C.STAGES[now])]

        return step

    kind = rows.schema[t].dataType.simpleString()
    return streamed(rows.select(key, t, p), key, [t, p], f"seq int, {t} {kind}, from_stage string, to_stage string", machine).withColumnRenamed(t, "t")


GENESIS = "0" * 64


def hash_chain(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, seq, event_id, kind, input_hash, prev_hash, hash): each alert's events chained in order.

    ``events`` has event_id, kind and payload (text). One chain per key keeps chains short and apart.
    """

    def machine():
        last, seq = GENESIS, 0

        def step(_, event_id, kind, input_hash):
            nonlocal last, seq
            before, last = last, hashlib.sha256(f"{last}:{input_hash}:{event_id}:{kind}".encode()).hexdigest()
            seq += 1
            return [(seq - 1, event_id, kind, input_hash, before, last)]

        return step

    rows = events.select(key, F.col(order).alias("place"), "event_id", "kind", F.sha2("payload", 256).alias("input_hash"))
    ids = events.schema["event_id"].dataType.simpleString()
    return streamed(rows, key, ["place", "event_id"], f"seq int, event_id {ids}, kind string, input_hash string, prev_hash string, hash string", machine)


def verify_chain(chain: DataFrame, key: str) -> DataFrame:
    """``chain`` with ``ok``: the link's hash is that of its content, and it continues the link before it."""
    again = F.sha2(F.concat_ws(":", "prev_hash", "input_hash", F.col("event_id").cast("string"), "kind"), 256)
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy("seq")), F.lit(GENESIS))
    return chain.withColumn("ok", (F.col("hash") == again) & (F.col("prev_hash") == before))


def rate_limited(calls: DataFrame, key: str, at: str, limit: int, window_s: float) -> DataFrame:
    """(key, seq, at, allowed, retry_after): calls are allowed while fewer than ``limit`` allowed ones
    lie in the window before them; rejected calls do not count. ``at`` is in seconds."""

    def machine():
        hits: deque = deque()  # at most ``limit`` allowed calls
        seq = 0

        def step(x):
            nonlocal seq
            seq += 1
            while hits and hits[0] <= x - window_s:
                hits.popleft()
            if len(hits) < limit:
                hits.append(x)
                return [(seq - 1, x, True, 0.0)]
            return [(seq - 1, x, False, hits[0] + window_s - x)]

        return step

    rows = calls.select(key, F.col(at).cast("double").alias("at"))
    return streamed(rows, key, ["at"], "seq int, at double, allowed boolean, retry_after double", machine)


def circuit(outcomes: DataFrame, key: str, order: str, failures: int = 3, cooldown_s: float = 300.0) -> DataFrame:
    """(key, seq, state): a breaker's state after each call outcome (columns ok, at in seconds)."""

    def machine():
        state, bad, since, seq = "CLOSED", 0, 0.0, 0

        def step(_, at, ok):
            nonlocal state, bad, since, seq
            seq += 1
            trial = state == "OPEN" and at - since >= cooldown_s
            if state != "OPEN" or trial:
                bad = 0 if ok else bad + 1
                if ok:
                    state = "CLOSED"
                elif trial or bad >= failures:
                    state, since = "OPEN", at
            return [(seq - 1, state)]

        return step

    rows = outcomes.select(key, F.col(order).alias("place"), "at", "ok")
    return streamed(rows, key, ["place", "at"], "seq int, state string", machine)


def superseding(claims: DataFrame, key: str) -> DataFrame:
    """(key, event_id, superseded_by, seconds): the first later claim of the same key that has authority or
    at least the same confidence. ``claims``: key, ts, event_id, confidence, authority.

    Claims are read from the newest back; of later ones only those are kept that no nearer one
    outdoes, so the state stays small.
    """

    def machine():
        later: list[tuple] = []  # nearest last: (ts, event_id, weight)
        same: list[tuple] = []  # claims of the instant at hand

        def step(ts, event_id, confidence, authority):
            if same and same[0][0] != ts:
                for claim in same:  # the claim of the smallest id comes last: it is the nearest
                    while later and later[-1][2] <= claim[2]:
                        later.pop()
                    later.append(claim)
                same.clear()
            same.append((ts, event_id, float("inf") if authority else confidence))
            by = next((c for c in reversed(later) if c[2] >= confidence), None)
            return [(event_id, by[1], int((by[0] - ts) // 1_000_000))] if by else []

        return step

    rows = claims.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "confidence", "authority")
    return streamed(rows, key, [F.desc("ts"), F.desc("event_id")], "event_id long, superseded_by long, seconds long", machine)


def digests(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, digest, events): a running SHA-256 over each key's values in order, at every row; the last counts."""

    def machine():
        running, n = hashlib.sha256(), 0

        def step(_, x):
            nonlocal n
            running.update(x.encode())
            n += 1
            return [(running.hexdigest(), n)]

        return step

    every = streamed(events.select(key, order, value), key, [order, value], "digest string, events int", machine)
    return every.groupBy(key).agg(F.max_by("digest", "events").alias("digest"), F.max("events").alias("events"))
