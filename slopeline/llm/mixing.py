"""Mixing sources to target weights by Pfair scheduling.

Each source is a queue of blocks of ``block_rows`` documents, in an order fixed by a hash of the
id. Output slots are handed out like processor time: with weight w, a source's i-th block is
released at slot floor((i-1)/w) and due by ceil(i/w); of the released blocks the one due first
takes the slot. Then at every slot each source has had its weight times the slots so far, give
or take less than one block.

Weights are integer shares of 2**40, so releases and deadlines are exact integers and rounding
amounts to less than a block within any 2**39 slots. The whole of a phase is scheduled, on the
driver and slot by slot. Blocks have ``block_rows`` documents, or more where the table would have
over ``max_blocks`` blocks, so what is scheduled and broadcast (4 bytes per block, listed in pieces
of ``period`` blocks of one source) is bounded whatever the input. When a source runs out, a new
phase begins in which the others share its weight in proportion; so every document is placed
exactly once, none is dropped or repeated. There are at most as many phases as sources, and the
deviation holds within each.

Places in a source come from one range partitioning by (source, hash, id): rows are numbered in
their partition and the partitions' counts are summed up (a table of partitions and sources),
so a source with a third of all rows is spread over many tasks.

Defined cases: a null source counts as the source ""; sources without a target weight (or with
weight 0) follow after all others, in equal shares; a null doc_id is an id like any other;
rows that share source and doc_id come in any order; texts play no part; no rows give no rows;
extra columns are carried along, those with the names of added ones are replaced; more than
``max_sources`` sources (their names and sizes are held on the driver) raise an error.
"""

from __future__ import annotations

import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

_WHOLE = 1 << 40


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer shares of the period, at least 1 each, by largest remainder."""
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def schedule(share: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end, by earliest deadline among released blocks."""
    whole = sum(share.values())
    done = dict.fromkeys(share, 0)
    waiting = [(0, s) for s in sorted(share)]  # (release, source) of each source's next block
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * whole // share[s]), s))
        _, s = heapq.heappop(ready)
        done[s] += 1
        yield s
        t += 1
        heapq.heappush(waiting, (max(done[s] * whole // share[s], t), s))


def one_period(share: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots of each source in the first ``period`` slots, which the shares sum to."""
    slots: dict[str, list[int]] = {s: [] for s in share}
    for t, s in zip(range(period), schedule(share)):
        slots[s].append(t)
    return slots


def plan(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Phases: for each source in one, its first block, the phase's first slot, and the slot in the phase of each block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, begin, phase = [], 0, 0
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        share = shares(active, _WHOLE)
        slots = {s: array("i") for s in active}
        for t, s in enumerate(schedule(share)):
            slots[s].append(t)
            if len(slots[s]) == left[s]:  # the phase ends when a source runs out
                break
        for s in sorted(active):
            if n := len(slots[s]):
                out.append({"src": s, "phase": phase, "weight": share[s] / _WHOLE, "first": done[s], "begin": begin, "slots": slots[s]})
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin += t + 1
        phase += 1
    return out


def pieces(phases: list[dict], size: int) -> Iterator[tuple]:
    """(source, number of the piece, phase, weight, first block, begin, slots): a piece holds a source's
    blocks from number * size on, as far as they lie in one phase."""
    for p in phases:
        at, end = p["first"], p["first"] + len(p["slots"])
        while at < end:
            to = min(end, (at // size + 1) * size)
            yield p["src"], at // size, p["phase"], p["weight"], at, p["begin"], p["slots"][at - p["first"] : to - p["first"]]
            at = to


def _table(spark: SparkSession, phases: list[dict], size: int) -> DataFrame:
    names = "src piece mix_phase mix_weight first begin slots".split()
    types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    columns = list(zip(*pieces(phases, size))) or [()] * 7
    slots = pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, columns[6]))], pa.int32()), pa.array(np.frombuffer(b"".join(x.tobytes() for x in columns[6]), np.int32)))
    cols = [pa.array(c, t) for c, t in zip(columns[:6], types)] + [slots]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=pa.schema(list(zip(names, types)))))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, temperature: float = 0.5, block_rows: int = 32, period: int = 1000, max_blocks: int = 1 << 22, max_sources: int = 10_000, seed: int = 42) -> DataFrame:
    """``docs`` with the columns mix_phase, mix_weight, mix_block, mix_slot and mix_position added.

    Sorting by mix_position gives the mix. Without ``weights`` a source's target weight is its
    number of documents to the power ``temperature`` (1 keeps proportions, 0 makes all equal).
    Added columns replace any of the same name.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_phase", "mix_weight", "mix_block", "mix_slot", "mix_position")
    names = docs.columns
    # The rows travel as one column, so that their names can't clash with those used here.
    keyed = docs.select(F.coalesce("source", F.lit("")).alias("src_"), F.xxhash64("doc_id", F.lit(seed)).alias("hash_"), F.col("doc_id").alias("id_"), F.struct(*names).alias("row_"))
    src, at, part = "src_", "at_", "part_"
    order = [src, "hash_", "id_"]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash_", "id_")
    rows = materialize(rows.withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()}), "mix-order")
    counted = rows.groupBy(src, part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lead"))
    sizes = {r[0]: r[1] for r in counted.groupBy(src).agg(F.sum("n")).limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    block_rows = max(block_rows, -(-sum(sizes.values()) // max_blocks))
    targets = weights if weights is not None else {s: n**temperature for s, n in sizes.items()}
    phases = plan({s: -(-n // block_rows) for s, n in sizes.items()}, targets)
    # 4 bytes per block of block_rows rows.
    table = F.broadcast(_table(spark, phases, period))
    before = Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(F.col(src).alias("o_src"), F.col(part).alias("o_part"), "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = rows.join(offsets, (F.col(src) == F.col("o_src")) & (F.col(part) == F.col("o_part"))).withColumn("place", F.col(at) - F.col("lead") + F.col("before"))
    placed = placed.withColumn("mix_block", F.floor(F.col("place") / block_rows))
    nth = F.col("mix_block") - F.col("first")
    placed = placed.join(table, (F.col(src) == table["src"]) & (F.floor(F.col("mix_block") / period) == table["piece"]) & (nth >= 0) & (nth < F.size("slots")))
    slot = F.col("begin") + F.element_at("slots", (nth + 1).cast("int"))
    added = placed.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("place") % block_rows)
    return added.select(*[F.col("row_")[c].alias(c) for c in names], "mix_phase", "mix_weight", "mix_block", "mix_slot", "mix_position")


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """The rows sorted by their place in the mix, without the added columns."""
    out = mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return out.drop("mix_phase", "mix_weight", "mix_block", "mix_slot", "mix_position")
