"""Distributed union-find: connected components of a link table.

Links live in a DataFrame and never meet in one place. Each round first contracts what a task
holds (a union-find over one partition of links keeps at most one link per vertex), then runs a
large-star and a small-star step: every vertex hands its neighbours its smallest neighbour. The
minimum per vertex is an aggregation with map-side combining, so a hub costs one row per task; it
is joined back from a table of its own, so that Spark can split a hub's links over tasks.
Rounds are logarithmic in the size of a component; each ends in a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


#: Links that a task holds before it contracts them and passes on what is left.
_HELD = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each vertex of the links (a, b) to the smallest vertex it reaches by them."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:  # numbers follow the order of the names, so the smallest number is the smallest name
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(names)))
    return names[at], names[root[at]]


@tidy
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition to links from each vertex to the smallest vertex it reaches there, or
    in a piece of it: memory is bounded, and what a piece can't join the next step joins."""
    got: list[tuple[np.ndarray, np.ndarray]] = []

    def told():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in got.pop()], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            got.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(x[0]) for x in got) > _HELD:
            got = [forest(*map(np.concatenate, zip(*got)))]
            if len(got[0][0]) > _HELD // 2:
                yield told()
    if got:
        got = [forest(*map(np.concatenate, zip(*got)))]
        yield told()


def components(links: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id reachable.

    ``links`` has two long columns in any direction; loops, repeats and nulls are ignored; without
    links there are no rows. The result has one row per id. Raises if it has not settled after ``max_rounds``.
    """
    a, b = links.columns
    small = F.least(a, b).alias("v")
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), small.cast("long"))
    # Each link goes from the larger to the smaller id.
    stars = materialize(pairs.mapInArrow(_contract, "u long, v long").distinct(), label)
    seen = None
    for _ in range(max_rounds):
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        # Small files are read together, so a task's links grow fewer and reach farther each round.
        stars = stars.mapInArrow(_contract, "u long, v long")
        # Large star: larger neighbours of a vertex link to its smallest neighbour.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), label)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # Small star: a vertex and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = materialize(small.where("u <> v").distinct(), label)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
