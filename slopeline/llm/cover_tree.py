"""Embedding near-dedup by cover trees and dual traversal: all pairs at or above a cosine.

Vectors are made unit length, so cosine >= c means distance <= t = sqrt(2 - 2c). Vectors are
compared only within their group (equal, non-null labels).

Equal vectors become one point first. The points of a group are laid out as a cover tree whose
levels halve the radius: level i holds centres, every point lies within 2 ** (1 - i) of its
centre of level i, and the centres of a level are themselves within the radius of centres of
the level above. A dual traversal starts from pairs of top nodes and goes down: a pair of nodes
is dropped when the distance of its centres exceeds t plus both covering radii (the largest
distance to a point below, measured, not the bound of the level), else replaced by the pairs of
their children; at the leaves points are compared in double precision. Dropped pairs can hold no
link, so the result is exact.

A group is split so that no task holds all of it. Pivots, one per ``leaf`` / 2 points but no more
than the root of the group's size and chosen by hash, are the upper nodes of its tree: every point
joins its nearest pivot (points come in chunks that carry the group's pivots along), and the points
of a pivot are cut into shells by their distance from it and into leaves of about ``leaf`` points by
hash.
The dual traversal of pivots and leaves is a chain of joins with the bounds as conditions; only
surviving pairs of leaves are compared, each by a dual traversal of the leaves' own cover trees.
A task holds two leaves at a time, and returns counts per point and the links of a spanning
forest: no list of all pairs is ever made.

Points far apart from each other in high dimensions leave the bounds nothing to prune; a node
that has nothing to gain from children stays a leaf and is compared by one matrix product.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do rows with a null label or vectors of another length; a null vec_id links
and counts, but names a component only if no other id is reachable (component_id is then null
and ``kept`` false); rows repeated with one vec_id count as vectors of their own; an empty table
gives no rows; vectors may have any length; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .components import components, forest


_GAIN = 8  # points that a node's children hold on average, or the node stays a leaf


class CoverTree:
    """A cover tree over a few hundred points: nodes by level, radii halving from 2."""

    def __init__(self, points: np.ndarray, leaf: int = 8):
        self.points = points
        self.leaf = leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.root = self._grow(np.arange(len(points)), 0, 2.0)

    def _grow(self, members: np.ndarray, centre: int, bound: float) -> int:
        node = len(self.centre)
        far = np.sqrt(np.maximum(0.0, ((self.points[members] - self.points[centre]) ** 2).sum(1)))
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.members.append(members)
        self.children.append([])
        if len(members) > self.leaf and self.radius[node] > 0:
            # Centres of the next level: points farther than half the radius from all others chosen.
            bound = min(bound, self.radius[node]) / 2
            near, owner, k, n = far, np.full(len(members), centre), centre, 1
            while near.max() > bound:
                k = int(members[near.argmax()])
                d = np.sqrt(((self.points[members] - self.points[k]) ** 2).sum(1))
                owner = np.where(d < near, k, owner)
                near = np.minimum(d, near)
                n += 1
                if n > _GAIN + len(members) // _GAIN:
                    return node  # nothing to gain: the points are far apart from each other
            names = np.unique(owner)
            if len(names) > 1:
                self.children[node] = [self._grow(members[owner == k], int(k), bound) for k in names]
        return node


def dual(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of point numbers (of a, of b) in node pairs that the radii can't rule out."""
    todo = [(a.root, b.root)]
    while todo:
        x, y = todo.pop()
        gap = np.sqrt(((a.points[a.centre[x]] - b.points[b.centre[y]]) ** 2).sum())
        if gap > reach + a.radius[x] + b.radius[y]:
            continue
        down_x, down_y = a.children[x], b.children[y]
        if not down_x and not down_y:
            yield a.members[x], b.members[y]
        elif not down_y or down_x and a.radius[x] >= b.radius[y]:
            todo += [(c, y) for c in down_x]
        else:
            todo += [(x, c) for c in down_y]


_VECTOR = "array<float>"


def usable(vector: str, label: str) -> Column:
    """Whether a vector can link at all."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


@tidy
def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, salt, kind): a chunk's pivots (kind 0), then its points. Each point with its nearest pivot."""
    chunk, ids, tops = None, np.zeros(0, np.int64), []
    for batch in batches:
        if not batch.num_rows:
            continue
        grp, salt, kind = (batch.column(i).to_pylist() for i in range(3))
        edge = [0, *(i for i in range(1, batch.num_rows) if (grp[i], salt[i], kind[i]) != (grp[i - 1], salt[i - 1], kind[i - 1])), batch.num_rows]
        for lo, hi in zip(edge, edge[1:]):
            part = batch.slice(lo, hi - lo)
            vec = unit(part.column(5))
            if kind[lo] == 0:
                if (grp[lo], salt[lo]) != chunk:
                    chunk, ids, tops = (grp[lo], salt[lo]), np.zeros(0, np.int64), []
                ids = np.append(ids, part.column(3).to_numpy())
                tops.append(vec)
            else:
                p = np.concatenate(tops)
                best = (vec @ p.T).argmax(1)
                d = np.sqrt(((vec - p[best]) ** 2).sum(1))
                yield _batch("grp pid w vec pivot d", part.column(0), part.column(3), part.column(4), part.column(5), ids[best], d)


def _pivot_pairs(reach: float):
    """Rows (grp, p, pr, pv, q, qr, qv): pivot pairs whose distance the covering radii can't rule out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = pc.list_value_length(batch.column(3)).to_numpy()
                gap = np.zeros(batch.num_rows)
                for n in np.unique(size):  # groups of vectors of different length may share a batch
                    at = np.flatnonzero(size == n)
                    gap[at] = np.sqrt(((unit(batch.column(3).take(pa.array(at))) - unit(batch.column(6).take(pa.array(at)))) ** 2).sum(1))
                ok = gap <= reach + batch.column(2).to_numpy() + batch.column(5).to_numpy()
                keep = pa.array(ok)
                yield _batch("grp p q gap", *(batch.column(i).filter(keep) for i in (0, 1, 4)), gap[ok])

    return run


def _compare(cosine: float, reach: float):
    """Rows (x, y) of leaves, each with its points: (a, b, n). n counts linked vectors of point a;
    rows with n 0 are links between a and b."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple] = {}  # of the last leaves; pairs come ordered by one side

        def leaf_of(name: str, points: pa.StructArray) -> tuple:
            if name not in trees:
                if len(trees) > 3:
                    trees.pop(next(iter(trees)))
                ids, w, vec = _leaf(points)
                trees[name] = ids, w, vec, CoverTree(vec)
            return trees[name]

        for batch in batches:
            for row in range(batch.num_rows):
                x, y = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                same = x == y
                yi, yw, yv, right = leaf_of(y, batch.column(3)[row].values)
                xi, xw, xv, left = leaf_of(x, batch.column(2)[row].values)
                nx, ny = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64)
                links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for i, j in dual(left, right, reach):
                    hit = xv[i] @ yv[j].T >= cosine
                    if same:
                        hit &= i[:, None] != j[None, :]
                    if hit.any():
                        nx[i] += hit @ yw[j]
                        ny[j] += xw[i] @ hit
                        p, q = np.nonzero(hit)
                        links.append((xi[i[p]], yi[j[q]]))
                ends = [np.concatenate(z) for z in zip(*links)]
                if not len(ends[0]):
                    continue
                links = forest(*ends)
                count = [(xi[nx > 0], nx[nx > 0])] if same else [(xi[nx > 0], nx[nx > 0]), (yi[ny > 0], ny[ny > 0])]
                for ids, n in count:
                    yield _batch("a b n", ids, ids, n)
                yield _batch("a b n", *links, np.zeros(len(links[0]), np.int64))

    return run


def _leaf(points: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return points.field("pid").to_numpy(), points.field("w").to_numpy(), unit(points.field("vec"))


def _leaves(points: DataFrame, leaf: int, chunk: int) -> DataFrame:
    """(grp, pid, w, vec, pivot, d, leaf): the points of (grp, pid, w, vec) in their place."""
    size = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sized = points.join(size, "grp")
    share = F.pmod(F.xxhash64("pid"), F.lit(1 << 40)) / float(1 << 40)
    pivots = F.greatest(F.lit(2.0), F.least(F.sqrt("n"), F.col("n") / (leaf / 2)))
    sized = sized.withColumn("top", share * F.col("n") < pivots)
    spread = F.ceil(F.col("n") / chunk).cast("int")
    rows = sized.select("grp", F.pmod(F.xxhash64("pid", F.lit(7)), spread).cast("int").alias("salt"), F.lit(1).alias("kind"), "pid", "w", "vec")
    tops = sized.where("top").select("grp", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), F.lit(0).alias("kind"), "pid", "w", "vec")
    lost = size.join(sized.where("top").select("grp").distinct(), "grp", "left_anti")  # a group without a pivot by bad luck
    one = points.join(lost, "grp").groupBy("grp", F.ceil(F.col("n") / chunk).cast("int").alias("c")).agg(F.min_by(F.struct("pid", "w", "vec"), "pid").alias("x"))
    tops = tops.unionByName(one.select("grp", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"), F.lit(0).alias("kind"), "x.*"))
    placed = rows.unionByName(tops).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "kind")
    placed = placed.mapInArrow(_to_pivots, f"grp string, pid long, w long, vec {_VECTOR}, pivot long, d double")
    placed = materialize(placed.withColumn("shell", F.floor(F.col("d") * 8).cast("int")), "cover-placed")
    held = materialize(placed.groupBy("grp", "pivot", "shell").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("parts")), "cover-shells")
    part = F.col("shell") * (1 << 20) + F.pmod(F.xxhash64("pid", F.lit(11)), F.col("parts")).cast("int")
    return materialize(placed.join(held, ["grp", "pivot", "shell"]).withColumn("leaf", part).drop("shell", "parts"), "cover-points")


def point_links(points: DataFrame, *, cosine: float, leaf: int = 1024, chunk: int = 4096) -> DataFrame:
    """(a, b, n) over points (grp, pid, w, vec): rows with n > 0 are parts of the number of linked
    vectors of point a, rows with n = 0 are links that connect what is linked."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + 1e-6  # a hair more than needed; cosines decide
    placed = _leaves(points, leaf, chunk)
    centre = placed.groupBy("grp", "pivot").agg(F.max("d").alias("r"))
    centre = materialize(centre.join(placed.select("grp", F.col("pid").alias("pivot"), "vec"), ["grp", "pivot"]), "cover-pivots")
    p = centre.select("grp", F.col("pivot").alias("p"), F.col("r").alias("pr"), F.col("vec").alias("pv"))
    q = centre.select("grp", F.col("pivot").alias("q"), F.col("r").alias("qr"), F.col("vec").alias("qv"))
    pairs = p.join(q, "grp").where("p <= q").select("grp", "p", "pr", "pv", "q", "qr", "qv")
    pairs = pairs.mapInArrow(_pivot_pairs(reach), "grp string, p long, q long, gap double")
    shell = placed.groupBy("grp", "pivot", "leaf").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.collect_list(F.struct("pid", "w", "vec")).alias("pts"))
    shell = materialize(shell.withColumn("id", F.concat_ws(":", "grp", "pivot", "leaf")), "cover-leaves")
    x = shell.select("grp", F.col("pivot").alias("p"), F.col("id").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    y = shell.select("grp", F.col("pivot").alias("q"), F.col("id").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    # The triangle inequality over the two pivots bounds the distance of the shells' points from below.
    least = F.greatest(F.col("gap") - F.col("xhi") - F.col("yhi"), F.col("xlo") - F.col("gap") - F.col("yhi"), F.col("ylo") - F.col("gap") - F.col("xhi"))
    met = pairs.join(x, ["grp", "p"]).join(y, ["grp", "q"]).where((least <= reach) & ((F.col("p") < F.col("q")) | (F.col("x") <= F.col("y")))).select("grp", "x", "y")
    full = shell.select("grp", F.col("id").alias("x"), F.col("pts").alias("xp"))
    met = met.join(full, ["grp", "x"]).join(full.select("grp", F.col("x").alias("y"), F.col("xp").alias("yp")), ["grp", "y"])
    return materialize(met.select("x", "y", "xp", "yp").mapInArrow(_compare(cosine, reach), "a long, b long, n long"), "cover-links")


def embedding_dedup(rows: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", leaf: int = 1024) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(_VECTOR).alias("vec"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("ok", usable("vec", "label"))
    good = rows.where("ok").withColumn("grp", F.concat_ws(":", F.size("vec"), "label"))
    points = good.groupBy("grp", "vec").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    points = materialize(points.withColumn("pid", F.monotonically_increasing_id()), "vectors")
    links = point_links(points.select("grp", "pid", "w", "vec"), cosine=cosine, leaf=leaf)
    count = links.where("n > 0").groupBy(F.col("a").alias("pid")).agg(F.sum("n").alias("n"))
    found = components(links.where("n = 0").select("a", "b"), "cover-components").select(F.col("id").alias("pid"), "component")
    named = points.join(found, "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(least, "component").join(count, "pid", "left").select("grp", "vec", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(told, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
