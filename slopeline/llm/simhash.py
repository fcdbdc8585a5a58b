"""SimHash near-dedup by deletion-variant signatures.

A text's 64-bit fingerprint has a bit set where more than half of its shingle hashes have it.
Two fingerprints link when they differ in at most ``distance`` bits. Cut into ``segments``
pieces, two such fingerprints differ by at most one bit in at least one piece (with 4 bits over
3 pieces, one piece gets at most 1). So each piece is indexed under its one-wildcard variants:
for each bit of the piece, the piece with that bit left out. Fingerprints that agree on a
variant are compared in full.

Only distinct fingerprints are indexed, so exact copies cost nothing. Variants are brought
together by hash partitioning and sorted; a task streams over its keys. For a key with at most
``block`` fingerprints it returns the links of a spanning forest, never all pairs. A key with
more is not compared there: its rows go to a second round, where every pair of blocks of that
key is a group of its own, so that no group has more than two blocks and no pair is lost.

``keep_one`` may ask for a ``similarity``: then links are verified by the exact Jaccard similarity
of the texts' shingle sets. A fingerprint differs by about 10 bits at similarity 0.8, so such a
search takes more segments (``distance`` below twice their number). Within a key fingerprints count
as near whatever their sketches of 128 bits (MinHash, one bit per bin) say, unless ``apart`` bounds how
many bits may differ. Of the near ones the links of a spanning forest, nearest sketches first, are verified;
a forest's link that fails may have hidden one that holds, so every near pair that the verified links leave
apart is verified as well.

Defined cases: a null text and a text without words have fingerprint zero, linked like any
other; texts with fewer words than a shingle are hashed whole; a row with a null doc_id gets a
component but is never its name unless all ids are null; repeated rows share their outcome; very
long texts are hashed whole; an empty table gives no rows; extra columns are carried along by
``keep_one`` and play no part elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import NO_ID, NOT_SPACE, buffers, chunks, materialize, mix, tidy, word_spans
from .components import components

_SLICE = 1 << 15
_CHUNK = 1 << 20  # bytes of text at a time: hashes and sketches take many times the text

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(raw: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk of texts (lower-cased A-Z), and where each text's hashes begin."""
    from xxhash import xxh64_intdigest

    low = _LOWER[raw]
    starts, ends, first = word_spans(low, off, NOT_SPACE)
    first = np.append(first[:-1], len(starts))
    # Words joined by one space: word i begins at starts of the joined text.
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    take = np.repeat(starts - at[:-1], size) + _ranges(at[:-1], size)
    joined[_ranges(at[:-1], size)] = low[take]
    text = joined.tobytes()
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    i = np.arange(len(owner)) - begin[owner] + first[owner]
    j = np.minimum(i + shingle, first[owner + 1])
    h = np.empty(len(i), np.uint64)
    for k in range(0, len(i), _SLICE):  # Python's numbers take five times the room of the array's
        own = slice(k, k + _SLICE)
        h[own] = [xxh64_intdigest(text[a:b], seed) for a, b in zip(at[i[own]].tolist(), (at[j[own]] - 1).tolist())]
    return h, begin


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, size), one after another."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size) + np.repeat(start, size)


def majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in more than half of its hashes."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    for i in range(64):  # one bit at a time keeps memory at one column
        got = np.add.reduceat(((h >> np.uint64(i)) & np.uint64(1)).astype(np.int64), begin[:-1][full])
        out[full] |= (got * 2 > n[full]).astype(np.uint64) << np.uint64(i)
    return out


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one more column ``fp`` (long; replaced if it is there): the fingerprint of ``text``."""
    docs = docs.drop("fp")
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                got = majority(*shingle_hashes(*buffers(part.column(at)), shingle, seed))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.view(np.int64))], [*part.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the link graph among a few fingerprints."""
    root = np.arange(len(fp))
    left, right = [], []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) + i + 1
        while len(near := near[root[near] != root[i]]):
            left.append(i)
            right.append(near[0])
            root[root == root[near[0]]] = root[i]
    return fp[left], fp[right]


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names.split())


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` columns, cut so that no key is torn apart."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns)])
        if any(held[0][i][0] != held[-1][i][-1] for i in range(keys)):  # at least one key has ended
            cols = [np.concatenate(x) for x in zip(*held)]
            other = np.zeros(len(cols[0]), bool)
            for c in cols[:keys]:
                other |= c != c[-1]
            last = int(np.flatnonzero(other)[-1]) + 1
            yield [c[:last] for c in cols]
            held = [[c[last:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _edges(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each key begins, and its number of rows."""
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    edge = np.flatnonzero(new)
    return edge, np.diff(np.append(edge, len(new)))


_LINKS = "a long, b long, n long"


def _compare(distance: int, block: int):
    """Of sorted (key, fp) rows links (a, b, 0), and the rows (key, fp, n) of keys with n > block fingerprints."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_keys(batches, 1):
            edge, size = _edges([key])
            few = np.repeat((size > 1) & (size <= 8), size)
            k, f = key[few], fp[few]
            for gap in range(1, 8):
                near = (k[gap:] == k[:-gap]) & (np.bitwise_count(f[gap:] ^ f[:-gap]) <= distance)
                if near.any():
                    yield _batch("a b n", f[:-gap][near], f[gap:][near], np.zeros(int(near.sum()), np.int64))
            for start, n in zip(edge[size > 8], size[size > 8]):
                own = fp[start : start + n]
                if n <= block:
                    a, b = _forest(own, distance)
                    yield _batch("a b n", a, b, np.zeros(len(a), np.int64))
                else:
                    yield _batch("a b n", key[start : start + n], own, np.full(n, n))

    return run


def _compare_blocks(distance: int):
    """Of (key, lo, hi, fp) rows sorted by the first three, links (a, b)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, fp in _whole_keys(batches, 3):
            for start, n in zip(*_edges(key)):
                yield _batch("a b", *_forest(fp[start : start + n], distance))

    return run


def in_blocks(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """(key, lo, hi, columns) of large keys (key, n, columns): every pair of blocks of a key is a group."""
    blocks = F.ceil(F.col("n") / block)
    out = rows.withColumn("own", F.pmod(F.xxhash64(columns[0]), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    out = out.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns)
    return out.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", columns[0])


def variants(fps: DataFrame, segments: int = 3, *more: str) -> DataFrame:
    """(key, fp, more): every fingerprint under each of its 64 one-wildcard segment variants."""
    cut = [64 * i // segments for i in range(segments + 1)]
    low, width = F.lit(cut[-2]), F.lit(64 - cut[-2])
    for a, b in reversed(list(zip(cut[:-2], cut[1:-1]))):
        low, width = F.when(F.col("bit") < b, a).otherwise(low), F.when(F.col("bit") < b, b - a).otherwise(width)
    at = fps.select("fp", *more, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select("fp", *more, "bit", low.alias("low"), width.alias("width"))
    piece = "shiftrightunsigned(fp, low) & (shiftleft(1L, width) - 1L) & ~shiftleft(1L, bit - low)"
    return at.select(F.expr(f"shiftleft(cast(bit as long), 40) | ({piece})").alias("key"), "fp", *more)


def fingerprint_links(fps: DataFrame, *, distance: int = 4, segments: int = 3, block: int = 2048) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints within ``distance`` bits of each other.

    Not every pair is returned, but a path of links leads from each fingerprint to each other
    one within the distance.
    """
    if distance >= 2 * segments:
        raise ValueError("some segment must differ by at most one bit: distance < 2 * segments")
    keys = variants(fps, segments).repartition("key").sortWithinPartitions("key", "fp")
    first = materialize(keys.mapInArrow(_compare(distance, block), _LINKS).distinct(), "simhash-links")
    large = first.where("n > 0").select(F.col("a").alias("key"), "n", F.col("b").alias("fp"))
    second = in_blocks(large, block, "fp").mapInArrow(_compare_blocks(distance), "a long, b long")
    return first.where("n = 0").select("a", "b").unionByName(second)


def simhash_groups(docs: DataFrame, *, shingle: int = 4, seed: int = 42, distance: int = 4, segments: int = 3, block: int = 2048) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(fingerprints(slim, shingle=shingle, seed=seed).select("doc_id", "fp"), "simhash-fp")
    names = component_names(rows, distance=distance, segments=segments, block=block)
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_names(rows: DataFrame, *, distance: int, segments: int, block: int) -> DataFrame:
    """(fp, component_id): the smallest doc_id of all texts whose fingerprints are reachable."""
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(fingerprint_links(own.select("fp"), distance=distance, segments=segments, block=block), "simhash-components")
    named = own.join(found, own.fp == found.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


_BINS = 128
_FEW = 100  # shingles; with fewer the bins of a sketch depend on each other


@lru_cache(maxsize=1)
def _fill_order() -> np.ndarray:
    return np.array([np.random.default_rng(i).permutation(_BINS) for i in range(_BINS)])


def sketches(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of MinHash of each text's shingle hashes as two columns, and the number of its shingles."""
    n = np.diff(begin)
    text = np.repeat(np.arange(len(n)), n)
    x = mix(h ^ np.uint64(0x5BD1E995))
    flat = np.full(len(n) * _BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(flat, text * _BINS + (x >> np.uint64(57)).astype(np.int64), x << np.uint64(7))
    value = flat.reshape(len(n), _BINS)
    own, order = value.copy(), _fill_order()
    row, col = np.nonzero((value == np.uint64(0xFFFFFFFFFFFFFFFF)) & (n > 0)[:, None])
    for step in range(_BINS):
        if not len(row):
            break
        got = own[row, order[col, step]]
        ok = got != np.uint64(0xFFFFFFFFFFFFFFFF)
        value[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
    bit = (value >> np.uint64(20)) & np.uint64(1)
    weigh = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (bit[:, :64] * weigh).sum(1, dtype=np.uint64), (bit[:, 64:] * weigh).sum(1, dtype=np.uint64), n


def _near_pairs(fp: np.ndarray, one: np.ndarray, two: np.ndarray, few: np.ndarray, distance: int, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All near rows as places (left, right) and how far their sketches are apart, a strip of rows at a time."""
    for i in range(0, len(fp), 256):
        differ = np.bitwise_count(one[i : i + 256, None] ^ one[None, :]).astype(np.int64) + np.bitwise_count(two[i : i + 256, None] ^ two[None, :])
        near = (np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= distance) & ((differ <= apart) | few[i : i + 256, None] | few[None, :])
        a, b = np.nonzero(near)
        up = b > a + i
        yield a[up] + i, b[up], differ[a[up], b[up]]


def _near_forest(fp: np.ndarray, one: np.ndarray, two: np.ndarray, few: np.ndarray, distance: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of near rows, those with the nearest sketches first."""
    left, right, cost = zip(*_near_pairs(fp, one, two, few, distance, apart))
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(np.concatenate(cost), kind="stable")
    root = list(range(len(fp)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for k in order.tolist():
        x, y = find(int(left[k])), find(int(right[k]))
        if x != y:
            root[y] = x
            kept.append(k)
    return left[kept], right[kept]


_NEAR = ["v", "fp", "one", "two", "few"]


def _near(distance: int, apart: int, block: int):
    """Of (key, v, fp, one, two, few) rows sorted by key, links (a, b, 0) and the rows (key, v, n) of large keys."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, v, fp, one, two, few in _whole_keys(batches, 1):
            edge, size = _edges([key])
            for start, n in zip(edge[size > 1].tolist(), size[size > 1].tolist()):
                at = slice(start, start + n)
                if n > block:
                    yield _batch("a b n", key[at], v[at], np.full(n, n))
                    continue
                a, b = _near_forest(fp[at], one[at], two[at], few[at].astype(bool), distance, apart)
                if len(a):
                    yield _batch("a b n", v[at][a], v[at][b], np.zeros(len(a), np.int64))

    return run


def _near_blocks(distance: int, apart: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, v, fp, one, two, few in _whole_keys(batches, 3):
            for start, n in zip(*_edges(key)):
                at = slice(start, start + n)
                a, b = _near_forest(fp[at], one[at], two[at], few[at].astype(bool), distance, apart)
                yield _batch("a b", v[at][a], v[at][b])

    return run


def _between(distance: int, apart: int, block: int | None = None):
    """Of rows sorted by key (key, v, fp, one, two, few, part; of blocks: key, lo, hi, ...) all near pairs (a, b, 0) of
    different parts, and the rows (key, v, n) of keys with more than ``block`` rows."""
    keys = 1 if block else 3

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_keys(batches, keys):
            v, fp, one, two, few, part = cols[keys:]
            for start, n in zip(*_edges(cols[:keys])):
                at = slice(start, start + n)
                if block and n > block:
                    yield _batch("a b n", cols[0][at], v[at], np.full(n, n))
                elif (part[at] != part[start]).any():
                    for a, b, _ in _near_pairs(fp[at], one[at], two[at], few[at].astype(bool), distance, apart):
                        other = part[at][a] != part[at][b]
                        if other.any():
                            yield _batch("a b n", v[at][a[other]], v[at][b[other]], np.zeros(int(other.sum()), np.int64))

    return run


def _similar(shingle: int, seed: int, similarity: float):
    """Of rows (a, b, x, y) the pairs (a, b) whose texts x and y are similar enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "x", _CHUNK):
                x, xb = shingle_hashes(*buffers(part.column(2)), shingle, seed)
                y, yb = shingle_hashes(*buffers(part.column(3)), shingle, seed)
                ok = []
                for i in range(part.num_rows):
                    p, q = np.unique(x[xb[i] : xb[i + 1]]), np.unique(y[yb[i] : yb[i + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(both >= similarity * (len(p) + len(q) - both))
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return run


def _verified(texts: DataFrame, own: DataFrame, links: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """Those of the links (a, b) between rows v of ``own`` whose texts are similar enough."""
    # The text that stands for a fingerprint is shuffled only if it has a candidate.
    ends = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).distinct()
    wanted = materialize(own.join(ends, "v").select("first.doc", "first.tkey", "v"), "simhash-wanted")
    near, _ = bloom.split(texts.select("doc", "tkey", "text"), bloom.of_docs(wanted))
    found = materialize(near.join(wanted, ["doc", "tkey"]).dropDuplicates(["v"]).select("v", "text"), "simhash-texts")
    left, right = found.select(F.col("v").alias("a"), F.col("text").alias("x")), found.select(F.col("v").alias("b"), F.col("text").alias("y"))
    sure = links.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar(shingle, seed, similarity), "a long, b long")
    return materialize(sure, "simhash-verified")


def similar_names(texts: DataFrame, *, shingle: int, seed: int, similarity: float, distance: int, segments: int, block: int, apart: int = _BINS) -> tuple[DataFrame, DataFrame]:
    """(doc, tkey, v) and (v, component_id) of texts (doc, tkey, text): v numbers distinct fingerprints with
    their sketches, component_id is the smallest doc of what verified links connect."""
    if distance >= 2 * segments:
        raise ValueError("some segment must differ by at most one bit: distance < 2 * segments")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                h, begin = shingle_hashes(*buffers(part.column(2)), shingle, seed)
                one, two, n = sketches(h, begin)
                cols = [majority(h, begin).view(np.int64), one.view(np.int64), two.view(np.int64), (n < _FEW).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], ["doc", "tkey", *_NEAR[1:]])

    rows = materialize(texts.select("doc", "tkey", "text").mapInArrow(run, "doc long, tkey long, fp long, one long, two long, few long"), "simhash-fp")
    own = rows.groupBy(*_NEAR[1:]).agg(F.min(F.struct("doc", "tkey")).alias("first"))
    own = materialize(own.withColumn("v", F.monotonically_increasing_id()), "simhash-distinct")
    keys = variants(own, segments, "v", *_NEAR[2:]).select("key", *_NEAR).repartition("key").sortWithinPartitions("key", "v")
    first = materialize(keys.mapInArrow(_near(distance, apart, block), _LINKS).distinct(), "simhash-near")
    large = first.where("n > 0").select(F.col("a").alias("key"), "n", F.col("b").alias("v")).join(own.select(*_NEAR), "v")
    second = in_blocks(large, block, *_NEAR).mapInArrow(_near_blocks(distance, apart), "a long, b long")
    links = materialize(first.where("n = 0").select("a", "b").unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-candidates")
    sure = _verified(texts, own, links, shingle, seed, similarity)
    comp = components(sure, "simhash-first")
    # What the verified links leave apart: every near pair between two of their components that was not looked at.
    parts = own.join(comp, own.v == comp.id, "left").select(*_NEAR, F.coalesce("component", "v").alias("part"))
    parts = materialize(parts, "simhash-parts")
    keys = variants(parts, segments, "v", *_NEAR[2:], "part").select("key", *_NEAR, "part").repartition("key").sortWithinPartitions("key", "v")
    rest = materialize(keys.mapInArrow(_between(distance, apart, block), _LINKS).distinct(), "simhash-between")
    large = rest.where("n > 0").select(F.col("a").alias("key"), "n", F.col("b").alias("v")).join(parts, "v")
    blocks = in_blocks(large, block, *_NEAR, "part").mapInArrow(_between(distance, apart), _LINKS)
    rest = rest.where("n = 0").unionByName(blocks).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(rest.join(links, ["a", "b"], "left_anti"), "simhash-rest")
    if not rest.isEmpty():
        sure = sure.unionByName(_verified(texts, own, rest, shingle, seed, similarity))
        comp = components(sure, "simhash-components")
    named = own.join(comp, own.v == comp.id, "left").select("v", *_NEAR[1:], F.col("first.doc").alias("doc"), F.coalesce("component", "v").alias("component"))
    named = materialize(named, "simhash-named")
    least = materialize(named.groupBy("component").agg(F.min("doc").alias("component_id")), "simhash-least")
    told = materialize(named.join(least, "component").select("v", *_NEAR[1:], "component_id"), "simhash-told")
    return rows.join(told.select("v", *_NEAR[1:]), _NEAR[1:]).select("doc", "tkey", "v"), told.select("v", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 4, seed: int = 42, distance: int = 4, segments: int = 3, block: int = 2048, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component left, the one of smallest doc_id; all columns stay.

    With ``similarity`` only links of texts at least as similar count. Ties of doc_id go to the smaller
    hash of the text, fully repeated rows become one, and a null doc_id comes last. Texts are shuffled
    only for documents that may go.
    """
    doc, tkey = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey")
    texts = docs.select(doc, tkey, "text")
    if similarity is None:
        rows = materialize(fingerprints(texts, shingle=shingle, seed=seed).select("doc", "tkey", "fp"), "simhash-fp")
        names = component_names(rows.withColumnRenamed("doc", "doc_id"), distance=distance, segments=segments, block=block)
        named = rows.join(names, "fp").select("doc", "tkey", F.col("component_id").alias("least"))
    else:
        rows, names = similar_names(texts, shingle=shingle, seed=seed, similarity=similarity, distance=distance, segments=segments, block=block)
        named = rows.join(names, "v").select("doc", "tkey", F.col("component_id").alias("least"))
    # The name of a component is its smallest id; among its rows of that id the smallest hash stays.
    best = named.where("doc = least").groupBy("least").agg(F.min("tkey").alias("best"))
    told = named.groupBy("doc", "tkey", "least").agg(F.count(F.lit(1)).alias("n")).join(materialize(best, "simhash-best"), "least")
    stays = (F.col("doc") == F.col("least")) & (F.col("tkey") == F.col("best"))
    moved = materialize(told.where(~stays | (F.col("n") > 1)).select("doc", "tkey", stays.alias("stays")), "simhash-gone")
    packed = docs.select(doc, tkey, F.struct(*docs.columns).alias("row"))
    near, sure = bloom.split(packed, bloom.of_docs(moved))
    near = near.join(moved, ["doc", "tkey"], "left")
    once = near.where("stays").dropDuplicates(["doc", "tkey"])
    left = near.where("stays is null").select("doc", "tkey", "row").unionByName(once.select("doc", "tkey", "row"))
    return sure.unionByName(left).select("row.*")
