"""Fuzzy line dedup by MinHash: one line stays of each component of similar lines.

Lines (split at line feeds, trimmed, lower-cased A-Z; those below ``min_chars`` are left alone)
are compared as sets of ``shingle`` characters. A line shorter than a shingle is one whole
shingle, so it is similar to equal lines only; equal lines meet by their hash and need no bands.
The query and the pipeline compare every line that is not empty (``min_chars=1``).

1. Every line gets a MinHash signature by one-permutation hashing: each shingle is hashed once,
   falls into one of bands * rows bins and the smallest hash per bin counts; an empty bin takes
   the value of another one in a fixed random order. Lines whose bins agree over a whole band
   meet in a bucket. With 14 bands of 4 a pair at similarity 0.8 is found with probability
   0.9993, at 0.9 with more than 0.99999.
2. A sketch (the lowest bit of each of up to 63 bins, 56 by default) travels along. In a bucket, lines stay only
   if another one's sketch differs in at most ``apart`` bits; at similarity 0.8 it differs in
   about 6. Lines with few shingles, whose bins depend on each other, always stay.
3. Candidates are verified by exact Jaccard similarity of their shingle sets. In each bucket
   all lines are first compared with the most frequent one. Then every other pair of the bucket that
   is not yet in one component is compared too, inside the task by bitmaps that bound the similarity
   and then exactly, which returns links between components only: pairs inside a component can't change it, so the
   result is that of comparing all pairs, without making a list of them. Large buckets are
   compared block by block.
4. Distributed union-find over the verified links; the first line of each component, by
   (doc_id, line number), stays.

Equal lines are one candidate, so very common lines cost nothing: a task sends each once. The
text itself is shuffled only for candidate lines: a Bloom filter of bounded size keeps the others
back. What is aggregated is read back from a table before a join, so that Spark can split the
other side at a line that is in a third of all documents.

Defined cases: a null text has no lines and stays null; empty lines and those below ``min_chars`` stay; documents
all of whose lines go stay as rows with empty text; a row with a null doc_id comes after all
others in the order; fully repeated rows share one outcome; very long lines are compared whole; an
empty table gives no rows; other columns are untouched. Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import NO_ID, chunks, materialize, mix, tidy
from .components import components

_CHUNK = 1 << 20


def _lines(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """Line number and normalised line of the lines that are compared."""
    if text is None:
        return []
    return [(i, s) for i, raw in enumerate(_fold(text).split("\n")) if len(s := raw.strip()) >= min_chars]


def _fold(text: str) -> str:
    """A-Z in lower case: on bytes, where nothing else has case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def line_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each line, as two columns."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join([xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in lines]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


_BYTE = np.uint64(8)


def shingle_codes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For every shingle of every line: the line's index and a 64-bit code.

    Up to eight characters below 256 are packed into the code as they are; others are scrambled in.
    """
    size = np.array([len(s) for s in lines], np.int64)
    text = "".join(lines)
    n = len(text)
    if shingle <= 8 and (raw := _latin(text)) is not None:
        code = np.ndarray((n,), "<u8", np.frombuffer(raw + bytes(8), np.uint8), strides=(1,)) & np.uint64((1 << 8 * shingle) - 1)
    else:
        char = np.zeros(n + shingle, np.uint64)
        char[:n] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        code, rest = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(shingle):
            if j < 8:
                code |= (char[j : n + j] & np.uint64(255)) << np.uint64(8 * j)
                over = char[j : n + j] >> _BYTE
            else:
                over = char[j : n + j]
            rest = mix(rest * np.uint64(0x100000001B3) + over) if over.any() or rest.any() else rest
        code ^= rest
    count = np.maximum(size - shingle + 1, 0)
    line = np.repeat(np.arange(len(lines)), count)
    at = np.arange(len(line)) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)
    return line, code[at]


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


_EMPTY = np.uint32(0xFFFFFFFF)
_FEW = 60  # shingles; below, bins are not independent enough for a sketch


@lru_cache(maxsize=4)
def _fill_order(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a value at others."""
    return np.array([np.random.default_rng(i).permutation(bins) for i in range(bins)])


def signatures(lines: list[str], shingle: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of each line of at least one shingle (lines x bins), all bins filled, and whether
    the line has few shingles."""
    line, h = shingle_codes(lines, shingle)
    few = np.bincount(line, minlength=len(lines)) < _FEW
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    line *= bins
    line += ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    flat = np.full(len(lines) * bins, _EMPTY, np.uint32)
    np.minimum.at(flat, line, np.minimum(h.astype(np.uint32), _EMPTY - np.uint32(1)))
    sig = flat.reshape(len(lines), bins)
    own, order = sig.copy(), _fill_order(bins)
    row, col = np.nonzero(sig == _EMPTY)
    for step in range(bins):
        if not len(row):
            break
        value = own[row, order[col, step]]
        ok = value != _EMPTY
        sig[row[ok], col[ok]] = value[ok]
        row, col = row[~ok], col[~ok]
    return sig, few


_FLAG = np.uint64(1 << 63)  # of a sketch: the line has few shingles


def sketches(sig: np.ndarray, few: np.ndarray) -> np.ndarray:
    """The lowest bits of up to 63 bins, and the flag of lines with few shingles."""
    out = np.where(few, _FLAG, np.uint64(0))
    for i in range(min(63, sig.shape[1])):
        out |= (sig[:, i].astype(np.uint64) & np.uint64(1)) << np.uint64(i)
    return out


def alike(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """Whether two sketches allow for similar lines."""
    differ = np.bitwise_count((a ^ b) & ~_FLAG)
    return (differ <= apart) | ((a | b) & _FLAG).astype(bool)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for every band of every signature (lines x bands)."""
    part = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for i in range(rows):
        key = mix(key ^ part[:, :, i] + np.uint64(i) * np.uint64(0x165667B19E3779F9))
    return key


def shingle_set(line: str, shingle: int) -> set[str]:
    return {line[i : i + shingle] for i in range(max(1, len(line) - shingle + 1))}


def similar(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def jaccard(a: str, b: str, shingle: int) -> float:
    """Exact similarity of two lines as sets of shingles."""
    return similar(shingle_set(a, shingle), shingle_set(b, shingle))


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


_INDEX = "doc long, tkey long, line_no int, id long, id2 long"


def _index(min_chars: int):
    """(doc, tkey, line_no, id, id2) for every compared line, and a row with line_no -1 for every
    document, whose id is the number of its compared lines."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                found = [_lines(text, min_chars) for text in part.column(2).to_pylist()]
                size = np.array([len(own) for own in found])
                at = pa.array(np.repeat(np.arange(len(size)), size))
                id1, id2 = line_ids([s for own in found for _, s in own])
                number = np.array([i for own in found for i, _ in own], np.int32)
                yield _batch("doc tkey line_no id id2", part.column(0).take(at), part.column(1).take(at), number, id1, id2)
                yield _batch("doc tkey line_no id id2", part.column(0), part.column(1), np.full(len(size), -1, np.int32), size.astype(np.int64), np.zeros(len(size), np.int64))

    return run


_KEYS = "key long, id long, sketch long"
_TOLD = 300_000  # lines that a task remembers as told


def _bands(min_chars: int, shingle: int, bands: int, rows: int):
    """(key, id, sketch) for every band of the lines of a task, equal lines once as far as it
    remembers; none for lines below a shingle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                lines = list({s: None for text in part.column(2).to_pylist() for _, s in _lines(text, max(min_chars, shingle))})
                if not lines:
                    continue
                ids = line_ids(lines)[0]
                new = [i for i, x in enumerate(ids.tolist()) if x not in told]
                if len(told) > _TOLD:
                    told.clear()
                told.update(ids[new].tolist())
                if new:
                    sig, few = signatures([lines[i] for i in new], shingle, bands * rows)
                    key = band_keys(sig, bands, rows)
                    yield _batch("key id sketch", key.ravel().view(np.int64), np.repeat(ids[new], bands), np.repeat(sketches(sig, few).view(np.int64), bands))

    return run


def _buckets(apart: int, block: int):
    """Of (key, id, sketch) rows sorted by key, the distinct ones with another line in their
    key that the sketches allow to be similar. Keys beyond ``block`` lines stay as they are."""

    def told(key: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = np.append(True, key[1:] != key[:-1])
        more = np.flatnonzero(~lead | ~np.append(lead[1:], True))  # most keys have a single row
        if not len(more):
            return
        more = more[np.lexsort((own[more], key[more]))]
        key, own, sketch = key[more], own[more], sketch[more].view(np.uint64)
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        key, own, sketch = key[new], own[new], sketch[new]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        ok = np.repeat(size > block, size)
        few = np.flatnonzero(np.repeat((size > 1) & (size <= 16), size))
        k, x = key[few], sketch[few]
        for gap in range(1, int(size[size <= 16].max(initial=1))):
            near = np.flatnonzero(k[gap:] == k[:-gap])
            near = near[alike(x[near], x[near + gap], apart)]
            ok[few[near]] = ok[few[near + gap]] = True
        for start, n in zip(edge[(size > 16) & (size <= block)].tolist(), size[(size > 16) & (size <= block)].tolist()):
            mine = sketch[start : start + n]
            for i in range(0, n, 64):
                near = alike(mine[i : i + 64, None], mine[None, :], apart)
                near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                ok[start + i : start + i + len(near)] = near.any(1)
        if ok.any():
            yield _batch("key id sketch", key[ok], own[ok], sketch[ok].view(np.int64))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy() for i in range(3)])
            if held[0][0][0] != held[-1][0][-1]:  # at least one key has ended
                cols = [np.concatenate(x) for x in zip(*held)]
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                yield from told(*(c[:last] for c in cols))
                held = [[c[last:] for c in cols]]
            elif sum(len(x[0]) for x in held) > 1 << 20:  # a line that very many tasks have sent
                cols = [np.concatenate(x) for x in zip(*held)]
                new = np.unique(cols[1], return_index=True)[1]
                held = [[c[new] for c in cols]]
        if held:
            yield from told(*(np.concatenate(x) for x in zip(*held)))

    return run


def _texts(min_chars: int, sent):
    """(id, id2, line, n) of candidate lines (and a few others that the filter lets through); n counts a chunk's."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                seen = Counter(s for text in part.column(2).to_pylist() for _, s in _lines(text, min_chars))
                if seen:
                    lines = list(seen)
                    id1, id2 = line_ids(lines)
                    at = np.flatnonzero(found.may_hold(id1))
                    yield _batch("id id2 line n", id1[at], id2[at], pa.array([lines[i] for i in at], pa.string()), pa.array([seen[lines[i]] for i in at], pa.int64()))

    return run


class _Sets:
    """Shingle sets of some lines: sorted codes, and bitmaps that bound how many two sets share.

    A shared shingle sets a bit of both bitmaps; of the smaller set's shingles at most as many as have no bit of
    their own come on top. So ``near`` loses no similar pair, and ``similar`` counts those it lets through.
    """

    def __init__(self, lines: list[str], shingle: int):
        line, code = shingle_codes(lines, shingle)
        at = np.append(0, np.cumsum(np.bincount(line, minlength=len(lines))))
        for i in range(len(lines)):
            code[at[i] : at[i + 1]].sort()
        new = np.append(True, (code[1:] != code[:-1]) | (line[1:] != line[:-1]))[: len(code)]
        line, code = line[new], code[new]
        self.size = np.bincount(line, minlength=len(lines))
        self.codes = np.split(code, np.cumsum(self.size)[:-1])
        most = max(64, min(int(self.size.max(initial=1)) * 16, _BITMAPS * 8 // len(lines)))
        power = most.bit_length() - 1
        slot = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - power)).astype(np.int64)
        flags = np.zeros((len(lines), 1 << power), bool)
        flags.ravel()[line * (1 << power) + slot] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)
        self.spare = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def near(self, a, b, similarity: float) -> np.ndarray:
        """Which of the pairs (a, b) can be similar enough."""
        both = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype=np.int64) + np.minimum(self.spare[a], self.spare[b])
        both = np.minimum(both, np.minimum(self.size[a], self.size[b]))
        return both + 1e-6 >= similarity * (self.size[a] + self.size[b] - both)

    def similar(self, a: int, b: int) -> float:
        """Exact similarity of two lines."""
        met = np.concatenate([self.codes[a], self.codes[b]])
        met.sort()
        both = int(np.count_nonzero(met[1:] == met[:-1]))
        return both / (len(met) - both)


_BITMAPS = 4 << 20  # bytes of the bitmaps of a group or batch


def _verified(pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of line numbers whose lines are similar enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "x", _CHUNK):
                a, b = (part.column(i).to_numpy() for i in range(2))
                new = np.append(True, b[1:] != b[:-1])  # pairs come ordered by b
                heads = part.column(3).take(pa.array(np.flatnonzero(new))).to_pylist()
                sets = _Sets(part.column(2).to_pylist() + heads, shingle)
                x, y = np.arange(len(a)), len(a) + np.cumsum(new) - 1
                near = np.flatnonzero(sets.near(x, y, similarity))
                ok = np.array([i for i in near.tolist() if sets.similar(i, int(y[i])) >= similarity], np.int64)
                yield _batch("a b", a[ok], b[ok])

    left = lines.select(F.col("v").alias("a"), F.col("line").alias("x"))
    right = lines.select(F.col("v").alias("b"), F.col("line").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def group_links(ids: list[int], comps: list[int], lines: list[str], shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of similar lines of one group: every pair whose components
    still differ is compared, first by the bound of bitmaps, then exactly."""
    sets, root, out = _Sets(lines, shingle), np.array(comps, np.int64), []

    def take(pairs):
        for i, j in pairs:
            if root[j] != root[i] and sets.similar(i, j) >= similarity:
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]

    if len(lines) * sets.bits.nbytes <= _BITMAPS:  # all pairs at once
        a, b = np.nonzero(np.triu(root[:, None] != root))
        ok = sets.near(a, b, similarity)
        take(zip(a[ok].tolist(), b[ok].tolist()))
        return out
    for i in range(len(lines) - 1):
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if len(others):
            take((i, j) for j in others[sets.near(i, others, similarity)].tolist())
    return out


def _across(shingle: int, similarity: float):
    """Of rows (key, lo, hi, id, component, line) sorted by the first three, links between components of a group."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told():
            links = group_links(*zip(*held), shingle, similarity) if len({x[1] for x in held}) > 1 else []
            return _batch("a b", pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64()))

        for batch in batches:
            for *k, i, c, text in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if k != key:
                    if held:
                        yield told()
                    key, held = k, []
                held.append((i, c, text))
        if held:
            yield told()

    return run


def line_components(texts: DataFrame, *, min_chars: int, shingle: int, similarity: float, bands: int, rows: int, apart: int = 18, block: int = 1024) -> DataFrame:
    """(id, id2, component) of the lines that have a similar one. ``texts``: doc, tkey, text."""
    keys = texts.mapInArrow(_bands(min_chars, shingle, bands, rows), _KEYS)
    shared = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(apart, block), _KEYS).select("key", "id"), "line-buckets")
    wanted = materialize(shared.select("id").distinct(), "line-candidates")
    sent = texts.sparkSession.sparkContext.broadcast(bloom.build(wanted))
    lines = texts.mapInArrow(_texts(max(min_chars, shingle), sent), "id long, id2 long, line string, n long").join(wanted, "id", "left_semi")
    lines = lines.groupBy("id", "id2").agg(F.min("line").alias("line"), F.sum("n").alias("n")).withColumn("v", F.monotonically_increasing_id())
    lines = materialize(lines, "line-texts")
    shared = materialize(shared.join(lines.select("id", "v", "n"), "id").select("key", "v", "n"), "line-bucket-lines")
    heads = materialize(shared.groupBy("key").agg(F.max(F.struct("n", "v")).alias("head")).select("key", F.col("head.v").alias("head")), "line-heads")
    spokes = materialize(shared.join(heads, "key").where("v <> head").select("key", "v", "head"), "line-spokes")
    star = spokes.select(F.col("v").alias("a"), F.col("head").alias("b")).distinct()
    first = materialize(_verified(star, lines, shingle, similarity), "line-links")
    comp = components(first, "line-components").select(F.col("id").alias("v"), "component")
    # What is left of a bucket are the pairs without its head.
    known = materialize(spokes.join(comp, "v", "left").select("key", "v", F.coalesce("component", "v").alias("component")), "line-known")
    mixed = known.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("same"), F.min("v").alias("least"), F.max("v").alias("most")
    ).where("lo <> hi")
    # Similar lines share many bands; buckets of the same lines are compared once.
    mixed = mixed.groupBy("n", "same", "least", "most").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rest = known.join(materialize(mixed, "line-mixed"), "key").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    # A large bucket is compared block by block: a group holds two blocks, and each pair of blocks is a group.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "v", "component").join(lines.select("v", "line"), "v")
    rest = rest.select("key", "lo", "hi", "v", "component", "line").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "v")
    more = materialize(rest.mapInArrow(_across(shingle, similarity), "a long, b long").distinct(), "line-links")
    comp = components(first.unionByName(more), "line-components").select(F.col("id").alias("v"), "component")
    return materialize(lines.select("v", "id", "id2").join(comp, "v").select("id", "id2", "component"), "line-named")


def duplicate_lines(docs: DataFrame, *, min_chars: int = 1, shingle: int = 6, similarity: float = 0.8, bands: int = 14, rows: int = 4) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, tkey (hash of the text), n_compared, removed.

    ``removed`` lists, in order, the numbers (from 0) of the lines that go.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tkey"), F.col("text"))
    lines = materialize(texts.mapInArrow(_index(min_chars), _INDEX), "lines")
    comp = line_components(texts, min_chars=min_chars, shingle=shingle, similarity=similarity, bands=bands, rows=rows)
    # A line's name is its component (null, number) or, without one, its own 128 bits.
    own = F.col("component").isNull()
    named = lines.where("line_no >= 0").join(comp, ["id", "id2"], "left")
    named = named.select("doc", "tkey", "line_no", F.when(own, F.col("id2")).alias("c2"), F.when(own, F.col("id")).otherwise(F.col("component")).alias("c1"), own.alias("alone"))
    place = F.struct("doc", "tkey", "line_no")
    name = ["c1", "c2", "alone"]
    named = named.withColumn("c2", F.coalesce("c2", F.lit(0)))
    first = materialize(named.groupBy(name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*name, "first"), "line-first")
    gone = named.join(first, name).where(place != F.col("first")).groupBy("doc", "tkey").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    each = lines.where("line_no < 0").select("doc", "tkey", F.col("id").alias("n_compared")).distinct()
    told = each.join(gone, ["doc", "tkey"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return told.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "tkey", "n_compared", "removed")


def line_dedup(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text``; all columns and rows stay.

    ``n_chars`` follows the text where there is such a column.
    """
    found = materialize(duplicate_lines(docs, **settings).where(F.size("removed") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "tkey", "removed"), "line-removed")
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tkey"), F.struct(*docs.columns).alias("row"))
    near, same = bloom.split(packed, bloom.of_docs(found))
    out = near.join(found, ["doc", "tkey"], "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    length = {"n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in docs.columns else {}
    cols = {"text": text} | length
    cut = out.select(*[cols.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return same.select("row.*").unionByName(cut)
