"""How far the sources of a language differ in their words: an audit by iceberg prefix refinement.

Terms that few documents have must not be counted one by one to be thrown away: in a large corpus they
are most of all terms. Documents are counted for byte prefixes first, level by level (4, 8, 16, ...
bytes). A prefix that fewer than ``least`` documents of a language have can't begin a term that more
have, so it is discarded with all that it begins; what is left is extended on the next level, until no
prefix is left to extend. A term that ends on a level is complete there: its documents and, by source,
its occurrences are counted exactly.

A document lies in one row, so documents of a prefix and occurrences of a term add up over tasks: a
task sends one row for what all documents of a batch have in common, and Spark's aggregation combines
them. Prefixes that survive are sent to the next level as a Bloom filter of bounded size; what it lets
through by chance is counted once more and falls below the threshold, so the result is exact.

With the kept terms known, every group (language, source) has the smoothed frequency
p = 1 + floor(scale * (count + 1) / (N + V)) of every term, in exact arithmetic, and the divergence of p
from q adds up f = floor((p - q)^2 / q). Most terms do not occur in most sources, so the sum over all
terms is taken apart: terms that neither group has (all equal), terms that one has (by how often each
count occurs in it), and a correction for the terms that both have, from the list of a term's sources.
No row is made for a pair of sources and a term.

Defined cases: null texts, languages and sources count as ''; a group without terms, or whose language
keeps none, still has its pairs (value 0 where no term is kept); rows repeated with one doc_id are
separate documents; very long texts and terms are taken whole; an empty table gives no rows; extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import _ODD, buffers, chunks, flat_ranges, kinds, materialize, mix, tidy, word_hashes, word_spans

# Bytes of terms: letters of ASCII and all of other characters.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_PIECE = 4 << 20
_FIRST_LEVEL = 4  # bytes; doubled on every level
_PAIRS = 1 << 20  # pairs of entries that are worked on at once


def _gathered(raw: np.ndarray, starts: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Byte ranges as an Arrow column."""
    off = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(off), pa.py_buffer(raw[flat_ranges(starts, size)])])


@tidy
def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, the distinct terms of each document in one string, and their counts as 32-bit numbers."""
    for batch in batches:
        for part in chunks(batch, "text", _PIECE):
            raw, off = buffers(part.column(2))
            raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)
            starts, ends, first = word_spans(raw, off, _TERM)
            text = np.repeat(np.arange(part.num_rows), np.diff(np.append(first[:-1], len(starts))))
            own, kind = kinds(raw, starts, ends, mix(word_hashes(raw, starts, ends, 12) + text.astype(np.uint64) * _ODD))
            n = np.bincount(kind, minlength=len(own))
            order = np.argsort(own)
            own, n = own[order], n[order]
            at = np.searchsorted(text[own], np.arange(part.num_rows + 1))
            # A space stands behind every term.
            size = (ends - starts)[own] + 1
            joined = np.full(int(size.sum()), 0x20, np.uint8)
            lead = np.append(0, np.cumsum(size))
            joined[flat_ranges(lead[:-1], size - 1)] = raw[flat_ranges(starts[own], size - 1)]
            terms = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(lead[at].astype(np.int32)), pa.py_buffer(joined)])
            counts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(n.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms, counts], ["lang", "source", "text", "counts"])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _prefix_keys(lang: np.ndarray, langs: pa.Array, prefix_hashes: np.ndarray) -> np.ndarray:
    """64-bit keys of (language, prefix) for the Bloom filter."""
    from xxhash import xxh3_64_intdigest

    own = np.array([xxh3_64_intdigest(x) for x in langs.to_pylist()], np.uint64)
    return mix(prefix_hashes + own[lang] * _ODD)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, length, document) of every listed term."""
    raw, off = buffers(column)
    ends = np.flatnonzero(raw == 0x20)
    starts = np.append(0, ends + 1)[: len(ends)]
    return raw, starts, ends - starts, np.searchsorted(off, starts, "right") - 1


def _level(length: int, sent):
    """Rows of one level: what is complete at ``length`` bytes, and the prefixes that go on."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _PIECE):
                raw, starts, size, doc = _listed(part.column(1))
                lang, langs = _codes(part.column(0))
                at = np.flatnonzero(size > (0 if sent is None else length // 2))
                if sent is not None and len(at):
                    at = at[sent.value.may_hold(_prefix_keys(lang[doc[at]], langs, word_hashes(raw, starts[at], starts[at] + length // 2, 12)))]
                starts, doc, goes_on = starts[at], doc[at], size[at] > length
                ends = starts + np.minimum(size[at], length)
                hashes = word_hashes(raw, starts, ends, 12)
                # A prefix counts once for a document, however many of its terms begin with it.
                once = np.flatnonzero(~goes_on)
                more = np.flatnonzero(goes_on)
                own, _ = kinds(raw, starts[more], ends[more], mix(hashes[more] + doc[more].astype(np.uint64) * _ODD))
                for found, is_open in ((once, False), (more[own], True)):
                    group = lang[doc[found]].astype(np.uint64)
                    own, kind = kinds(raw, starts[found], ends[found], mix(hashes[found] + group * _ODD))
                    docs = np.bincount(kind, minlength=len(own))
                    own = found[own]
                    term = _gathered(raw, starts[own], (ends - starts)[own], pa.binary())
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[doc[own]])), term, pa.array(np.full(len(own), is_open)), pa.array(docs)], ["lang", "term", "is_open", "docs"])

    return run


def _counts(sent):
    """lang, source, term, n of what the filter of kept terms may hold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _PIECE):
                raw, starts, size, doc = _listed(part.column(2))
                n = np.frombuffer(buffers(part.column(3))[0].tobytes(), "<i4").astype(np.int64)
                (lang, langs), (source, sources) = _codes(part.column(0)), _codes(part.column(1))
                hashes = word_hashes(raw, starts, starts + size, 12)
                at = np.flatnonzero(sent.value.may_hold(_prefix_keys(lang[doc], langs, hashes)))
                doc, starts, size = doc[at], starts[at], size[at]
                group = (lang[doc] * len(sources) + source[doc]).astype(np.uint64)
                own, kind = kinds(raw, starts, starts + size, mix(hashes[at] + group * _ODD))
                total = np.zeros(len(own), np.int64)
                np.add.at(total, kind, n[at])
                term = _gathered(raw, starts[own], size[own], pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[doc[own]])), sources.take(pa.array(source[doc[own]])), term, pa.array(total)], ["lang", "source", "term", "n"])

    return run


@tidy
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers(batch.column(1))
        lang, langs = _codes(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(_prefix_keys(lang, langs, word_hashes(raw, off[:-1], off[1:], 12)).view(np.int64))], ["key"])


def _filter(terms: DataFrame):
    """Broadcast Bloom filter (32 MB at most) of lang and term."""
    return terms.sparkSession.sparkContext.broadcast(bloom.build(terms.select("lang", "term").mapInArrow(_keys, "key long")))


def kept_terms(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source; terms: lang, source, term, n, lang_n) of the terms that at least ``least``
    documents of their language have. ``docs`` has lang, source and text without nulls."""
    listed = materialize(docs.select("lang", "source", "text").mapInArrow(_terms, "lang string, source string, text string, counts binary"), "divergence-terms")
    groups = materialize(listed.select("lang", "source").distinct(), "divergence-groups")
    length, sent, complete = _FIRST_LEVEL, None, []
    while True:
        rows = listed.select("lang", "text").mapInArrow(_level(length, sent), "lang string, term binary, is_open boolean, docs long")
        # What is below the threshold is discarded with all that it begins.
        level = materialize(rows.groupBy("lang", "term", "is_open").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least), "divergence-level")
        complete.append(level.where("NOT is_open"))
        alive = level.where("is_open")
        if alive.isEmpty():
            break
        sent = _filter(alive)
        length *= 2
    kept = reduce(DataFrame.unionByName, complete).select("lang", F.col("term").cast("string").alias("term"))
    counted = listed.mapInArrow(_counts(_filter(kept)), "lang string, source string, term string, n long")
    counted = materialize(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")), "divergence-counts")
    totals = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(kept, ["lang", "term"])
    return groups, materialize(counted.join(totals, ["lang", "term"]), "divergence-kept")


def share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + terms)), exactly; 1 where there are no terms."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))


def added(p: Column, q: Column) -> Column:
    """What a term adds to the divergence of p from q."""
    return F.call_function("div", (p - q) * (p - q), q)


@tidy
def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the terms of a batch: what it changes that both groups of a pair have a term, summed by pair.

    Entries of a term hold a group's number, its p, and its p of terms that it lacks.
    """
    for batch in batches:
        lists = batch.column(0)
        entry = lists.flatten()
        group, p, p0 = (entry.field(i).to_numpy() for i in range(3))
        groups, own = np.unique(group, return_inverse=True)
        size = pc.list_value_length(lists).to_numpy()
        first = np.cumsum(size) - size
        mine = np.repeat(np.arange(len(size)), size)
        upto = np.cumsum(size[mine])  # pairs up to each entry
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            a = np.repeat(np.arange(at, to), size[mine[at:to]])
            b = flat_ranges(first[mine[at:to]], size[mine[at:to]])
            at = to
            pa_, pb, qa, qb = p[a], p[b], p0[a], p0[b]
            value = _f(pa_, pb) - _f(pa_, qb) - _f(qa, pb) + _f(qa, qb)
            pair, kind = np.unique(own[a] * len(groups) + own[b], return_inverse=True) if len(groups) > 1000 else (np.arange(len(groups) ** 2), own[a] * len(groups) + own[b])
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, kind, value)
            a, b = groups[pair // len(groups)], groups[pair % len(groups)]
            apart = (a != b) & (total != 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart]), pa.array(total[apart])], ["a", "b", "value"])


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def source_divergence(docs: DataFrame, *, least: int = 3, top: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source), as part ``pair`` the divergence from
    each other source of the language, as part ``term`` the ``top`` terms that are more frequent in it
    than in the language, both from the greatest value down."""
    if not 0 < scale <= 1_000_000_000:
        raise ValueError("scale must be between 1 and 10**9, so that squares fit 64 bits")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, terms = kept_terms(texts, least)
    per_lang = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    p0 = share(F.lit(0).cast("long"), F.col("total"), F.col("v"), scale)
    groups = materialize(groups.select("lang", "source", "total", "v", "lang_total", p0.alias("p0"), F.monotonically_increasing_id().alias("g")), "divergence-totals")
    p, q = share(F.col("n"), F.col("total"), F.col("v"), scale), share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale)
    entries = materialize(terms.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", p.alias("p"), "p0", q.alias("q")), "divergence-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), added(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # Every other source of the language: what a pair has by its totals alone, ...
    own, theirs = F.col("p0"), F.col("their_p0")
    one = groups.select("lang", F.col("g").alias("a"), "p0", "v")
    other = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("their_p0"))
    base = one.join(other, "lang").where("a != b").select("a", "b", F.when(F.col("v") > 0, F.col("v") * added(own, theirs)).otherwise(0).alias("value"))
    # ... by the terms that one of them has (a row for each frequency, not for each term), ...
    counts = entries.groupBy("lang", F.col("g").alias("a"), "p0", "p").agg(F.count(F.lit(1)).alias("c"))
    sides = counts.join(other, "lang").where("a != b").groupBy("a", "b")
    sides = sides.agg(F.sum(F.col("c") * (added(F.col("p"), theirs) - added(own, theirs))).alias("gain"), F.sum(F.col("c") * (added(theirs, F.col("p")) - added(theirs, own))).alias("loss"))
    sides = sides.select(F.inline(F.array(F.struct("a", "b", F.col("gain").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("loss").alias("value")))))
    # ... and by those that both have.
    shared = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
    both = shared.select("entries").mapInArrow(_both, "a long, b long, value long")
    pairs = base.unionByName(sides).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = pairs.join(groups.select(F.col("g").alias("a"), "lang", "source"), "a").join(groups.select(F.col("g").alias("b"), F.col("source").alias("item")), "b")
    named = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return named.unionByName(over)
