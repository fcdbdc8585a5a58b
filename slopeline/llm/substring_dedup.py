"""Substring dedup by De Bruijn compaction.

The runs of ``window`` words of all texts are the edges of a De Bruijn graph. An edge that also
starts in a document with a smaller id is repeated, and the words it covers go.

Writing a row per edge would multiply the text, so edges are compacted first. In each window the
k-mer of ``anchor`` words with the smallest hash is its anchor; equal windows have equal anchors.
Consecutive windows with one anchor form a path, kept as one row: the anchor, a 128-bit hash of
the path's words, and its source coordinates (document, first word, number of windows), about one
row per (window - anchor + 1) / 2 words.

1. Paths whose anchor occurs once in the corpus are unique and go no further.
2. Equal paths are joined: a path that a smaller document has too is repeated as a whole.
3. Where all documents with an anchor have one path there, it does not branch. Anchors with
   different paths are where passages begin, end or differ: the graph branches (or stops). One
   document per distinct path opens it, at every place it has it, into single edges, and equal
   edges are joined. An edge is found in the smallest document that has it, as that document has
   the smallest id of its path.
4. Repeated paths and edges of a document that follow each other, in it and in their source, are
   compacted to one long span with the coordinates of its source.
5. Spans are verified at the source coordinates: a span's words go only if their SHA-256 is that
   of the words at the source.

Words are hashed by 2 x 64 bits and runs of words by doubling with a scramble at each step, so
no arrangement of equal words cancels out. Joins are preceded by aggregation with map-side
combining, and what is aggregated is read back from a table, so that Spark can split the other
side where a passage is shared by a third of all documents; texts are shuffled only for documents
with open paths, sources or spans (a Bloom filter of fixed size keeps the others back).

Defined cases: a null text has no words; texts shorter than a window lose nothing; a row with a
null doc_id neither loses words nor takes any from others; rows repeated with one doc_id do not
count as copies of each other; very long texts and words are taken whole; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import NOT_SPACE, Runs, buffers, chunks, materialize, tidy, word_hashes, word_spans

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 2 << 20


class Words:
    """The words of a chunk of texts: spans in bytes, two hashes each, and the words of each text."""

    def __init__(self, column: pa.Array, longest: int = 0):
        """``longest``: of the runs of words that are to be hashed."""
        self.raw, self.off = buffers(column)
        self.starts, self.ends, first = word_spans(self.raw, self.off, NOT_SPACE)
        self.first = np.append(first[:-1], len(self.starts))
        self.hash = [Runs(word_hashes(self.raw, self.starts, self.ends, seed), longest) for seed in _SEEDS] if longest else []

    def runs(self, which: int, start: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` words from each start."""
        return self.hash[which].hash(start, size)

    def joined(self, start: int, end: int, raw: bytes) -> bytes:
        """The words from start to end, joined by one space."""
        return b" ".join([raw[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())])


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def paths_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, two path hashes, first word in the chunk, windows) of each compacted path."""
    n = len(words.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return (none,) * 6
    kmer = words.runs(0, np.arange(n - anchor + 1), anchor)
    ranked = (kmer & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kmer), dtype=np.uint64)
    chosen = (_slide_min(ranked, window - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.arange(n - window + 1)
    at = at[at + window <= words.first[text[at] + 1]]
    if not len(at):
        return (none,) * 6
    pick = chosen[at]
    lead = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])))
    size = np.diff(np.append(lead, len(at)))
    start = at[lead]
    path = [words.runs(which, start, size + window - 1).view(np.int64) for which in (0, 1)]
    return text[start], kmer[pick[lead]].view(np.int64), *path, start, size


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def _find_paths(window: int, anchor: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                words = Words(part.column(2), 2 * window - anchor)
                text, a, p1, p2, start, size = paths_of(words, window, anchor)
                if len(text):
                    i = pa.array(text)
                    local = start - words.first[text]
                    yield _batch("anchor p1 p2 doc tkey start n", a, p1, p2, part.column(0).take(i), part.column(1).take(i), local.astype(np.int32), size.astype(np.int32))

    return run


def _open_windows(window: int):
    """(w1, w2, doc, tkey, start) of every window of the listed paths of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                words = Words(part.column(2), window)
                lists = part.column(3).to_pylist()
                begin = np.array([p["start"] for own in lists for p in own], np.int64)
                size = np.array([p["n"] for own in lists for p in own], np.int64)
                text = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
                each = np.repeat(np.arange(len(size)), size)
                local = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                at = local + words.first[text[each]]
                i = pa.array(text[each])
                yield _batch("w1 w2 doc tkey start", words.runs(0, at, window).view(np.int64), words.runs(1, at, window).view(np.int64), part.column(0).take(i), part.column(1).take(i), local.astype(np.int32))

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))


def _cut_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sdoc, stkey, sstart, n, digest) of the listed spans (start, n) of each text."""
    for batch in batches:
        for part in chunks(batch, "text", _CHUNK):
            words = Words(part.column(2))
            raw = words.raw.tobytes()
            lists = part.column(3).to_pylist()
            text = [i for i, own in enumerate(lists) for _ in own]
            spans = [(s["start"], s["n"]) for own in lists for s in own]
            digest = [hashlib.sha256(words.joined(words.first[i] + a, words.first[i] + a + n, raw)).digest() for i, (a, n) in zip(text, spans)]
            at = pa.array(text, pa.int64())
            yield _batch("sdoc stkey sstart n digest", part.column(0).take(at), part.column(1).take(at), pa.array([a for a, _ in spans], pa.int32()), pa.array([n for _, n in spans], pa.int32()), pa.array(digest, pa.binary()))


def _with_texts(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Each (doc, tkey) of ``lists`` once, with its text and its list."""
    near, _ = bloom.split(texts.where("doc is not null"), bloom.of_docs(lists))
    return near.join(lists, ["doc", "tkey"]).dropDuplicates(["doc", "tkey"])


def repeated_spans(docs: DataFrame, *, window: int = 50, anchor: int = 20) -> DataFrame:
    """(doc, tkey, start, n, digest): spans of n words that go from each text if their digest is the source's.

    ``tkey`` is a hash of the text; it tells apart rows that share an id.
    """
    texts = _texts(docs)
    found = texts.where("doc is not null").mapInArrow(_find_paths(window, anchor), "anchor long, p1 long, p2 long, doc long, tkey long, start int, n int")
    paths = materialize(found, "paths")
    again = materialize(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "paths-anchors")
    paths = materialize(paths.join(again, "anchor", "left_semi"), "paths-again")
    path = ["anchor", "p1", "p2"]
    source = F.min(F.struct(F.col("doc").alias("sdoc"), F.col("tkey").alias("stkey"), F.col("start").alias("sstart"))).alias("source")
    owner = materialize(paths.groupBy(path).agg(source), "paths-distinct")
    words = (F.col("n") - 1 + window).cast("int").alias("n")
    whole = paths.join(owner, path).where("source.sdoc < doc").select("doc", "tkey", "start", words, "source.*")
    mixed = materialize(owner.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "paths-branching")
    # The smallest document may have the path at several places and in several texts: all are opened.
    first = owner.join(mixed, "anchor", "left_semi").select(*path, F.col("source.sdoc").alias("doc"))
    opened = paths.join(first, [*path, "doc"]).select("doc", "tkey", "start", "n").distinct()
    opened = materialize(opened.groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("paths")), "paths-open")
    once = _with_texts(texts, opened).select("doc", "tkey", "text", "paths")
    single = materialize(once.mapInArrow(_open_windows(window), "w1 long, w2 long, doc long, tkey long, start int"), "windows")
    least = single.groupBy("w1", "w2").agg(source, F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    parts = single.join(least, ["w1", "w2"]).where("source.sdoc < doc").select("doc", "tkey", "start", F.lit(window).alias("n"), "source.*")
    # Pieces that follow each other in the document and in the source become one span.
    order = Window.partitionBy("doc", "tkey", "sdoc", "stkey", "shift").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = whole.unionByName(parts).withColumn("shift", F.col("sstart") - F.col("start"))
    island = island.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(order))
    spans = island.groupBy("doc", "tkey", "sdoc", "stkey", "shift", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    spans = materialize(spans.select("doc", "tkey", "sdoc", "stkey", "start", (F.col("start") + F.col("shift")).alias("sstart"), (F.col("end") - F.col("start")).alias("n")), "spans")
    lists = spans.select("sdoc", "stkey", "sstart", "n").distinct().groupBy(F.col("sdoc").alias("doc"), F.col("stkey").alias("tkey"))
    lists = materialize(lists.agg(F.collect_list(F.struct(F.col("sstart").alias("start"), "n")).alias("spans")), "sources")
    digests = _with_texts(texts, lists).select("doc", "tkey", "text", "spans").mapInArrow(tidy(_cut_sources), "sdoc long, stkey long, sstart int, n int, digest binary")
    return spans.join(materialize(digests, "source-words"), ["sdoc", "stkey", "sstart", "n"]).select("doc", "tkey", "start", "n", "digest")


def _cut(with_text: bool, with_digest: bool, spans_at: int | None):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                words = Words(part.column(2))
                spans = part.column(spans_at).to_pylist() if spans_at is not None else [None] * part.num_rows
                raw = words.raw.tobytes()
                n, gone, texts = np.diff(words.first), [], []
                for i, own in enumerate(spans):
                    lead = words.first[i]
                    keep = np.ones(n[i], bool)
                    for s in own or ():
                        start, end = s["start"], s["start"] + s["n"]
                        if hashlib.sha256(words.joined(lead + start, lead + end, raw)).digest() == s["digest"]:
                            keep[start:end] = False
                    at = np.flatnonzero(keep) + lead
                    texts.append(b" ".join([raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]))
                    gone.append(int(n[i] - len(at)))
                cols = [part.column(0), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64())]
                names = "doc_id n_words n_removed"
                if with_digest:
                    cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts]))
                    names += " kept_sha256"
                if with_text:
                    cols.append(pa.array([t.decode("utf-8", "surrogatepass") for t in texts]))
                    names += " kept_text"
                yield _batch(names, *cols)

    return run


def substring_dedup(docs: DataFrame, *, window: int = 50, anchor: int = 20, with_text: bool = True, with_digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed; on request the kept words and their digest."""
    spans = repeated_spans(docs, window=window, anchor=anchor)
    lists = materialize(spans.groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), "spans-verified")
    texts = _texts(docs)
    schema = "doc_id long, n_words long, n_removed long" + ", kept_sha256 string" * with_digest + ", kept_text string" * with_text
    near, same = bloom.split(texts, bloom.of_docs(lists))
    same = same.mapInArrow(_cut(with_text, with_digest, None), schema)
    near = near.join(lists, ["doc", "tkey"], "left").select("doc", "tkey", "text", "spans")
    return same.unionByName(near.mapInArrow(_cut(with_text, with_digest, 3), schema))
