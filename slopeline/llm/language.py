"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into the
longest phrases that occur in that labelled text; a language in which few phrases suffice
describes the text well. The language with the fewest phrases per character wins.

The labelled text is a bounded sample: ``chars`` characters per language, fewer where all languages
together would have more than ``total_chars``, from at most ``max_docs`` documents of each, chosen by
a hash of the id among those that may be learnt from (a span of each, placed by that hash). So what
is broadcast is bounded by total_chars characters however many languages there are; workers build the
automata from it once. Texts are parsed in blocks of ``block`` characters (each block begins a phrase;
most texts are one block), thousands of blocks side by side, so very long texts cost memory like
short ones. Nothing is shuffled but the sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled
text everything is ``und``; equal counts go to the alphabetically first language; a null doc_id
is never learnt from; rows that share a doc_id are sampled by id and text; rows are independent, so repeated rows give repeated results; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, held_out, tidy

#: Classes of characters: 0 anything rare, then space, a-z, and two-byte letters by their second byte.
_CLASSES = 64


def symbols(raw: np.ndarray) -> np.ndarray:
    """A class below 64 for every byte: letters fold case, everything that is no letter is a space.

    The lead byte of a two-byte letter falls to class 0 and its second byte tells the letter.
    """
    return _TABLE[raw]


_TABLE = np.ones(256, np.uint8)
for _i in range(26):
    _TABLE[65 + _i] = _TABLE[97 + _i] = 2 + _i
for _i in range(64):  # second bytes: upper and lower case of Latin-1 letters fold together
    _TABLE[0x80 + _i] = 28 + _i % 32
_TABLE[0xC0:] = 0


def suffix_automaton(text: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of ``text``: a row per state, a column per class, -1 for none.

    State 0 is the start; every path from it spells a substring of the text.
    """
    trans: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(trans), _CLASSES), -1, np.int32)
    for i, row in enumerate(trans):
        table[i, list(row)] = list(row.values())
    return table


def parse_table(text: np.ndarray) -> np.ndarray:
    """The automaton as one flat array for greedy parsing.

    Entry state * 64 + class is the next state times two, plus one where the phrase had to end and
    the character begins the next one. A character that the labelled text lacks also begins a
    phrase, which goes on with what follows it.
    """
    table = suffix_automaton(text)
    start = np.maximum(table[0], 0)
    ends = table < 0
    return np.where(ends, start[None, :] * 2 + 1, table * 2).astype(np.int32).ravel()


class Languages:
    """Names in order and labelled text of each; parse tables are made on first use."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        self.texts = [texts[k] for k in self.names]
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return {"names": self.names, "texts": self.texts, "_tables": None}

    @property
    def tables(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = [parse_table(squeeze(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in self.texts]
        return self._tables

    def phrases(self, raw: np.ndarray, off: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each language needs for each text (texts x languages), and parsed characters."""
        sym, off = squeeze(raw, off)
        size = np.diff(off)
        blocks = (size + block - 1) // block
        owner = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[:-1][owner] + nth * block
        left = np.minimum(size[owner] - nth * block, block)
        order = np.argsort(-left, kind="stable")  # so that the blocks still running are a prefix
        owner, start, left = owner[order], start[order], left[order]
        running = np.searchsorted(-left, -np.arange(block), "left")  # blocks longer than i
        counts = np.zeros((len(size), len(self.names)))
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int64)
            found = np.ones(len(owner), np.int64)
            for i in range(block):
                n = running[i]
                if not n:
                    break
                step = table[state[:n] * _CLASSES + sym[start[:n] + i]]
                found[:n] += step & 1
                state[:n] = step >> 1
            counts[:, k] = np.bincount(owner, found, len(size))
        return counts, size


def squeeze(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk of texts with runs of spaces made one and rare bytes dropped."""
    sym = symbols(raw)
    keep = sym != 0
    space = sym == 1
    keep[1:] &= ~(space[1:] & space[:-1])
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return sym[keep].astype(np.int64), at[off]


def learn(docs: DataFrame, *, chars: int = 40_000, total_chars: int = 400_000, max_docs: int = 160) -> Languages:
    """Labelled text per language from documents that are not held out: two jobs, however many languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    n = max(counts.count(), 1)
    chars = max(1, min(chars, total_chars // n))
    share = max(200, chars // 40)
    span = F.expr(f"substring(text, 1 + pmod(xxhash64(doc_id), greatest(1, length(text) - {share})), {share})")
    # The smallest hashes of each language; a bound on the hash first, so that few rows are ranked. The row of
    # the smallest hash passes whatever the bound, and repeated rows count once: no language is lost.
    few = known.select("lang", "doc_id", place.alias("place"), span.alias("span")).join(F.broadcast(counts), "lang").where((F.col("place") < 2 * max_docs / F.col("n")) | (F.col("place") == F.col("least"))).dropDuplicates(["lang", "place"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "span"))
    rows = few.withColumn("rank", rank).where(F.col("rank") <= min(max_docs, 4 * chars // share + 1)).select("lang", "rank", "span").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        texts.setdefault(r["lang"], []).append(r["span"])
    return Languages({lang: b" ".join(x.encode() for x in own)[:chars] for lang, own in texts.items()})


def language_id(docs: DataFrame, *, block: int = 4096, **settings) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, phrases.

    ``score`` tells by how much the winner beats the runner-up: 1 - (its phrases / theirs),
    scaled so that needing 30 % fewer phrases is certainty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, **settings))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                raw, off = buffers(part.column(1))
                text = [any(map(str.isalpha, t or "")) for t in part.column(1).to_pylist()]
                if not known.names:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["und"] * len(text)), pa.array([0.0] * len(text)), pa.array([0] * len(text))], _NAMES)
                    continue
                counts, _ = known.phrases(raw, off, block)
                best = counts.argmin(axis=1)
                least = counts[np.arange(len(best)), best]
                if len(known.names) > 1:
                    second = np.partition(counts, 1, axis=1)[:, 1]
                    score = np.clip((1.0 - least / np.maximum(second, 1)) / 0.3, 0.0, 1.0)
                else:
                    score = np.ones(len(best))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([known.names[b] if ok else "und" for b, ok in zip(best, text)]), pa.array(np.where(text, score, 0.0)), pa.array(np.where(text, least, 0).astype(np.int64))], _NAMES
                )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrases long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrases")


_NAMES = ["doc_id", "lang_pred", "score", "phrases"]
