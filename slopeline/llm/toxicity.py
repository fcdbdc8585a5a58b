"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every text becomes the set of its hashed features: words, pairs of neighbours and pairs with
one word between them, lower-cased (A-Z). A feature counts once however often it occurs, so
one insult weighs the same in a short text and in a very long one.

The weights are fitted by FTRL-proximal: per-coordinate learning rates, L1 for sparsity. Only
a bounded number of labelled rows is used (``max_rows``, taken by a hash of the id, so the
choice is the same on every run and at every size); they fit one task, which goes over them
``epochs`` times in an order given by a hash. Few weights survive L1, so what is broadcast is
small and is bounded by 2**bits entries whatever the input. Scoring reads each whole text where
it lies; nothing is shuffled.

Defined cases: null and empty texts have no features and score like a text about which nothing
is known (the bias); without usable labels every score is 0; a doc_id that is null or held out
is never learnt from; a document with contradicting labels counts as toxic; rows repeated with
one doc_id are learnt from up to ``max_rows`` rows in all, and score alike; very long texts are scored whole, in pieces of
memory that their length alone sets; empty tables give no rows; extra columns play no part
(``score`` carries them along and replaces those named tox_score and tox_flag).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, chunks, held_out, mix, tidy, word_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: ASCII letters and digits and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


#: Bytes of text that are turned into features at a time.
_CHUNK = 1 << 20


def hashed(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's index and the slot of every word, pair and skip-pair of a chunk of texts."""
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, off, _WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = word_hashes(low, starts, ends, 0x100000001B3)
    text = np.repeat(np.arange(len(off) - 1), np.diff(np.append(first[:-1], len(starts))))
    where, slot = [text], [word]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = text[gap:] == text[:-gap]
        pair = mix(word[:-gap] * np.uint64(0x9E3779B97F4A7C15) + word[gap:] + np.uint64(salt))
        where.append(text[gap:][same])
        slot.append(pair[same])
    return np.concatenate(where), np.concatenate(slot) >> np.uint64(64 - bits)


def once(text: np.ndarray, slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once a text, ordered by text."""
    key = np.unique((text.astype(np.uint64) << np.uint64(bits)) | slot)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def features(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a chunk of texts: for each the text's index and the slot; each slot once a text."""
    return once(*hashed(raw, off, bits), bits)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal over (slots, label) rows, in the order given."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where((np.abs(z[i]) > l1), w, 0.0)

    for _ in range(epochs):
        for slots, label in rows:
            i = np.append(slots, size)  # the last coordinate is the bias
            w = weights(i)
            w[-1] = -z[size] / ((beta + np.sqrt(n[size])) / alpha + l2)  # the bias is not sparse
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    found = weights(np.arange(size))
    return found, float(-z[size] / ((beta + np.sqrt(n[size])) / alpha + l2))


class Model:
    """Slots with a weight, ascending, their weights, and the bias."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray, bias: float):
        self.bits, self.slots, self.values, self.bias = bits, slots, values, bias

    def dense(self) -> np.ndarray:
        found = np.zeros(1 << self.bits)
        found[self.slots] = self.values
        return found

    def scores(self, raw: np.ndarray, off: np.ndarray, dense: np.ndarray) -> np.ndarray:
        text, slot = hashed(raw, off, self.bits)
        at = np.flatnonzero(dense[slot])  # most features weigh nothing
        text, slot = once(text[at], slot[at], self.bits)
        margin = np.bincount(text, dense[slot], len(off) - 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, bits: int = 20, max_rows: int = 24_000, alpha: float = 6.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 3) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    The defaults were chosen by three folds of the documents that may be learnt from, at two table
    sizes: features of fewer than two documents can't get a weight (each passes on at most one unit
    per epoch), while those of two and more soon do.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # The smallest hashes of all; a bound on the hash keeps a task from sending its own smallest.
    known = known.where(place < 1.5 * max_rows / max(total, 1)).orderBy(place, "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # at most max_rows ids, so the texts stay where they are
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(1)))
    # Rows may share an id: the bound holds for rows, by the same order at every size.
    rows = rows.orderBy("order", F.xxhash64("text"), "text").limit(max_rows)
    rows = rows.repartition(1).sortWithinPartitions("order", "text").select("text", F.col("toxic").cast("int").alias("toxic"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                text, slot = features(*buffers(part.column(0)), bits)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                seen += [(slot[a:b].astype(np.int32), int(y > 0)) for a, b, y in zip(cut, cut[1:], part.column(1).to_pylist())]
        if seen:
            w, bias = ftrl(seen, bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["slot", "w"])

    # One row per weight, at most 2**bits, and the bias.
    found = rows.mapInArrow(run, "slot long, w double").toPandas().sort_values("slot")
    if not len(found):
        return Model(bits, np.zeros(0, np.int64), np.zeros(0), -35.0)
    return Model(bits, found.slot.to_numpy()[1:], found.w.to_numpy()[1:], float(found.w.iloc[0]))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` with two more columns, tox_score double and tox_flag int; all other columns stay.

    Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("tox_score", "tox_flag")
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = model.dense()
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                got = model.scores(*buffers(part.column(at)), dense)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*part.schema.names, "tox_score", "tox_flag"])

    schema = T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_flag", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **settings) -> DataFrame:
    """Fit on the labelled documents among ``docs``, score all: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(slim, fit(slim, labels, **settings), threshold=threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_flag").alias("predicted"))


