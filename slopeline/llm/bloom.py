"""A Bloom filter of bounded size, built by Spark, to keep needless rows out of a shuffle.

The size follows the number of keys up to a bound, so what is broadcast is bounded whatever the input. With more keys it
lets more rows through; the join that follows stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, mix, tidy

_PROBES = 4


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each key: steps of a second hash from a first one."""
    one = mix(keys)
    two = mix(one ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [(one + np.uint64(i) * two) >> np.uint64(64 - bits) for i in range(_PROBES)]


class Bloom:
    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For 64-bit keys: false only where a key was certainly not added."""
        found = np.ones(len(keys), bool)
        for at in _places(keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64), self.bits):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def build(keys: DataFrame, most_bits: int = 28) -> Bloom:
    """A filter over the one long column of ``keys``: about 16 bits a key, at most 2**most_bits (32 MB)."""
    n = keys.count()
    bits = min(most_bits, max(16, int(16 * n).bit_length()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).drop_null().to_numpy().view(np.uint64), bits))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bit"])

    # At most 2**(bits - 6) rows come back, each a word of the filter.
    rows = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return Bloom(bits, words)


def of_docs(keyed: DataFrame) -> Bloom:
    """A filter over the (doc, tkey) pairs of a table without nulls."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(doc_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["key"])

    return build(keyed.select("doc", "tkey").mapInArrow(run, "key long"))


def split(rows: DataFrame, found: Bloom) -> tuple[DataFrame, DataFrame]:
    """Rows whose (doc, tkey), their first two columns, the filter may hold, and those it can't."""
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def side(wanted: bool):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    got = sent.value.may_hold(doc_key(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()))
                    yield batch.filter(pa.array(got == wanted))

        return rows.mapInArrow(run, rows.schema)

    return side(True), side(False)
