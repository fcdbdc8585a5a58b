"""Helpers that several corpus operators share.

Nothing here holds a whole table: text helpers see one Arrow batch at a time, and
``materialize`` writes to the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Texts are handed to vectorised code in pieces of about this many bytes, so that a
#: Python worker needs tens of megabytes whatever the length of a batch.
CHUNK_BYTES = 4 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over the batches of a task: what they needed goes back to the system when they
    end, as workers are kept for later tasks."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from; a null id is never learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, without a copy; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each (a longer text comes alone, whole)."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a chunk of texts, and the index of each text's first word.

    ``is_word`` is a table over the 256 byte values; words never cross texts.
    """
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, off)


#: Bytes that are not white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LONG = 64  # bytes; longer words are hashed one by one


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each byte range raw[start:end]: eight bytes at a time, scrambled in between."""
    from xxhash import xxh3_64_intdigest

    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on

    def piece(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        unused = np.uint64(8) * (np.uint64(8) - np.clip(left, 1, 8).astype(np.uint64))
        return eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)

    h = mix(piece(starts, size) + np.uint64(seed % (1 << 64))) + size.astype(np.uint64) * _ODD
    done = 8
    while done < _LONG and len(more := np.flatnonzero((size > done) & (size <= _LONG))):
        h[more] = mix(mix(h[more]) * _ODD + piece(starts[more] + done, size[more] - done))
        done += 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed % (1 << 64))
    return mix(h)


class Runs:
    """Hashes of runs of neighbouring word hashes, by doubling: a run of 2**i words is the scrambled
    pair of its halves, and a run of any length is the pair of the two longest such runs that cover it."""

    def __init__(self, word: np.ndarray, longest: int):
        self.level = [word]
        while 2 << len(self.level) - 1 <= longest:
            half = 1 << len(self.level) - 1
            last = self.level[-1]
            n = max(len(last) - half, 0)
            self.level.append(mix(mix(last[:n] * _ODD) + last[half : half + n]))

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hash of ``size`` (at least 1) words from each start."""
        size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
        out = np.zeros(len(start), np.uint64)
        fit = np.frexp(size.astype(np.float64))[1] - 1  # the largest i with 2**i <= size
        for i in np.unique(fit).tolist():
            at = np.flatnonzero(fit == i)
            h, s, n = self.level[i], start[at], size[at]
            out[at] = mix(mix(h[s] + n.astype(np.uint64)) * _ODD + h[s + n - (1 << i)])
        return out


def flat_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i in a row."""
    lead = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - lead, size)


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the byte ranges number a[i] and b[i] hold the same bytes: eight at a time."""
    eight = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    size = ends[a] - starts[a]
    same = size == ends[b] - starts[b]
    todo, at = np.flatnonzero(same & (size > 0)), 0
    while len(todo):
        unused = np.uint64(64) - np.minimum(size[todo] - at, 8).astype(np.uint64) * np.uint64(8)
        differ = (eight[starts[a[todo]] + at] ^ eight[starts[b[todo]] + at]) << unused != 0
        same[todo[differ]] = False
        at += 8
        todo = todo[~differ & (size[todo] > at)]
    return same


def kinds(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one range of each kind, the kind of each range), where ranges of a kind have equal hashes and equal bytes."""
    order = np.argsort(hashes, kind="stable")
    lead = np.append(True, hashes[order[1:]] != hashes[order[:-1]]) if len(order) else np.zeros(0, bool)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(lead) - 1
    own = order[lead]
    odd = np.flatnonzero(~same_bytes(raw, starts, ends, np.arange(len(order)), own[kind]))
    kind[odd] = len(own) + np.arange(len(odd))  # of different bytes with one hash, the later ones stand for themselves
    return np.append(own, odd), kind


NO_ID = (1 << 63) - 1  # stands for a null id where ids are ordered: null ids come last


def doc_key(doc: np.ndarray, tkey: np.ndarray) -> np.ndarray:
    """A 64-bit key of (doc, tkey) pairs."""
    return (doc.view(np.uint64) * _ODD + tkey.view(np.uint64)).view(np.int64)
