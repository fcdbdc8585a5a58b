"""Periodic runs of words: seed and extend on the diagonals of a text.

A run of smallest period q and length n is a stretch of the diagonal "word i equals word i + q" of
n - q places. With at least ``least`` words and ``times`` periods, runs of periods up to K = least //
times share ``least - K`` places, and those of periods above some K at least (times - 1)(K + 1): this is
the overlap that is guaranteed, and the length of the k-grams that are indexed for the periods from
K + 1 to 2 K. As k is then no less than the period, a k-gram of a run occurs again exactly one period
later, and not before: if it did, the run would have a smaller period. So of all pairs of occurrences
in a text only neighbouring ones are seeds, one at most for each place, whatever the text repeats.

Seeds are sorted by lag and place. For each lag what is covered furthest is carried along: a seed that
lies in the stretch which the seeds before it have already covered adds one word to that stretch and is
not extended again. Stretches that are long enough are then compared word by word, byte for byte, on
their diagonal and at both ends.

Periods grow by doubling, and only places whose shortest k-gram occurs twice go on to longer ones, so
ordinary text is sorted once. All texts of a piece are searched side by side; the memory of a task
follows its longest text. Nothing is shuffled: runs lie within a text.

Defined cases: a null text has no words; a text shorter than ``least`` has no runs; rows are
independent, so repeated rows give repeated results; a null doc_id stays null (and plants nothing);
very long texts and words are taken whole; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, NOT_SPACE, Runs, buffers, chunks, flat_ranges, mix, same_bytes, tidy, word_hashes, word_spans

_PIECE = 2 << 20


class Words:
    """The words of many texts in a row: bytes, spans, and where each text begins."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.raw, self.starts, self.ends, self.first = raw, starts, ends, first

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] are the same bytes."""
        return same_bytes(self.raw, self.starts, self.ends, a, b)


def find_runs(words: Words, least: int = 24, times: int = 3, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, period) of every run, by first word and period."""
    none = np.zeros(0, np.int64)
    n, count = len(words.starts), np.diff(words.first)
    longest = int(count.max(initial=0))
    if longest < least:
        return none, none, none
    text = np.repeat(np.arange(len(count)), count)
    rest = words.first[text + 1] - np.arange(n)  # words from here to the end of the text
    most = longest // times  # the greatest period
    levels = [(least - least // times, 1, least // times)]
    while (low := levels[-1][2] + 1) <= most:
        levels.append(((times - 1) * low, low, 2 * (low - 1)))
    grams = Runs(word_hashes(words.raw, words.starts, words.ends, seed), max(k for k, _, _ in levels))
    spot = text.astype(np.uint64) * _ODD
    alive = np.flatnonzero(rest >= levels[0][0])
    found = []
    for k, low, high in levels:
        alive = alive[rest[alive] >= k]
        if not len(alive):
            break
        key = mix(grams.hash(alive, k) + spot[alive])
        order = np.argsort(key, kind="stable")  # equal k-grams of a text by place
        key, at = key[order], alive[order]
        twice = np.flatnonzero(key[1:] == key[:-1])
        repeated = np.zeros(len(at), bool)
        repeated[twice] = repeated[twice + 1] = True
        i, lag = at[twice], at[twice + 1] - at[twice]
        ok = (lag >= low) & (lag <= high)
        i, lag = i[ok], lag[ok]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        if len(i):
            # Covered furthest on a lag, so far: a seed that is not next to the one before it is a new stretch.
            lead = np.flatnonzero(np.append(True, (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + 1)))
            last = np.append(lead[1:], len(i)) - 1
            start, period = i[lead], lag[lead]
            size = i[last] - start + period + k
            long = size >= np.maximum(least, times * period)
            found.append((start[long], size[long], period[long]))
        alive = np.sort(at[repeated])
    if not found:
        return none, none, none
    start, size, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    if not _are_runs(words, start, size, period):
        return find_runs(words, least, times, seed + 1)  # two words had the same 64-bit hash: other hashes
    return start, size, period


def _are_runs(words: Words, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> bool:
    """Whether all stretches hold byte for byte and neither side can be extended."""
    text = words.text_of(start)
    inside = flat_ranges(start, size - period)
    if not words.equal(inside, inside + np.repeat(period, size - period)).all():
        return False
    left = np.flatnonzero(start > words.first[text])
    right = np.flatnonzero(start + size < words.first[text + 1])
    end = start + size
    return not (words.equal(start[left] - 1, start[left] - 1 + period[left]).any() or words.equal(end[right], end[right] - period[right]).any())


def plant(words: Words, ids: list[int | None]) -> Words:
    """The texts' words with every tenth text (by the CRC-32 of its id) made periodic from some word on.

    For h = crc32 of the id in decimal and g = h // 10: where h % 10 = 0, word i >= a becomes word
    a + (i - a) % p of the text as it was, with a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    index = np.arange(len(words.starts))
    touched = False
    for t, i in enumerate(ids):
        n = int(words.first[t + 1] - words.first[t])
        if i is None or not n or (h := zlib.crc32(str(i).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        begin = int(words.first[t]) + a
        index[begin : begin + n - a] = begin + np.arange(n - a) % p
        touched = True
    return Words(words.raw, words.starts[index], words.ends[index], words.first) if touched else words


def joined(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text, joined by one space, one text behind the other; and where each begins."""
    own = np.flatnonzero(keep)
    size = words.ends[own] - words.starts[own]
    text = words.text_of(own)
    gap = np.append(text[1:] == text[:-1], False) if len(own) else np.zeros(0, bool)  # a space behind the word
    out = np.full(int((size + gap).sum()), 0x20, np.uint8)
    lead = np.cumsum(size + gap) - size - gap
    out[flat_ranges(lead, size)] = words.raw[flat_ranges(words.starts[own], size)]
    ends = np.append(0, np.cumsum(size + gap))
    return out.tobytes(), ends[np.searchsorted(own, words.first)]


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, planted: bool = False, with_text: bool = False, with_runs: bool = False, with_digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_runs, and start, length, period and exponent_milli of the run with
    the most repeats; on request the text with each run cut to its first period, the runs themselves,
    and digests of both.

    A run has at least ``least`` words and ``times`` times its smallest period. ``planted`` first makes
    every tenth text periodic (see ``plant``), which tests use as known cases. ``least`` must be at
    least twice ``times``.
    """
    if times < 3 or least < 2 * times:
        raise ValueError("runs need three periods and two words a period at least")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"
    schema += ", kept string" * with_text + ", runs array<struct<start:long,length:long,period:long>>" * with_runs + ", runs_sha256 string, collapsed_sha256 string" * with_digest
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _PIECE):
                raw, off = buffers(part.column(1))
                starts, ends, first = word_spans(raw, off, NOT_SPACE)
                words = Words(raw, starts, ends, np.append(first[:-1], len(starts)))
                if planted:
                    words = plant(words, part.column(0).to_pylist())
                start, size, period = find_runs(words, least, times)
                text = words.text_of(start)
                own = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
                local = (start - words.first[text]).tolist()
                cols = {"doc_id": part.column(0), "n_runs": pa.array(np.diff(own))}
                rows = list(zip(local, size.tolist(), period.tolist()))
                best = []
                for a, b in zip(own, own[1:]):
                    top = None
                    for r in rows[a:b]:  # by start and period, so the first of equal exponents stays
                        if top is None or r[1] * top[2] > top[1] * r[2]:
                            top = r
                    best.append(top)
                for j, name in enumerate(("start", "length", "period")):
                    cols[name] = pa.array([None if r is None else r[j] for r in best], pa.int64())
                cols["exponent_milli"] = pa.array([None if r is None else 1000 * r[1] // r[2] for r in best], pa.int64())
                if with_text or with_digest:
                    # Words behind a run's first period go: +1 where a cut begins, -1 where it ends.
                    edge = np.zeros(len(words.starts) + 1, np.int64)
                    np.add.at(edge, start + period, 1)
                    np.add.at(edge, start + size, -1)
                    data, at = joined(words, np.cumsum(edge)[:-1] == 0)
                    at = at.tolist()
                    kept = [data[a:b] for a, b in zip(at, at[1:])]
                if with_text:
                    cols["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                if with_runs:
                    cols["runs"] = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows[a:b]] for a, b in zip(own, own[1:])], run_type)
                if with_digest:
                    cols["runs_sha256"] = pa.array([hashlib.sha256("".join("%d,%d,%d\n" % r for r in rows[a:b]).encode()).hexdigest() for a, b in zip(own, own[1:])])
                    cols["collapsed_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in kept])
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)
