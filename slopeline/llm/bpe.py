"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Encoding needs the ids of each pre-token ("word" below). Words that the corpus uses often are
compiled, with their ids as output, into a minimal acyclic automaton: words in order, equal
suffixes shared, an output on the last arc of each word's own path. The automaton is one flat
file of numbers that Spark sends to each executor once and that its Python workers map into memory.
A word that the automaton lacks is merged exactly, by the vocabulary's merge ranks.

Which words are frequent is counted over all documents (map-side counters, then one aggregation);
at most ``lexicon_words`` enter the automaton, so its size is bounded whatever the input. The
choice affects speed only: both ways give the same ids. Encoding and decoding happen where a text
is read; apart from the counts nothing is shuffled.

Special tokens of the vocabulary file (such as an end-of-text mark) are found in the text and
become their own id, as the tokenizers library does.

Defined cases: a null text counts as empty (no ids, empty decoded text); whole texts of any
length are encoded; rows are independent, so repeated rows give repeated results; an empty table
gives no rows; extra columns play no part. The counters of a task are flushed when they hold
``_FLUSH`` words; a worker keeps one encoder, and its caches (words, and twice as many pieces of
text, some 200 bytes each) are emptied at ``_CACHE`` words and at the end of every task.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, tidy

# Fixed value: the pre-tokenizer's pattern, given with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_FLUSH = 200_000
_CACHE = 250_000


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the rest by the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by id pair, bytes by id, and special tokens of a vocabulary file."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        byte = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.token = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in ids.items():
            self.token[i] = bytes(byte[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.single = [ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        # Pairs as one number; the value orders by rank and carries the merged id.
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        self.split = regex.compile(PATTERN).findall
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        pairs = np.array(list(self.merge), np.int64)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.array(list(self.merge.values()), np.int64)[order]
        single = np.array(self.single, np.int64)
        self._single = single
        self._bytes = self.look_up(single[:, None], single[None, :])  # of every pair of bytes

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged id of pairs of ids, as ``merge`` has them; _NEVER for pairs that don't merge."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], _NEVER)

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (as little-endian 32-bit bytes) of many words by the same merges, side by side: in each
        round every word that can still merge makes its next merge."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > _WIDE).tolist():
            out[i] = array("I", self.merged(words[i])).tobytes()
        rows = np.flatnonzero((size > 0) & (size <= _WIDE))
        rows = rows[np.argsort(size[rows], kind="stable")]
        for part in np.array_split(rows, max(1, -(-len(rows) // _SIDE))):  # words of like length together
            if not len(part):
                continue
            n, wide = size[part].copy(), int(size[part].max())
            raw = np.frombuffer(b"".join([words[i].ljust(wide, b"\0") for i in part.tolist()]), np.uint8).reshape(-1, wide)
            ids, column = self._single[raw], np.arange(wide)
            found = np.full((len(part), wide), _NEVER)  # of the pair that begins in a column
            found[:, :-1] = np.where(column[None, 1:] < n[:, None], self._bytes[raw[:, :-1], raw[:, 1:]], _NEVER)
            todo = np.arange(len(part))
            while len(todo):
                at = found[todo].argmin(1)
                best = found[todo, at]
                todo, at, best = todo[best != _NEVER], at[best != _NEVER], best[best != _NEVER]
                if not len(todo):
                    break
                take = np.minimum(column[None, :] + (column[None, :] > at[:, None]), wide - 1)
                moved, ranks = np.take_along_axis(ids[todo], take, 1), np.take_along_axis(found[todo], take, 1)
                each = np.arange(len(todo))
                moved[each, at] = best & 0xFFFFFFFF
                n[todo] -= 1
                ranks[:, -1] = _NEVER
                before, behind = at > 0, at + 1 < n[todo]
                ranks[each, at] = _NEVER
                ranks[each[behind], at[behind]] = self.look_up(moved[each[behind], at[behind]], moved[each[behind], at[behind] + 1])
                ranks[each[before], at[before] - 1] = self.look_up(moved[each[before], at[before] - 1], moved[each[before], at[before]])
                ids[todo], found[todo] = moved, ranks
            flat = ids.astype("<u4")
            for i, row, k in zip(part.tolist(), flat, n.tolist()):
                out[i] = row[:k].tobytes()
        return out

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word by repeatedly merging the pair of lowest rank, leftmost first."""
        single, known = self.single, self.merge.get
        ids = [single[b] for b in word]
        found = [known(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NEVER:
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = known(ids[i - 1] << 32 | ids[i], _NEVER)
            if i < len(found):
                found[i] = known(ids[i] << 32 | ids[i + 1], _NEVER)
        return ids


_NEVER = 1 << 62
_WIDE, _SIDE = 48, 8192  # bytes of words that are merged side by side, and how many at a time


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to ids as a flat array of 32-bit numbers.

    Words are added in order; a state that can no longer change is replaced by an equal state
    that exists already, so suffixes are shared. As many words can end in one shared state, the
    output is placed by counting: every arc knows how many words lie before it, so walking a word
    yields its rank, and ranks index the table of ids.
    """
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(final)
            final.append(node[0])
            arcs.append(key[1])
        return register[key]

    path: list[list] = [[False, {}]]
    letters: list[int] = []
    ordered = sorted(w for w in words if w)
    for word in ordered:
        same = 0
        while same < min(len(letters), len(word)) and letters[same] == word[same]:
            same += 1
        while len(letters) > same:
            done = path.pop()
            path[-1][1][letters.pop()] = settle(done)
        for b in word[same:]:
            letters.append(b)
            path.append([False, {}])
        path[-1][0] = True
    while letters:
        done = path.pop()
        path[-1][1][letters.pop()] = settle(done)
    root = settle(path[0])

    below = []  # words that can be completed from a state; targets have lower numbers
    for end, own in zip(final, arcs):
        below.append(int(end) + sum(below[t] for _, t in own))
    # Layout: root, states, arcs, words; then for each state whether a word ends there and where its
    # arcs begin; targets of arcs; words before each arc; where each word's ids begin, by rank; the
    # ids; and the letters of the arcs, a byte each.
    begin = np.cumsum([0, *(len(own) for own in arcs)])
    letters_of, target_of, before_of = bytearray(), [], []
    for end, own in zip(final, arcs):
        before = int(end)
        for letter, target in own:
            letters_of.append(letter)
            target_of.append(target)
            before_of.append(before)
            before += below[target]
    ids = [words[w] for w in ordered]
    at = np.cumsum([0, *map(len, ids)])
    parts = [[root, len(final), len(target_of), len(ordered)], final, begin, target_of, before_of, at, [i for w in ids for i in w]]
    numbers = b"".join(np.asarray(p, np.int64).astype("<i4").tobytes() for p in parts)
    return len(numbers).to_bytes(8, "little") + numbers + bytes(letters_of)


class Lexicon:
    """A compiled lexicon, mapped into memory from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.letters = 8 + int.from_bytes(self._map[:8], "little")  # where the letters begin
        view = memoryview(self._map)[8 : self.letters].cast("i")
        arc = np.frombuffer(self._map, np.uint8, offset=self.letters)
        self.root, states, arcs, words = view[:4]
        at = 4
        self.final = view[at : (at := at + states)]
        self.begin = view[at : (at := at + states + 1)]
        self.target = view[at : (at := at + arcs)]
        self.before = view[at : (at := at + arcs)]
        self.where = view[at : (at := at + words + 1)]
        self.ids = view[at:]
        # Arcs by state and letter, which is their order in the file.
        self._arc = np.repeat(np.arange(states) << 8, np.diff(np.asarray(self.begin))) | arc
        self._flat = np.asarray(self.ids).astype("<u4").tobytes()

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """``get`` for many words side by side; ids as little-endian 32-bit bytes."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        lead = np.cumsum(size) - size
        state, rank = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        target, before = np.asarray(self.target), np.asarray(self.before)
        todo = np.flatnonzero(size > 0)
        for i in range(int(size.max(initial=0))):
            if not len(self._arc):
                state[todo] = -1
                break
            key = (state[todo] << 8) | raw[lead[todo] + i]
            at = np.minimum(np.searchsorted(self._arc, key), len(self._arc) - 1)
            ok = self._arc[at] == key
            state[todo[~ok]] = -1
            rank[todo[ok]] += before[at[ok]]
            state[todo[ok]] = target[at[ok]]
            todo = todo[ok]
            todo = todo[size[todo] > i + 1]
            if not len(todo):
                break
        known = (state >= 0) & (size > 0)
        known[known] = np.asarray(self.final)[state[known]] != 0
        where = np.asarray(self.where)
        return [self._flat[4 * where[r] : 4 * where[r + 1]] if k else None for k, r in zip(known.tolist(), rank.tolist())]

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None: follow its bytes, adding up the words that come before."""
        state, rank, begin, base, find = self.root, 0, self.begin, self.letters, self._map.find
        for b in word:
            arc = find(_BYTE[b], base + begin[state], base + begin[state + 1]) - base
            if arc < 0:
                return None
            rank += self.before[arc]
            state = self.target[arc]
        return self.ids[self.where[rank] : self.where[rank + 1]].tolist() if self.final[state] else None


_BYTE = [bytes([b]) for b in range(256)]


class Encoder:
    """Texts to ids (as little-endian 32-bit bytes) and back.

    The pre-tokenizer looks no further than a single space or line feed between two other
    characters: it starts a new word there whatever stands around. Texts without any other
    white space are therefore cut at those first, and the pieces are looked up whole. All other
    texts go through the pre-tokenizer's pattern. What a chunk of texts holds for the first time is
    looked up in the lexicon and merged side by side.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words: dict[str, bytes] = {}  # words to ids
        self.first: dict[str, bytes] = {}  # pieces at the begin of a line
        self.spaced: dict[str, bytes] = {}  # pieces behind a single space

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self.words, self.first, self.spaced):
            cache.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > _CACHE or len(self.spaced) > 2 * _CACHE or len(self.first) > _CACHE:
            self.forget()
        parsed = [self._parse(t) for t in texts]
        self._learn([part for own in parsed for part in own])
        return [b"".join([self._ids(part) for part in own]) for own in parsed]

    def _parse(self, text: str) -> list:
        """Parts of a text: ids of a special token (bytes), words (tuple), or lines of pieces (list of lists)."""
        v = self.vocabulary
        if v.mark is not None and any(m in text for m in v.special):
            return [np.array([v.special[part]], "<u4").tobytes() if part in v.special else self._plain(part) for part in v.mark.split(text)]
        return [self._plain(text)]

    def _plain(self, text: str) -> tuple | list:
        # Any other white space, or two in a row, would make these lists differ.
        if text.replace("\n", " ").split(" ") != text.split():
            return tuple(self.vocabulary.split(text))
        return [line.split(" ") for line in text.split("\n")]

    def _learn(self, parts: list) -> None:
        """Put into the caches whatever the parts hold."""
        split = self.vocabulary.split
        first, spaced, words = set(), set(), {"\n"}
        for part in parts:
            if isinstance(part, tuple):
                words.update(part)
            elif isinstance(part, list):
                for line in part:
                    first.add(line[0])
                    spaced.update(line[1:])
        # Letters alone are one word by the pattern (for old letters, on which all Unicode tables agree).
        plain = lambda p: p.isalpha() and max(p) < "\u0500"
        first = {p: (p,) if plain(p) else split(p) for p in first - self.first.keys()}
        spaced = {p: (" " + p,) if plain(p) else split(" " + p) for p in spaced - self.spaced.keys()}
        for found in (first, spaced):
            for own in found.values():
                words.update(own)
        new = list(words - self.words.keys())
        if new:
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            ids = self.lexicon.get_all(raw)
            rest = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rest, self.vocabulary.merged_all([raw[i] for i in rest])):
                ids[i] = x
            self.words.update(zip(new, ids))
        known = self.words.__getitem__
        self.first.update((p, b"".join(map(known, own))) for p, own in first.items())
        self.spaced.update((p, b"".join(map(known, own))) for p, own in spaced.items())

    def _ids(self, part: bytes | tuple | list) -> bytes:
        if isinstance(part, bytes):
            return part
        if isinstance(part, tuple):
            return b"".join(map(self.words.__getitem__, part))
        first, spaced = self.first, self.spaced.__getitem__
        return self.words["\n"].join([first[line[0]] + b"".join(map(spaced, line[1:])) for line in part])

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _vocabulary(path_or_name: str, shipped: bool) -> Vocabulary:
    with open(SparkFiles.get(path_or_name) if shipped else path_or_name, "rb") as f:
        return Vocabulary(f.read())


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    """Kept by the worker from task to task; the names are those of files that Spark has sent."""
    return Encoder(_vocabulary(vocabulary, True), Lexicon(SparkFiles.get(lexicon)))


def _ship(spark: SparkSession, data: bytes, kind: str) -> str:
    """Send a few megabytes to every executor as a file; its name there."""
    name = f"{kind}-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)  # the driver serves it from here
    with open(path, "wb") as out:
        out.write(data)
    spark.sparkContext.addFile(path)
    return name


def frequent_words(docs: DataFrame, limit: int) -> list[str]:
    """The most frequent words between white space, at most ``limit``, counted over all texts.

    Words of the same count are in or out together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for part in chunks(batch, "text"):
                for text in part.column(0).to_pylist():
                    seen.update((text or "").split())
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    words = materialize(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 AND length(word) <= 64"), "words")
    # The smallest count that leaves at most ``limit`` words, from the number of words per count
    # (grouped by the power of two above 1024, so that this table is small); so at most ``limit``
    # rows reach the driver.
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))))
    least, total = 1 << 62, 0
    for row in words.groupBy(level.cast("long").alias("level")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect():
        total += row["c"]
        if total > limit:
            break
        least = row["level"]
    return [r[0] for r in words.where(F.col("n") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, v: Vocabulary, *, lexicon_words: int = 30_000) -> bytes:
    """Compile the pre-tokens of the most frequent words, with and without a space before them."""
    words: dict[bytes, list[int]] = {}
    for found in frequent_words(docs, lexicon_words):
        for text in (found, " " + found):
            for word in v.split(text):
                raw = word.encode()
                if raw not in words:
                    words[raw] = v.merged(raw)
    return compile_lexicon(words)


def bpe(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 30_000, with_ids: bool = True, with_text: bool = False, with_digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens; on request ids array<int>, decoded text, and digests.

    The vocabulary file is read on the driver and sent to the executors (a few megabytes).
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = _ship(spark, f.read(), "vocabulary")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lexicon = _ship(spark, build_lexicon(docs.select("text"), _vocabulary(vocabulary_path, False), lexicon_words=lexicon_words), "lexicon")
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
    schema = "doc_id long, n_tokens long"
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())
        schema += ", ids array<int>"
    if with_text:
        kinds["decoded"] = pa.string()
        schema += ", decoded string"
    if with_digests:
        kinds |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        schema += ", ids_sha256 string, decoded_sha256 string"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, lexicon)
        try:
            for batch in batches:
                for part in chunks(batch, "text", 2 << 20):
                    ids = encoder.encode_all([t or "" for t in part.column(1).to_pylist()])
                    cols = {"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids]}
                    if with_text or with_digests:
                        texts = [encoder.decode(x) for x in ids]
                    if with_ids:
                        off = np.cumsum([0, *cols["n_tokens"]], dtype=np.int32)
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                    if with_text:
                        cols["decoded"] = texts
                    if with_digests:
                        cols["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                        cols["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[k], pa.Array) else pa.array(x, kind) for k, kind in kinds.items()], list(kinds))
        finally:
            encoder.forget()

    return docs.mapInArrow(run, schema)
