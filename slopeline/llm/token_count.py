"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers replace the tokenizer; neither writes ids, they only count.

The splitter reads characters. Its input symbol is a character's class together with the little
that the pre-tokenizer's pattern looks ahead (is the next character white space, does a contraction
begin here); a transition says whether a word begins at the character. As every symbol is a map
from states to states, texts need not be read from left to right: a chunk of 64 characters is
composed to one state map, with all chunks of a batch side by side, the maps of chunks are composed
by a parallel prefix scan, and with its entry state known every chunk emits its word begins. The
maps that can arise (the transition monoid) are numbered at compile time and composed by one look
in a table. A text's first symbol forgets what came before, so texts of any length, one or many,
are one run of chunks.

The counter reads the bytes of a word. After every prefix it knows the last token of the prefix's
encoding: among the tokens that end there, exactly one may follow the last token of the prefix
before it, and two tokens may be neighbours if no merge over their common edge comes before the
merges that build them. A state keeps, for each place from which a longer token may still end, that
place in the token trie, the token before it, and how many tokens fewer or more there were; a
transition carries the number of tokens that it adds (or takes back, where a longer token replaces
several). The number of states is finite but large, so a worker compiles those that its texts
reach, at most ``states`` at a time, and begins anew beyond: the counts are the same. A state and its
moves take less than a kilobyte. Only the distinct words of a piece are run.

Special tokens of the vocabulary are found in the text and count as one token, as the tokenizers
library does by default. The work is a map over the table: nothing is shuffled, and a task needs
memory for one piece of about ``_PIECE`` bytes or its longest text.

Defined cases: a null text counts as empty (no bytes, no tokens); whole texts are counted, also very
long ones and ones without any white space; rows are independent, so repeated rows give repeated
results and a null doc_id stays null; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import buffers, chunks, kinds, tidy, word_hashes

_PIECE = 4 << 20  # bytes of text that are counted at once; a longer text comes alone
_WIDTH = 64  # characters of a chunk of the splitter

# Classes of characters: space, other white space, letters (those of contractions apart), numbers,
# the apostrophe, and the rest.
_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER, _APOSTROPHE, _STMD, _RV, _E, _L = range(10)
# Input symbols of the splitter.
_LAST_SPACE, _LAST_WHITE, _MORE_WHITE, _SYM_LETTER, _SYM_NUMBER, _SYM_OTHER, _CUT1, _CUT2 = range(8)
_BEGINS, _IDLE = 8, 16  # added to the first symbol of a text; and the symbol that fills up chunks
# States of the splitter.
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _AFTER_SPACE, _IN_WHITE, _ONE_LEFT, _TWO_LEFT = range(8)


def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\s+", _WHITE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            at = np.array([m.start(), m.end()])
            at[at >= 0xD800] += 0x800
            found[at[0] : at[1]] = kind
    found[0xD800:0xE000] = _OTHER
    for letters, kind in ((" ", _SPACE), ("'", _APOSTROPHE), ("stmd", _STMD), ("rv", _RV), ("e", _E), ("l", _L)):
        found[[ord(c) for c in letters]] = kind
    return found


class Splitter:
    """The pre-tokenizer as a deterministic transducer with its transition monoid."""

    def __init__(self) -> None:
        # A new word by its first symbol: the state behind it.
        fresh = [_AFTER_SPACE, _FRESH, _IN_WHITE, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _ONE_LEFT, _TWO_LEFT]
        step = np.zeros((8, 17), np.uint8)
        begin = np.zeros((8, 17), bool)
        step[:, :8] = step[:, 8:16] = fresh
        begin[:, :16] = True
        step[:, _IDLE] = np.arange(8)
        goes_on = {
            _IN_LETTERS: {_SYM_LETTER: _IN_LETTERS},
            _IN_NUMBERS: {_SYM_NUMBER: _IN_NUMBERS},
            _IN_OTHER: {s: _IN_OTHER for s in (_SYM_OTHER, _CUT1, _CUT2)},
            _AFTER_SPACE: {_SYM_LETTER: _IN_LETTERS, _SYM_NUMBER: _IN_NUMBERS} | {s: _IN_OTHER for s in (_SYM_OTHER, _CUT1, _CUT2)},
            _IN_WHITE: {_MORE_WHITE: _IN_WHITE},  # the last one, before other characters, begins a word of its own
            _ONE_LEFT: {_SYM_LETTER: _FRESH},
            _TWO_LEFT: {_SYM_LETTER: _ONE_LEFT},
        }
        for state, own in goes_on.items():
            for symbol, target in own.items():
                step[state, symbol], begin[state, symbol] = target, False
        self.step, self.begin = step, begin
        # The monoid: every map that a sequence of symbols can be, by number, and their products.
        maps = [tuple(range(8))]
        number = {maps[0]: 0}
        generators = [tuple(step[:, s].tolist()) for s in range(17)]
        for m in maps:  # grows as it is read
            for g in generators:
                product = tuple(g[x] for x in m)
                if product not in number:
                    number[product] = len(maps)
                    maps.append(product)
        self.maps = np.array(maps, np.uint8)
        self.of_symbol = np.array([number[g] for g in generators], np.uint16)
        self.then = np.array([[number[tuple(b[x] for x in a)] for b in maps] for a in maps], np.uint16)

    def begins(self, symbols: np.ndarray) -> np.ndarray:
        """Where words begin, for the symbols of one or many texts."""
        rows = -(-len(symbols) // _WIDTH)
        padded = np.full(rows * _WIDTH, _IDLE, np.uint8)
        padded[: len(symbols)] = symbols
        by_step = np.ascontiguousarray(padded.reshape(rows, _WIDTH).T)  # a row holds one step of all chunks
        whole = np.zeros(rows, np.uint16)
        for one in by_step:
            whole = self.then[whole, self.of_symbol[one]]
        # Inclusive scan of the chunks' maps: after round r each covers 2**r chunks up to its own.
        reach = 1
        while reach < rows:
            whole[reach:] = self.then[whole[:-reach], whole[reach:]]
            reach *= 2
        state = np.full(rows, _FRESH, np.uint8)
        state[1:] = self.maps[whole[:-1], _FRESH]
        found = np.zeros(by_step.shape, bool)
        for i, one in enumerate(by_step):
            found[i] = self.begin[state, one]
            state = self.step[state, one]
        return found.T.reshape(-1)[: len(symbols)]


def symbols_of(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitter's symbols from the classes of characters; ``first`` marks the first one of each text."""
    n = len(kind)
    after = np.full(n + 2, _WHITE, np.uint8)  # what follows inside the text: nothing counts as white space
    after[:n] = kind
    ends = np.append(first[1:], [True, True])
    next1 = np.where(ends[:n], _WHITE, after[1 : n + 1])
    next2 = np.where(ends[:n] | ends[1 : n + 1], _WHITE, after[2 : n + 2])
    out = np.array([_LAST_SPACE, _LAST_WHITE, _SYM_LETTER, _SYM_NUMBER, _SYM_OTHER, _SYM_OTHER] + [_SYM_LETTER] * 4, np.uint8)[kind]
    white = kind <= _WHITE
    out[white & (next1 <= _WHITE)] = _MORE_WHITE
    mark = np.flatnonzero(kind == _APOSTROPHE)
    a, b = next1[mark], next2[mark]
    out[mark[a == _STMD]] = _CUT1
    out[mark[((a == _RV) & (b == _E)) | ((a == _L) & (b == _L))]] = _CUT2
    out[first] += _BEGINS
    return out


class Counter:
    """Byte-level BPE as a transducer whose transitions carry the number of tokens they add."""

    def __init__(self, vocabulary: bytes, states: int):
        spec = json.loads(vocabulary)
        byte, ids = byte_alphabet(), spec["model"]["vocab"]
        if spec["model"].get("ignore_merges") or spec["model"].get("continuing_subword_prefix") or spec["model"].get("end_of_word_suffix") or spec["model"].get("dropout"):
            raise ValueError("only plain byte-level BPE is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.limit = states
        self.rank: dict[int, int] = {}  # of a pair of ids that merges
        self.built: dict[int, int] = {}  # rank at which a token is built; single bytes are there from the begin
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            if whole in self.parts or any(t not in self.parts and len(text) > 1 for t, text in ((left, a), (right, b))):
                raise ValueError("a token must be built once, after its parts")
            self.rank[left << 32 | right], self.built[whole], self.parts[whole] = rank, rank, (left, right)
        self.arc: dict[int, int] = {}  # trie of the tokens: node and byte to node
        self.token = [-1]
        for text, i in ids.items():
            if text in byte or i in self.parts:
                node = 0
                for c in text:
                    node = self.arc.setdefault(node << 8 | byte[c], len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                self.token[node] = i
        self.inner = bytearray(len(self.token))
        for key in self.arc:
            self.inner[key >> 8] = 1
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states."""
        begin = ((0, -1, 0),)  # at the root of the trie, no token before, no tokens
        self.state = [begin]
        self.number = {begin: 0}
        self.moves: dict[int, int] = {}  # state and byte to the next state and the tokens added
        self.pairs: dict[int, bool] = {}  # what is known of neighbours
        self.edges: tuple[dict, dict] = ({}, {})

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that are at the right (1) or left (0) edge while ``token`` is built: each with the
        rank at which it is used up."""
        out = self.edges[side].get(token)
        if out is None:
            gone, at = 1 << 62, token
            out = self.edges[side][token] = [(at, gone)]
            while at in self.parts:
                gone, at = self.built[at], self.parts[at][side]
                out.append((at, gone))
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge over their edge while both its sides are there."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found, right, known = True, self._edge(b, 0), self.rank.get
            for x, a_gone in self._edge(a, 1):
                x <<= 32
                for y, b_gone in right:
                    rank = known(x | y)
                    # Of equal ranks the leftmost pair merges first.
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        found = False
            self.pairs[key] = found
        return found

    def _compile(self, state: int, b: int) -> int:
        """The move of a state by a byte: next state << 16 | tokens added + 2**15."""
        open_, last, added = [], -1, 0
        for node, before, more in self.state[state]:
            child = self.arc.get(node << 8 | b)
            if child is None:
                continue
            token = self.token[child]
            if last < 0 <= token and (before < 0 or self.neighbours(before, token)):
                last, added = token, more + 1
            if self.inner[child]:
                open_.append((child, before, more))
        now = (*((node, before, more - added) for node, before, more in open_), (0, last, 0))
        target = self.number.get(now)
        if target is None:
            target = self.number[now] = len(self.state)
            self.state.append(now)
        move = self.moves[state << 8 | b] = target << 16 | added + 32768
        return move

    def count(self, word: bytes) -> int:
        """The number of tokens of one word."""
        if len(self.state) > self.limit or len(self.moves) > 8 * self.limit:
            self.reset()
        known, state, n = self.moves.get, 0, 0
        for i, b in enumerate(word):
            move = known(state << 8 | b)
            if move is None:
                if not i & 4095 and len(self.state) > self.limit:  # a word that alone needs very many states
                    now = self.state[state]
                    self.reset()
                    state = self.number.setdefault(now, 1) if now != self.state[0] else 0
                    if state:
                        self.state.append(now)
                    known = self.moves.get
                move = self._compile(state, b)
            state = move >> 16
            n += (move & 65535) - 32768
        return n


class Tokenizer:
    """Counts the tokens of many texts at once."""

    def __init__(self, vocabulary: bytes, classes: np.ndarray, states: int):
        self.classes, self.splitter, self.counter = classes, Splitter(), Counter(vocabulary, states)

    def _special(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each special token in the texts: leftmost first, never across texts."""
        import regex

        if not self.counter.special:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pattern = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.counter.special, key=len, reverse=True)))
        found, at, data = [], 0, raw.tobytes()
        hits = list(pattern.finditer(data, overlapped=True))
        if hits:
            text = np.searchsorted(off, [m.start() for m in hits], "right") - 1
            for m, t in zip(hits, text.tolist()):
                if m.start() >= at and m.end() <= off[t + 1]:
                    found.append(m.span())
                    at = m.end()
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def count_all(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text raw[off[i]:off[i + 1]]."""
        texts = len(off) - 1
        total = np.zeros(texts, np.int64)
        if not len(raw):
            return total
        special, behind = self._special(raw, off)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # The byte at which each character begins.
        if len(points) == len(raw):
            place = np.arange(len(raw) + 1)
        else:
            place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        first[special] = first[behind] = True
        begins = self.splitter.begins(symbols_of(self.classes[points], first[place[:-1]]))
        starts = place[:-1][begins]
        ends = np.append(starts[1:], len(raw))
        each = np.ones(len(starts), np.int64)  # a special token is one token
        plain = np.ones(len(starts), bool)
        if len(special):
            at = np.searchsorted(special, starts, "right") - 1
            plain = (at < 0) | (starts >= behind[np.maximum(at, 0)])
            each[~plain] = special[np.maximum(at, 0)][~plain] == starts[~plain]
        words = np.flatnonzero(plain)
        a, b = starts[words], ends[words]
        own, kind = kinds(raw, a, b, word_hashes(raw, a, b, 13))
        data, count = raw.tobytes(), self.counter.count
        n = np.array([count(data[i:j]) for i, j in zip(a[own].tolist(), b[own].tolist())], np.int64)
        if len(words):
            each[words] = n[kind]
        upto = np.append(0, np.cumsum(each))
        at = np.searchsorted(starts, off)
        return upto[at[1:]] - upto[at[:-1]]


_KEPT: dict[str, Tokenizer] = {}  # the worker's, by what was broadcast; one at a time


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, states: int = 300_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The vocabulary file is read on the driver and broadcast (some 2 MB for 50 000 tokens) with the
    classes of characters (1.1 MB).
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), character_classes()))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Tokenizer(*sent.value, states)
        tokenizer = _KEPT[key]
        for batch in batches:
            for part in chunks(batch, "text", _PIECE):
                raw, off = buffers(part.column(1))
                n = tokenizer.count_all(raw, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
