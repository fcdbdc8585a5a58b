"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a
shunting-yard parser evaluates the licence expressions behind the tags.

The automaton runs over each whole text, its words (lower-cased A-Z; letters, digits and
everything beyond ASCII) joined by single spaces, so that line breaks and punctuation inside a
notice do not matter. It has a few dozen phrases, whatever the input: each Python worker builds
it once. Texts are scanned where they are read; nothing is shuffled.

Defined cases: a null text counts as empty (no words, no labels, score 0); places may overlap
and each counts; a tag with a malformed expression yields its known identifiers and
``expression_valid`` false; rows are independent, so repeated rows give repeated results; very long
texts are scanned whole in time that follows their length; an empty table gives no rows; extra
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, tidy

# The phrases of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices beyond the base: phrase, label.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "boost",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}

#: The words of an identifier tag; an expression follows it in the text.
TAG = "spdx license identifier"

#: Licences that allow use in other works; an expression is judged by these.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "boost", "cc0", "cc-by-4.0", "cc-by-3.0", "unlicense", "zlib")

_WORD_SEP = re.compile(rb"[^0-9a-z\x80-\xff]+")
_TAG_AT = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t:=\-*]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[0-9A-Za-z][0-9A-Za-z.+\-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> tuple[list[str], bool]:
    """Shunting-yard: tokens of a licence expression in postfix order, and whether it is well formed.

    WITH binds closer than AND, AND closer than OR. Reading stops at the first token that can't
    follow (an expression is often followed by other text, such as the end of a comment).
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether an operand has just ended
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if not operand:
                return out, False
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    ok = operand and "(" not in stack
    return out + [x for x in reversed(stack) if x != "("], ok


def evaluate(expression: str) -> tuple[list[str], bool | None, bool]:
    """(identifiers, may it be used permissively, well formed) of a licence expression.

    OR offers a choice, AND binds to both sides, WITH keeps the licence and relaxes it.
    """
    postfix, ok = to_postfix(expression)
    names = [x for x in postfix if x not in _RANK]
    values: list[bool] = []
    for x in postfix:
        if x not in _RANK:
            values.append(any(x == p or x.startswith(p + "-") for p in PERMISSIVE))
        elif len(values) >= 2:
            right, left = values.pop(), values.pop()
            values.append(left or right if x == "or" else left and right if x == "and" else left)
    return names, (values[0] if ok and len(values) == 1 else None), ok


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str, automaton) -> dict:
    """All places of phrases and tags in one text."""
    low = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    words = _WORD_SEP.sub(b" ", low).strip(b" ").decode("latin-1")
    row = {"n_words": words.count(" ") + 1 if words else 0, "n_base": 0, "first_word": None, "last_word": None, "n_places": 0, "expression": None, "expression_valid": None, "permissive": None}
    base, labels = set(), set()
    hits = list(automaton.iter(f" {words} ")) if words else []
    tagged, seen, at = False, 0, 0
    for end, phrase in hits:
        row["n_places"] += 1
        if phrase in BASE:
            start = end - len(phrase) - 1
            # Spaces are counted on from the place before; a longer phrase may begin a little before it.
            at += words.count(" ", seen, start) if start >= seen else -words.count(" ", start, seen)
            seen = start
            row["n_base"] += 1
            row["first_word"] = at if row["first_word"] is None else min(row["first_word"], at)
            row["last_word"] = at if row["last_word"] is None else max(row["last_word"], at)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        tagged |= phrase == TAG
    if tagged:
        for m in _TAG_AT.finditer(low.decode("utf-8", "surrogatepass")):
            names, permissive, ok = evaluate(m[1])
            labels.update(names)
            if row["expression"] is None:
                row |= {"expression": m[1].strip(), "expression_valid": ok, "permissive": permissive}
    row["base_labels"] = ",".join(sorted(base))
    row["labels"] = ",".join(sorted(base | labels))
    # Each place halves the doubt that the text carries a licence.
    row["score"] = 1.0 - 0.5 ** min(row["n_places"], 50)
    return row


_FIELDS = [
    ("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"),
    ("n_places", pa.int64(), "long"), ("expression", pa.string(), "string"), ("expression_valid", pa.bool_(), "boolean"), ("permissive", pa.bool_(), "boolean"),
]


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and what ``scan_text`` finds in the whole text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [scan_text(t or "", automaton) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind, _ in _FIELDS)], ["doc_id", *(k for k, _, _ in _FIELDS)])

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {kind}" for k, _, kind in _FIELDS))
