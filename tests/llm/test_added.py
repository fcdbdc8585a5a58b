"""Token counts, periodic runs and source divergence against brute force, and their defined cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slopeline.llm import queries as Q
from slopeline.llm import repeat_runs as RR
from slopeline.llm import source_divergence as DV
from slopeline.llm import token_count as TC
from slopeline.llm.common import NOT_SPACE, buffers, word_spans

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, docs string, n int, value string, rank string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))
TEXTS = [
    (1, "Hello there world"), (2, None), (3, ""), (4, LONG), (5, "HELLO there world"), (5, "HELLO there world"), (None, "a text without id " * 20), (6, "\n\t \n"), (7, LONG + " end"),
    (8, "Straße ÉTÉ <|endoftext|> 日本 😀"), (None, None), (9, "x" * 20000), (10, "ab " * 40 + "c " * 90), (11, "don't we'll '' 's\x1c\u0085 1a"),
]


def odd_docs(spark, empty=False):
    """Nulls everywhere, empty and long texts, repeated rows, ties, columns whose names clash with internal ones."""
    rows = [(i, t, "en" if i != 3 else None, f"s{i % 3}" if i else None, 1, "t", "d", 2, "v", "r") for i, t in TEXTS]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def counter():
    with open(VOCAB, "rb") as f:
        return TC.Tokenizer(f.read(), TC.character_classes(), 2000)


def counted(counter, texts):
    raw, off = buffers(pa.array(texts))
    return counter.count_all(raw, off).tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_token_counts(spark, tokenizer, empty):
    docs = odd_docs(spark, empty)
    got = sorted(map(tuple, TC.token_counts(docs, VOCAB, limit=100).collect()), key=repr)
    want = []
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)


def test_token_counts_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op13_token_count(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 1024)


def test_token_counts_of_random_texts(counter, tokenizer):
    """Many states, so that the transducer also begins anew."""
    rng = random.Random(5)
    parts = ["a", "b", "abc", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "'re", "'v", "'", "''", "e", "!", "..", "<|endoftext|>", "<|endof", "日本", "😀", "\r\n", "²", "\x00", "\x1c", "\u0085", "ing", "the", "----"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x52F), rng.randint(0x3040, 0x9FFF)])) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["a" * 50000, " " * 3000, "-" * 5000, "ab" * 9000, "".join(rng.choice("acgt") for _ in range(30000))]
    assert counted(counter, texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_character(counter, tokenizer):
    points = [*range(0x3000), *range(0xF900, 0x10000), *range(0x1F000, 0x1FB00)]
    texts = ["a" + chr(c) + "1 " + chr(c) + chr(c) + "!" for c in points]
    assert counted(counter, texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_split_across_chunks(counter, tokenizer):
    """The scan over chunks gives each chunk its entry state wherever the chunks' borders lie."""
    for shift in range(0, 130, 7):
        text = "x" * shift + " it's   what\n\n 'll we've 12 !! 'twas " * 9
        assert counted(counter, [text, "", text[5:]]) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, "", text[5:])]


def test_vocabulary_that_cannot_be_compiled():
    import json

    with open(VOCAB, "rb") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        TC.Counter(json.dumps(spec).encode(), 10)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(least, times * q) and all(any(a != b for a, b in zip(part, part[d:])) for d in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = (None,) * 4
    if runs:
        from fractions import Fraction

        s, size, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, size, q, 1000 * size // q)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_text(rng):
    k, out = rng.choice([1, 2, 3, 8, 50]), []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.4:
            out += [f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 60))]
        else:
            unit = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4:
                unit = unit[: len(unit) // 2 + 1] * rng.randint(1, 5) + unit
            out += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
    return rng.choice([" ", "\n", "  "]).join(out)


@pytest.mark.parametrize("empty", [False, True])
def test_periodic_runs(spark, empty):
    rng = random.Random(7)
    docs = odd_docs(spark, empty)
    if not empty:
        docs = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, random_text(rng)) for i in range(400)], "doc_id long, text string"))
        docs = docs.where("doc_id IS NULL OR doc_id NOT IN (4, 7)")  # too long for the brute force
    got = RR.collapse_runs(docs, planted=True, with_digest=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert empty or any(r.n_runs > 1 for r in got)


def test_runs_and_kept_text(spark):
    docs = spark.createDataFrame([(1, "a b  " + "x y z\n" * 10 + "c"), (2, None), (3, "one two")], "doc_id long, text string")
    got = {r.doc_id: r for r in RR.collapse_runs(docs, with_text=True, with_runs=True).collect()}
    assert [tuple(r) for r in got[1].runs] == [(2, 30, 3)] and got[1].kept == "a b x y z c" and got[1].exponent_milli == 10000
    assert got[2].kept == "" and got[2].runs == [] and got[3].kept == "one two" and got[3].start is None


def test_long_periods():
    """Documents of one run, whose period is up to a third of their length."""
    for n, q in ((300_000, 1), (300_000, 1000), (300_001, 100_000), (24, 8), (23, 7)):
        raw, off = buffers(pa.array([" ".join(str(i % q) for i in range(n))]))
        starts, ends, first = word_spans(raw, off, NOT_SPACE)
        found = RR.find_runs(RR.Words(raw, starts, ends, np.append(first[:-1], len(starts))))
        assert [x.tolist() for x in found] == ([[0], [n], [q]] if n >= 24 else [[], [], []])


def test_periodic_runs_query(spark):
    sf = "/root/testdata/sf0.001"
    short = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000}
    got = [tuple(r) for r in Q.op11_periodic_runs(spark, sf).collect() if r.doc_id in short]
    assert sorted(got) == sorted(brute_row(i, t) for i, t in short.items())


def brute_divergence(rows, least=3, top=200):
    rows = [(lang or "", source or "", re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")) for lang, source, text in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, whole = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, found in rows:
        found = [t.translate(low) for t in found]
        docs.update((lang, t) for t in set(found))
        count[lang, source].update(found)
        whole[lang].update(found)
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    share = lambda c, own: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in own) + len(own)) for t in own}
    p = {g: share(c, kept[g[0]]) for g, c in count.items()}
    q = {lang: share(c, kept[lang]) for lang, c in whole.items()}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for lang, source in p:
        pairs = [(s, sum(f(p[lang, source][t], p[lang, s][t]) for t in kept[lang])) for x, s in p if x == lang and s != source]
        terms = [(t, f(p[lang, source][t], q[lang][t])) for t in kept[lang] if count[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


@pytest.mark.parametrize("empty", [False, True])
def test_source_divergence(spark, empty):
    rng = random.Random(9)
    docs = odd_docs(spark, empty).select("lang", "source", "text", "doc_id", "term", "docs", "n", "value", "rank")
    if not empty:
        letters = ["a", "b", "é", "日", "C", "ß"]
        vocab = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 17, 40, 130]))) for _ in range(80)]
        vocab += [v + rng.choice(letters) for v in vocab]
        rows = [(rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", " ".join(rng.choice(vocab[: rng.choice([20, 160])]) for _ in range(rng.randint(0, 30)))) for _ in range(120)]
        rows += [("xx", "only", "rare words"), ("xx", "other", None), ("zz", "alone", "one")]
        docs = docs.unionByName(spark.createDataFrame(rows, "lang string, source string, text string"), allowMissingColumns=True)
    got = sorted(map(tuple, DV.source_divergence(docs, top=7).collect()))
    assert got == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()], top=7)


def test_divergence_discards_rare_prefixes(spark):
    """A long term goes on only while its prefix has documents enough."""
    rows = [("en", "a", "common rarelongwordnumberone"), ("en", "a", "common rarelongwordnumbertwo"), ("en", "b", "common commonlongwordofthree"), ("en", "b", "commonlongwordofthree"), ("en", "b", "COMMONLONGWORDOFTHREE")]
    _, terms = DV.kept_terms(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted((r.source, r.term, r.n, r.lang_n) for r in terms.collect()) == [("a", "common", 2, 3), ("b", "common", 1, 3), ("b", "commonlongwordofthree", 3, 3)]
