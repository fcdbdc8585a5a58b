"""Corpus operators on small inputs: defined edge cases, and brute force where SQL can't tell."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from slopeline.llm import bpe as B
from slopeline.llm import components as CC
from slopeline.llm import cover_tree as CT
from slopeline.llm import exact_dedup as ED
from slopeline.llm import language as LG
from slopeline.llm import licenses as LC
from slopeline.llm import line_dedup as LD
from slopeline.llm import mixing as MX
from slopeline.llm import queries as Q
from slopeline.llm import simhash as SH
from slopeline.llm import substring_dedup as SD
from slopeline.llm import toxicity as TX
from slopeline.llm.common import buffers

P = pytest.importorskip("public_tokenizers")
VOCAB = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, fp string, row string, tox_flag int"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))


def odd_docs(spark, empty=False):
    """Nulls everywhere, empty and long texts, repeated rows, ties, columns whose names clash with internal ones."""
    texts = [(1, "Hello there world"), (2, None), (3, ""), (4, LONG), (5, "HELLO there world"), (5, "HELLO there world"), (None, "a text without id"), (6, "\n\t \n"), (7, LONG + " end"), (8, "Straße ÉTÉ <|endoftext|> 日本 😀"), (None, None)]
    rows = [(i, t, "en" if i else None, "src" if i != 3 else None, len(t) if t is not None else None, "d", "f", "r", 7) for i, t in texts]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("empty", [False, True])
def test_exact_dedup(spark, empty):
    docs = odd_docs(spark, empty)
    got = ED.exact_dedup(docs, digest_all=True).collect()
    lazy = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ED.exact_dedup(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == lazy
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    assert len(got) == len(rows)
    for r in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("empty", [False, True])
def test_bpe_round_trip(spark, empty):
    from tokenizers import Tokenizer

    docs = odd_docs(spark, empty)
    tok = Tokenizer.from_file(VOCAB)
    got = sorted(((r.doc_id, tuple(r.ids), r.decoded, r.n_tokens) for r in B.bpe(docs, VOCAB, with_text=True).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, tuple(ids), tok.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want, key=repr)


def test_bpe_random_texts_and_lexicon(tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    with open(VOCAB, "rb") as f:
        v = B.Vocabulary(f.read())
    known = {w.encode(): v.merged(w.encode()) for w in ("ab", "abc", " abc", "xbc", "é", " the", "1")}
    (tmp_path / "lexicon").write_bytes(B.compile_lexicon(known))
    lexicon = B.Lexicon(str(tmp_path / "lexicon"))
    assert all(lexicon.get(w) == ids for w, ids in known.items()) and lexicon.get(b"a") is None and lexicon.get(b"") is None and lexicon.get(b"abcd") is None
    e, rng = B.Encoder(v, lexicon), random.Random(1)
    probes = [*known, b"", b"a", b"abcd", b"x" * 60, b"\xc3"] + ["".join(rng.choice("abc etionrs\xe9\u65e5") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    assert [None if x is None else np.frombuffer(x, "<u4").tolist() for x in lexicon.get_all(probes)] == [lexicon.get(w) for w in probes]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merged_all(probes)] == [v.merged(w) for w in probes]
    parts = ["a", "b", "abc", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "!", "..", "<|endoftext|>", "日本", " ", " ", "😀", "\r\n", "²", "\x00", "\x1c", "\u0085"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(s), "<u4").tolist() == ids
        assert e.decode(e.encode(s)) == tok.decode(ids, skip_special_tokens=False)


def brute_spans(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(90)]
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    for i in range(10, 40):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 160))]
        cut = passage[: rng.randint(40, 90)] if i % 3 else passage
        if i % 5 == 0:
            cut = ["a", "b"] * 60  # repeats inside and across documents
        rows.append((i, "  ".join(body[:50] + cut + body[50:])))
    rows += [rows[15], (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for anchor in (20, 50, 7):
        got = SD.substring_dedup(docs, anchor=anchor).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_spans(rows, 50)
    assert SD.substring_dedup(odd_docs(spark, True), with_digest=True).count() == 0


@pytest.mark.parametrize("size", [55, 60, 80])
def test_substring_dedup_opens_every_place_of_a_document(spark, size):
    passage = [f"p{i}" for i in range(size)]
    fill = [[f"{side}{i}" for i in range(60)] for side in "abcd"]
    rows = [(1, " ".join(["x"] * 3 + passage)), (2, " ".join(fill[0] + passage + fill[1] + fill[0] + passage + fill[1]))]
    rows += [(2, " ".join(fill[2] + passage + fill[3]))]  # a second text with the same id
    got = SD.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_spans(rows, 50)


def test_substring_dedup_tells_apart_what_polynomials_confuse(spark):
    """Words and arrangements of words that a polynomial modulo a power of two can't tell apart."""
    morse = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[x] for x in morse), "".join("ba"[x] for x in morse)
    lead, tail = [f"l{i}" for i in range(25)], [f"t{i}" for i in range(44)]
    rest = [[f"{c}{i}" for i in range(30)] for c in "xy"]
    rows = [(1, " ".join(rest[0] + lead + [one] + tail)), (2, " ".join(rest[1] + lead + [two] + tail))]
    rows += [(3, " ".join("AB"[x] for x in morse)), (4, " ".join("BA"[x] for x in morse))]
    got = SD.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_spans(rows, 50)
    assert next(r.n_removed for r in got if r.doc_id == 2) == 0


def fingerprint(text, shingle=4):
    from xxhash import xxh64_intdigest

    w = words(lower(text))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(keys, 2):
        if linked(a, b):
            root[find(b)] = find(a)
    return {k: find(k) for k in keys}


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_groups(rows, similarity=0.8):
    """The smallest id that similar texts connect each id with, by all pairs."""
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both >= similarity * (len(sets[a]) + len(sets[b]) - both)

    comp, least = brute_components(sorted(sets), linked), {}
    for i, c in comp.items():
        least[c] = min(least.get(c, i), i)
    return {i: least[c] for i, c in comp.items()}


def edited_copies(seed):
    """Five copies of a text, each with a few words changed: about as similar as is asked for."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    out = []
    for _ in range(5):
        copy = list(base)
        for _ in range(rng.randint(4, 5)):
            copy[rng.randrange(400)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_links_that_a_failed_link_hides(spark, block):
    """A forest of near rows takes a link that the texts don't bear out before one that they do; none is lost."""
    rows = []
    for seed in (2, 3, 5, 16, 22, 28, 33, 35):
        rows += [(len(rows) + i, text) for i, text in enumerate(edited_copies(seed))]
    h, begin = SH.shingle_hashes(*buffers(pa.array([t for _, t in rows])), 5, 42)
    fp, sets = SH.majority(h, begin).tolist(), [shingles(t) for _, t in rows]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    due = brute_components(range(len(rows)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 9 and similar(a, b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in SH.keep_one(docs, shingle=5, similarity=0.8, distance=9, segments=5, block=block).collect()}
    assert kept == {min(i for i in due if due[i] == c) for c in set(due.values())}


@pytest.mark.parametrize("block", [2048, 9])
def test_near_copies_by_verified_similarity(spark, block):
    """Chains of edited copies: every removed document is due, and nearly all that are due go."""
    rng, rows = random.Random(14), []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(300)]
        for _ in range(6):
            base = base.copy()
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(base)))
    rows += [(500, "a b c"), (501, "A b  c"), (502, "a b c d"), (503, None), (504, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in SH.keep_one(docs, shingle=5, similarity=0.8, distance=9, segments=5, block=block).collect()}
    least = similar_groups(rows)
    gone, due = {i for i, _ in rows} - kept, {i for i, k in least.items() if i != k}
    assert gone <= due and len(gone) >= 0.95 * len(due) > 20
    assert SH.keep_one(odd_docs(spark), similarity=0.8, distance=9, segments=5).count() == SH.keep_one(odd_docs(spark)).count()


@pytest.mark.parametrize("block", [2048, 9])
def test_simhash(spark, block):
    rng = random.Random(4)
    base = [f"tok{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    for i in range(20, 60):  # a chain of near copies
        base = base.copy()
        base[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(base)))
    got = SH.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    fps = {fingerprint(t) for _, t in rows}
    comp = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        c = comp[fingerprint(t)]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(((i, f"{fingerprint(t):016x}", least[comp[fingerprint(t)]]) for i, t in rows), key=repr)
    assert SH.simhash_groups(odd_docs(spark, True)).count() == 0


def test_simhash_links_of_dense_keys(spark):
    rng = random.Random(9)
    fps = sorted({(0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = SH.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=16)
    comp = {r.id: r.component for r in CC.components(links).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    for a, b in itertools.combinations(signed, 2):
        assert (comp.get(a, a) == comp.get(b, b)) == (want[a] == want[b])


def test_components_of_long_chains(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(500, 501), (501, 502), (7, 7), (None, 3)]
    got = {r.id: r.component for r in CC.components(spark.createDataFrame(links, "a long, b long").repartition(20)).collect()}
    assert got == {i: 0 for i in ids} | {500: 500, 501: 500, 502: 500}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(120):
        v = base[i % 6] + rng.normal(size=16) * (0.03 if i % 4 else 0.3)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [1.0, None], 0), (204, rows[0][1], None), (205, rows[0][1], rows[0][2]), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (209, [float("inf")] * 16, 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, x, p), (_, y, q) = a, b
        if not (ok(x, p) and ok(y, q) and p == q and len(x) == len(y)):
            return False
        x, y = np.array(x), np.array(y)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    n, link = collections.Counter(), set()
    for a, b in itertools.combinations(rows, 2):
        if linked(a, b):
            n[a[0]] += 1
            n[b[0]] += 1
            link.add((a[0], b[0]))
    assert link
    root = brute_components([r[0] for r in rows], lambda a, b: (a, b) in link)
    least = {}
    for k, c in root.items():
        least[c] = min(least.get(c, k), k)
    for leaf in (1024, 5):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in CT.embedding_dedup(docs, leaf=leaf).collect()}
        assert got == {k: (n[k], least[c], least[c] == k) for k, c in root.items()}
    assert CT.embedding_dedup(spark.createDataFrame([], docs.schema)).count() == 0


def test_cover_tree_prunes_and_keeps_all_pairs():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8))
    x = np.repeat(centre, 20, 0) + rng.normal(size=(240, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CT.CoverTree(x)
    met = {(i, j) for a, b in CT.dual(tree, tree, 0.2) for i in a.tolist() for j in b.tolist()}
    near = {tuple(p) for p in np.argwhere(((x[:, None] - x[None]) ** 2).sum(2) <= 0.04).tolist()}
    assert near <= met and len(met) < 240 * 240 / 3


def test_mixing_deviates_by_less_than_a_block(spark):
    rows = [(i, "abcd"[min(3, i * 7 % 11 // 3)] if i % 50 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = MX.mix_sources(docs, block_rows=8, period=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(900)) and len({r.mix_position for r in got}) == 900
    for phase in {r.mix_phase for r in got}:
        own = [r for r in got if r.mix_phase == phase]
        start, end = min(r.mix_slot for r in own), max(r.mix_slot for r in own)
        blocks = {(r.source or "", r.mix_block): (r.mix_slot, r.mix_weight) for r in own}
        for s in {k[0] for k in blocks}:
            slots = sorted(x for (src, _), (x, _) in blocks.items() if src == s)
            weight = next(w for (src, _), (_, w) in blocks.items() if src == s)
            for t in range(start, end + 1):
                assert abs(sum(x <= t for x in slots) - weight * (t - start + 1)) < 1
    assert MX.mix_sources(odd_docs(spark)).count() == 11 and MX.mix_sources(odd_docs(spark, True)).count() == 0
    weighed = MX.mix_sources(docs, {"a": 3, "b": 1}, block_rows=8, period=100)
    last = max(r.mix_position for r in weighed.where("source in ('a', 'b')").collect())
    assert min(r.mix_position for r in weighed.where("source in ('c', 'd')").collect()) > 0 and last >= 0
    with pytest.raises(ValueError):
        MX.mix_sources(docs, max_sources=2)


@pytest.mark.parametrize("sizes", [{"big": 8000} | {f"s{i}": 800 for i in range(20)}, {"big": 9000} | {f"s{i}": 100 for i in range(300)}])
@pytest.mark.parametrize("temperature", [0.5, 1.0])
def test_mixing_stays_within_a_block_of_the_targets(spark, sizes, temperature):
    """At every slot, against the weights asked for, over more slots than a thousand."""
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = MX.mix_sources(docs, temperature=temperature, block_rows=1).select("source", "mix_phase", "mix_slot", "mix_weight", "mix_position").collect()
    assert sorted(r.mix_position for r in got) == list(range(sum(sizes.values())))
    own = sorted((r.mix_slot, r.source, r.mix_weight) for r in got if r.mix_phase == 0)
    total = sum(n**temperature for n in sizes.values())
    target = {s: n**temperature / total for s, n in sizes.items()}
    assert all(abs(w - target[s]) < 1e-9 for _, s, w in own)
    index = {s: k for k, s in enumerate(sizes)}
    taken = np.zeros((len(own), len(sizes)))
    taken[np.arange(len(own)), [index[s] for _, s, _ in own]] = 1
    ideal = np.outer(np.arange(1, len(own) + 1), [target[s] for s in sizes])
    assert np.abs(np.cumsum(taken, 0) - ideal).max() < 1 + 1e-6


def test_one_period_meets_all_deadlines():
    rng = random.Random(6)
    for _ in range(60):
        weights = {f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 9))}
        share = MX.shares(weights, 97)
        assert sum(share.values()) == 97
        slots = MX.one_period(share, 97)
        for s, n in share.items():
            for i, t in enumerate(slots[s], 1):
                assert (i - 1) * 97 // n <= t < -(-i * 97 // n)


def test_licenses(spark):
    text = "X\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nAll rights  reserved. ALL-RIGHTS,RESERVED cc by CC-BY-NC general public\nlicense"
    r = {r.doc_id: r for r in LC.license_scan(spark.createDataFrame([(1, text), (2, None), (3, "É général public license"), (None, "cc by cc by")], "doc_id long, text string")).collect()}
    assert (r[1].n_base, r[1].base_labels) == (5, "cc-by,gpl,reserved")
    assert r[1].expression_valid and r[1].permissive is False and {"mit", "apache-2.0", "gpl-2.0-only", "cc-by-nc"} <= set(r[1].labels.split(","))
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].labels, r[2].score) == (0, 0, None, "", 0.0)
    assert (r[3].n_words, r[3].n_base) == (4, 0)
    assert (r[None].n_base, r[None].first_word, r[None].last_word) == (2, 0, 2)
    assert LC.license_scan(odd_docs(spark)).count() == 11 and LC.license_scan(odd_docs(spark, True)).count() == 0


def base_places(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_columns_against_brute_force(spark):
    rng = random.Random(21)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "lesser", "é", "x1", "\n", "…", "0", "nc", "MIT license", "SPDX-License-Identifier: MIT"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(20_000, "cc by lesser general public license, all rights reserved " * 20_000)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in LC.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base_places(t) for i, t in rows}


def test_licences_are_known_by_whole_names():
    assert LC.evaluate("MIT")[1] and LC.evaluate("BSD-3-Clause")[1] and LC.evaluate("Apache-2.0 WITH LLVM-exception")[1]
    assert LC.evaluate("Mitre-1.0")[1] is False and LC.evaluate("Iscx")[1] is False


def test_licence_expressions():
    assert LC.evaluate("MIT OR GPL-3.0") == (["mit", "gpl-3.0"], True, True)
    assert LC.evaluate("MIT AND GPL-3.0")[1] is False
    assert LC.to_postfix("a OR b AND c WITH d") == (["a", "b", "c", "d", "with", "and", "or"], True)
    assert LC.to_postfix("(a OR b) AND c") == (["a", "b", "or", "c", "and"], True)
    for wrong in ("AND MIT", "MIT OR", "(MIT", "", "()"):
        assert LC.evaluate(wrong)[2] is False and LC.evaluate(wrong)[1] is None


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog while the small cat sleeps on the warm mat today"
    near = line.replace("small", "smaLl")
    other = "completely different sentence about rain, slopes, roads and rivers in the high hills of the north"
    rows = [(2, f"{line}\nshort\n{other}"), (1, f"{near} x\nshort"), (3, None), (4, ""), (5, f"  {line.upper()}  \n{other}!\n{other}"), (None, line), (None, "new line that nobody else has in any of the texts here")]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "keep") for i, t in rows], "doc_id long, text string, n_chars long, removed string")
    out = sorted(((r.doc_id, r.text, r.n_chars, r.removed) for r in LD.line_dedup(docs, min_chars=20).collect()), key=repr)
    kept = [(2, f"short\n{other}"), (1, f"{near} x\nshort"), (3, None), (4, ""), (5, ""), (None, ""), (None, rows[-1][1])]
    assert out == sorted(((i, t, None if t is None else len(t), "keep") for i, t in kept), key=repr)
    assert LD.line_dedup(odd_docs(spark)).count() == 11 and LD.line_dedup(odd_docs(spark, True)).count() == 0


def test_line_dedup_query_and_stage_compare_short_lines(spark, tmp_path):
    """All pairs, whatever their length: equal lines below a shingle, near ones above it."""
    rng = random.Random(11)
    pool = ["les.", "a", "日本語の文。", "nt onor. the of it.", "one two three four", "One two three four", "one two three fours", "one two three five"]
    pool += ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 19))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    place = [(i, n, s) for i, t in rows for n, line in enumerate(t.split("\n")) if (s := lower(line.strip()))]
    comp = brute_components(sorted({s for _, _, s in place}), lambda a, b: LD.jaccard(a, b, 6) >= 0.8)
    first, gone = {}, collections.defaultdict(list)
    for i, n, s in place:
        if first.setdefault(comp[s], (i, n)) != (i, n):
            gone[i].append(n)
    got = {r.doc_id: (r.n_compared, r.removed) for r in Q.QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: (sum(p[0] == i for p in place), gone[i]) for i, _ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()}
    assert cut == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    lines = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 40))]
        lines.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = w.copy()
            v[rng.randrange(len(v))] = rng.choice(vocab)
            lines.append(" ".join(v))
    lines = [s for s in dict.fromkeys(lines) if len(s) >= 20]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "doc_id long, text string")
    root = brute_components(range(len(lines)), lambda a, b: LD.jaccard(lines[a], lines[b], 6) >= 0.8)
    want = {i for i, r in root.items() if i != min(k for k, s in root.items() if s == r)}
    got = {r.doc_id for r in LD.duplicate_lines(docs).where("size(removed) > 0").collect()}
    assert got <= want and len(want - got) <= 1 and want


def test_line_signatures_find_similar_lines():
    """Recall of bands and sketches over pairs at similarity 0.8 to 0.9, of all lengths and alphabets."""
    rng, found, n = random.Random(12), 0, 0
    for size in (12, 40, 70, 120, 300, 900):
        for alphabet in ("abcdefghij ", "aäöü éñ日本語xyz "):
            for _ in range(400):
                a = "".join(rng.choice(alphabet) for _ in range(size))
                at = rng.randrange(size)
                b = a[:at] + "".join(rng.choice("qrstuv") for _ in range(rng.randint(1, max(1, size // 12)))) + a[at:]
                if LD.jaccard(a, b, 6) >= 0.8:
                    n += 1
                    sig, few = LD.signatures([a, b], 6, 56)
                    sketch = LD.sketches(sig, few)
                    found += bool((np.diff(LD.band_keys(sig, 14, 4), axis=0) == 0).any() and LD.alike(sketch[:1], sketch[1:], 18)[0])
    assert n > 1500 and found >= 0.998 * n


def test_shingle_codes_do_not_depend_on_the_neighbours():
    a, b = "plain text and more", "plain text 日本語"
    alone = set(LD.shingle_codes([a], 6)[1].tolist())
    line, code = LD.shingle_codes([a, b, "tiny"], 6)
    assert set(code[line == 0].tolist()) == alone and len(alone) == len({a[i : i + 6] for i in range(len(a) - 5)})
    assert len(alone & set(code[line == 1].tolist())) == len({a[i : i + 6] for i in range(6)} & {b[i : i + 6] for i in range(9)})
    assert not (line == 2).any()


def test_line_dedup_takes_very_long_lines_whole(spark):
    rng = random.Random(41)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    near = long[:100_000] + "XYZ" + long[100_000:]
    other = long[:100_000] + "".join(rng.choice("ijklmnop ") for _ in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, near), (3, other), (4, "\n" + long)], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in LD.duplicate_lines(docs).collect()} == {1: [], 2: [0], 3: [], 4: [1]}


def test_operators_take_columns_of_clashing_names(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0], i % 2, "x", i, 5, "y") for i in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, grp string, pid long, w int, ok string")
    plain = {tuple(r) for r in CT.embedding_dedup(vectors.select("vec_id", "embedding", "label")).collect()}
    assert {tuple(r) for r in CT.embedding_dedup(vectors).collect()} == plain and len(plain) == 12
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", i, "keep", 7) for i in range(100)], "doc_id long, source string, mix_slot long, mix_src string, place int")
    out = MX.mix_sources(docs, block_rows=4)
    assert out.count() == 100 and out.columns.count("mix_slot") == 1 and {(r.mix_src, r.place) for r in out.collect()} == {("keep", 7)}
    assert MX.mix_sources(docs, block_rows=1, max_blocks=10).agg({"mix_block": "max"}).first()[0] <= 7


def test_toxicity(spark):
    rng = random.Random(3)
    vocab = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = TX.toxicity(docs, known).where("held_out").collect()
    right = sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in got)
    assert right / len(got) > 0.9 and not any(r.predicted for r in got if r.doc_id % 4)
    odd = TX.toxicity(odd_docs(spark), spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 for r in odd)
    none = TX.toxicity(odd_docs(spark), known.limit(0)).collect()
    assert all(r.predicted == 0 for r in none) and TX.toxicity(odd_docs(spark, True), known).count() == 0


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(7)
    rows = [(np.array(sorted(rng.sample(range(16), 5))), rng.random() < 0.4) for _ in range(80)]
    alpha, beta, l1, l2 = 0.8, 1.0, 0.3, 0.1
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if i < 16 and abs(z[i]) <= l1:
            return 0.0
        shrink = 0.0 if i == 16 else l1 * (1 if z[i] > 0 else -1)
        return -(z[i] - shrink) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for slots, y in rows:
            w = {i: weight(i) for i in [*slots.tolist(), 16]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got, bias = TX.ftrl(rows, 4, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2)
    assert np.allclose(got, [weight(i) for i in range(16)]) and np.isclose(bias, weight(16)) and 0 < np.count_nonzero(got) < 16


def test_toxicity_scores_held_out_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.QUERIES["op6_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r.score for r in got if r.toxic], sorted(r.score for r in got if not r.toxic)
    assert sum(x > good[int(len(good) * 0.9)] for x in bad) >= 0.85 * len(bad)
    assert sum(x >= 0.7 for x in good) <= 0.01 * len(good) and sum(x >= 0.7 for x in bad) >= 0.65 * len(bad)


def test_language(spark):
    rng = random.Random(5)
    speech = {"aa": ["bla", "ble", "blo", "kram"], "bb": ["zin", "zun", "trox", "väl"], "cc": ["ño", "quil", "mest", "ora"]}
    rows = [(i, " ".join("".join(rng.choice(speech[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), k) for i in range(300) for k in [list(speech)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 ...", "bb"), (None, "zin zun", None), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in LG.language_id(docs).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:300] if got[i].held_out)
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1002].score == 0
    assert {r.lang_pred for r in LG.language_id(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert LG.language_id(odd_docs(spark, True)).count() == 0 and LG.language_id(odd_docs(spark)).count() == 11


def test_language_takes_any_number_of_languages(spark):
    rng = random.Random(31)
    stems = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(3)) for _ in range(90 * 4)]
    rows = [(i, " ".join(rng.choice(stems[4 * (i % 90) : 4 * (i % 90) + 4]) for _ in range(80)), f"l{i % 90:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = LG.language_id(docs).where("held_out").collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 90:02d}" for r in got) >= 0.97 * len(got) > 200


def test_language_predictions_against_brute_force(spark):
    """Greedy phrases by searching the labelled texts themselves; ties go to the first name."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = LG.learn(docs)
    sample = [LG.squeeze(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].astype(np.uint8).tobytes() for t in known.texts]

    def phrases(text, labelled):
        n, at = 1, 0
        sym = LG.squeeze(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].astype(np.uint8).tobytes()
        while at < len(sym):
            size = 1
            while at + size <= len(sym) and sym[at : at + size] in labelled:
                size += 1
            if size == 1:  # an unknown character begins a phrase that goes on behind it
                n, at = n + (at > 0), at + 1
                continue
            at += size - 1
            n += at < len(sym)
        return n

    few = [r for r in docs.collect() if r.text and len(r.text) < 3000][:25]
    got = {r.doc_id: r.lang_pred for r in LG.language_id(docs).collect()}
    right = 0
    for r in few:
        n = [phrases(r.text.encode(), x) for x in sample]
        right += got[r.doc_id] == known.names[n.index(min(n))]
    assert right == len(few)


def test_suffix_automaton_parses_greedily():
    text, probe = b"abracadabra banana", b"bananacadab xabra"
    known = LG.Languages({"t": text})
    counts, _ = known.phrases(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]), 512)
    sym = bytes(LG.symbols(np.frombuffer(text, np.uint8)))
    left, n = bytes(LG.symbols(np.frombuffer(probe, np.uint8))), 0
    while left:
        lead = left[:1] not in sym  # an unknown character begins a phrase
        size = lead + max((k for k in range(1, len(left) + 1 - lead) if left[lead : lead + k] in sym), default=0)
        left, n = left[size:], n + 1
    assert counts[0, 0] == n


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, tmp_path, empty):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark, empty)
    cols = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert (docs.columns == cols) == (i < 4), name
    left = [r.doc_id for r in docs.collect()]
    assert left == [] if empty else len(left) == len(set(left)) and 1 in left


def test_pipeline_against_plain_python(spark):
    """Each stage's result on the small tables, by rules written anew."""
    stages = dict(corpus_pipeline.STAGES)
    large = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    clean = {r.doc_id for r in stages["toxicity"](spark, spark.read.parquet(f"{large}/documents.parquet"), large).collect()}
    bad = {i for i, y in toxic.items() if y}
    assert len(bad - clean) >= 0.7 * len(bad) > 0 and len(toxic.keys() - bad - clean) <= 0.01 * len(toxic)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.read.parquet(f"{large}/documents.parquet")  # a few near copies of the smallest tables tell little about recall
    one = stages["simhash near-dedup"](spark, more, large)
    least = similar_groups([(r.doc_id, r.text) for r in more.collect()])
    gone, due = set(least) - {r.doc_id for r in one.collect()}, {i for i, k in least.items() if i != k}
    assert gone <= due and len(gone) >= 0.9 * len(due) > 0
    mixed = stages["mixing"](spark, docs, sf)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, docs.collect()))
    end = corpus_pipeline.run(spark, sf)
    assert end.where("n_tokens <> size(ids)").count() == 0 and 0 < end.count() <= docs.count()


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_embedding_dedup": "vec_id n_links component_id kept",
        "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op4_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op5_simhash": "doc_id fingerprint component_id",
        "op6_toxicity": "doc_id held_out score predicted",
        "op7_language_id": "doc_id held_out lang_pred score",
        "op8_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    }
    for name, cols in want.items():
        out = Q.QUERIES[name](spark, sf)
        assert set(cols.split()) <= set(out.columns), name


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
