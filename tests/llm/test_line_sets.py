"""Comparing lines of a bucket: bounds by bitmaps, exact counts, keys whose rows come in any order."""

import random

import numpy as np
import pyarrow as pa
import pytest

from slopeline.llm import line_dedup as LD


def lines(alphabet, n, size, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = list("".join(rng.choices(alphabet, k=rng.randint(6, size))))
        for _ in range(4):  # the line and copies that differ more and more
            out.append("".join(s))
            for _ in range(1 + len(s) // 40):
                s[rng.randrange(len(s))] = rng.choice(alphabet)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "aé漢字\U0001f600 b"])
@pytest.mark.parametrize("size", [12, 300, 3000])
def test_bitmaps_lose_no_similar_pair(alphabet, size):
    told = lines(alphabet, 12, size)
    sets = LD._Sets(told, 6)
    n = similar = 0
    for i in range(len(told)):
        for j in range(i + 1, len(told)):
            exact = LD.jaccard(told[i], told[j], 6)
            assert sets.similar(i, j) == exact
            near = sets.near(np.array([i]), np.array([j]), 0.8)[0]
            assert near or exact < 0.8
            n, similar = n + 1, similar + (exact >= 0.8)
    assert 0 < similar < n


def test_few_pairs_are_counted_exactly(monkeypatch):
    """Before, every pair of a small bucket between different components was counted by Python sets."""
    told = lines("abcdefghijklmnopqrst ", 10, 400)
    exact = [(i, j) for i in range(len(told)) for j in range(i + 1, len(told)) if LD.jaccard(told[i], told[j], 6) >= 0.8]
    counted = []
    own = LD._Sets.similar
    monkeypatch.setattr(LD._Sets, "similar", lambda self, i, j: counted.append((i, j)) or own(self, i, j))
    links = LD.group_links(list(range(len(told))), list(range(len(told))), told, 6, 0.8)
    assert set(links) <= set(exact) and len(counted) <= len(exact) + 10
    root = list(range(len(told)))
    for i, j in exact:
        root = [root[i] if r == root[j] else r for r in root]
    assert len(links) == len(told) - len(set(root))


def test_group_links_of_large_groups(monkeypatch):
    """Row by row, where a group's bitmaps are too many for all pairs at once: the same components."""
    told = lines("abcdefghijklmnopqrst ", 30, 200)
    links = LD.group_links(list(range(len(told))), list(range(len(told))), told, 6, 0.8)
    monkeypatch.setattr(LD, "_BITMAPS", 1 << 14)
    assert LD.group_links(list(range(len(told))), list(range(len(told))), told, 6, 0.8) == links


def test_keys_need_no_order_of_ids():
    """Before, equal lines that several tasks had sent were told apart from others by their order within a key."""
    rows = [(1, 5, 0), (2, 7, 3), (2, 9, 3), (2, 7, 3), (3, 4, 1), (3, 4, 1), (4, 6, 0), (4, 8, (1 << 40) - 1), (4, 6, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 2])], ["key", "id", "sketch"]) for i in range(0, len(rows), 2)]
    got = [tuple(r.values()) for b in LD._buckets(18, 1024)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(2, 7, 3), (2, 9, 3)]
