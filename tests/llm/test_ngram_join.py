"""The n-gram Jaccard join against all pairs of sets."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from fixtures import awkward, empty, frame
from test_operators import brute_components, texts_of

from voxloom.llm import ngram_join
from voxloom.llm.minhash import WordHashes, shingles


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def small_and_large(seed: int, n: int = 260):
    """Texts of 1 to 120 words: originals, and copies with a word changed, added or left out."""
    r = random.Random(seed)
    out, i = [], 0
    while len(out) < n:
        size = r.choice([1, 3, 5, 6, 9, 12, 15, 18, 20, 23, 40, 120])
        w = [f"w{r.randrange(3000)}" for _ in range(size)]
        out.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 4])):
            v = list(w)
            at = r.choice([0, len(v) - 1, r.randrange(len(v))])
            r.choice([lambda: v.__setitem__(at, "changed"), lambda: v.insert(at, f"new{i}"), lambda: v.pop(at)])()
            v = v or ["left"]
            out.append(" ".join(v).upper() if r.random() < 0.1 else " ".join(v))
            w = v if r.random() < 0.5 else w
            i += 1
    return out


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (1, 2)])
def test_overlaps_and_prefixes(num, den):
    for s, t in itertools.product(range(1, 60), repeat=2):
        c = ngram_join.overlap(s, t, num, den)
        assert den * c >= num * (s + t - c) and den * (c - 1) < num * (s + t - c + 1)
        if c <= min(s, t):
            assert c > s - ngram_join.prefix_length(s, num, den)  # so a shared shingle is within the prefix
            assert t > 30 or c in ngram_join.subset_sizes(s, num, den, 30)
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 400):
        x = np.unique(r.integers(0, 2**63, n, np.uint64))
        chosen, u = ngram_join.prefix_tokens(x, num, den)
        assert len(chosen) >= ngram_join.prefix_length(n, num, den) and len(np.unique(chosen)) == len(chosen)
        assert (chosen[:u] % 16 < ngram_join.SHARE).all() and (chosen[u:] % 16 >= ngram_join.SHARE).all()


def test_boundary_is_the_cheapest():
    assert ngram_join.chosen_boundary({}, {}) == 0
    cost = ngram_join.KEY_COST
    assert ngram_join.chosen_boundary({3: 10, 8: 1000}, {3: 50 * cost, 8: 20 * cost}) == 3
    assert ngram_join.chosen_boundary({3: 100, 8: 10}, {3: 50 * cost, 8: 20 * cost}) == 0
    assert ngram_join.chosen_boundary({3: 60, 8: 1}, {3: 50 * cost, 8: 20 * cost}) == 8


@pytest.mark.parametrize("seed", range(3))
def test_long_lists_connect_what_pairs_do(spark, seed):
    r = random.Random(seed)
    rows = []
    for s in range(6):
        for _ in range(60):
            n = r.choice([5, 40, 41, 45, 50, 60, 200, 210, 240])
            rows.append((s, len(rows), n, r.randint(0, ngram_join.prefix_length(n, 80, 100) - 1)))
    pairs = [(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and min(x[2] - x[3], y[2] - y[3]) >= ngram_join.overlap(x[2], y[2], 80, 100)]
    found = ngram_join._long_lists(spark.createDataFrame(rows, "s long, rep long, n long, place long"), 80, 100).collect()
    root = {x[1]: x[1] for x in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in found:
        root[find(a)] = find(b)
    assert pairs and all(find(a) == find(b) for a, b in pairs)
    assert len({find(x[1]) for x in rows}) > 60  # and leave the others alone


@pytest.mark.parametrize("boundary", [None, 0, 9, 20])
@pytest.mark.parametrize("block", [3, 256])
def test_join_by_brute_force(spark, monkeypatch, boundary, block):
    if boundary is not None:  # else as the costs have it
        monkeypatch.setattr(ngram_join, "chosen_boundary", lambda keys, scans: boundary)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = dict(enumerate(small_and_large(17)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, 5, 80)
    assert len({c for _, c in want.values()}) < len(want) - 60
    assert got(ngram_join.jaccard_join(df)) == want


def test_one_large_family(spark):
    """More near copies than a block, and rows that go by a shuffle instead of a broadcast."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    texts = {}
    for i in range(320):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(ngram_join.jaccard_join(df)) == brute_components(texts, 5, 80)


def test_other_thresholds_and_a_shuffle_of_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    texts = dict(enumerate(small_and_large(5, 120)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k, num in ((3, 85), (1, 60)):
        assert got(ngram_join.jaccard_join(df, k, num)) == brute_components(texts, k, num)


def test_awkward_rows(spark):
    assert ngram_join.jaccard_join(empty(spark)).count() == 0
    df = awkward(spark)
    out = ngram_join.jaccard_join(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == df.count()
    assert all(r.component_id is None for r in out.where("doc_id IS NULL").collect())
    once = df.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count = 1").count()
    assert once > 50
    base = frame(spark)
    assert got(ngram_join.jaccard_join(base)) == brute_components(texts_of(base), 5, 80)


def test_small_set_keys_are_the_links():
    """Two small sets meet under a key of the overlap that they need, exactly when they are linked."""
    hashes = WordHashes()
    sets = [set(shingles(t, 5, hashes).tolist()) for t in small_and_large(8, 60)]
    sets = [s for s in sets if 0 < len(s) <= 12]
    for a, b in itertools.combinations(sets, 2):
        both = len(a & b)
        c = ngram_join.overlap(len(a), len(b), 80, 100)
        assert (100 * both >= 80 * (len(a) + len(b) - both)) == (both >= c)
