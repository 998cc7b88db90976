"""Periodic runs against a search of all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from fixtures import awkward, empty, frame

from voxloom.llm import periodic
from voxloom.llm.minhash import WordHashes


def brute_runs(seq, least=24, times=3):
    """Every maximal stretch with words q apart identical, for every q, whose smallest period q is."""
    n, out = len(seq), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and seq[i] == seq[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, times * q) and not any((s, length) == k[:2] for k in out):  # a smaller period was first
                out[(s, length, q)] = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed: int):
    r = random.Random(seed)
    for _ in range(120):
        k = r.choice([1, 2, 2, 3, 5, 60])
        seq = [r.randrange(k) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            w = [r.randrange(k) for _ in range(r.randint(1, 14))]
            t = (w * 12)[: r.randint(1, 70)]
            at = r.randint(0, len(seq))
            seq = seq[:at] + t + seq[at:]
        yield seq
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    yield b  # a Fibonacci word: runs of every scale
    yield [0] * 500
    yield ([0] * 30 + [1]) * 9
    yield list(range(40)) * 5


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (5, 2)])
def test_runs_by_brute_force(seed, least, times):
    for seq in sequences(seed):
        assert periodic.runs_of(seq, least, times) == (brute_runs(seq, least, times) if len(seq) >= least else [])


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_repeated_windows_are_all_runs(seed):
    for seq in sequences(seed):
        words = [b"w%d" % x for x in seq]
        assert periodic.runs_of_words(words, WordHashes()) == brute_runs(seq)


def test_words_decide_where_hashes_are_wrong(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 7)  # nearly all hashes collide
    monkeypatch.setattr(periodic, "BASE", 3)
    for seq in sequences(9):
        assert periodic.runs_of(seq) == brute_runs(seq)


def test_long_texts_take_near_linear_time():
    import time

    for word in (["a"] * 200_000, ["a", "b", "c"] * 60_000, [str(i % 20_011) for i in range(200_000)]):
        start = time.time()
        (found,) = periodic.runs_of_words([w.encode() for w in word], WordHashes())
        assert found == (0, len(word), len(set(word)))
        assert time.time() - start < 30


def digests(rows):
    """The contract's columns, from the words themselves."""
    out = {}
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n and doc_id is not None:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.setdefault(doc_id, []).append((len(runs), *best, best[0] is not None and best[1] * 1000 // best[2] or None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[1:]))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len((t or "").split()) < 2500]
    df = periodic.op11_lyndon_runs(spark, sf)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found, want = got(df), digests(rows)
    assert {k: found[k] for k in want} == want
    assert any(v[0][0] for v in want.values())


def test_awkward_rows(spark):
    data = [(1, "x " * 30), (1, "a b " * 12), (None, "p q r " * 8), (2, None), (3, " \n "), (4, " x " * 30), (5, "a b a b a b")]
    rows = [(i, t, "en", "s", 1, "t", 0.5, "h", "k", "b") for i, t in data]
    df = frame(spark, rows)
    assert got(periodic.summary(periodic.periodic_runs(df, periodic.with_a_planted_run))) == digests(data)
    found = {(r.doc_id, r.n_words): (r.runs, r.collapsed) for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in found[(1, 30)][0]] == [(0, 30, 1)] and found[(1, 30)][1] == "x"
    assert [tuple(x) for x in found[(1, 24)][0]] == [(0, 24, 2)] and found[(1, 24)][1] == "a b"
    assert found[(2, 0)] == ([], "") and found[(5, 6)] == ([], "a b a b a b")
    assert periodic.periodic_runs(awkward(spark)).count() == awkward(spark).count()
    assert periodic.summary(periodic.periodic_runs(empty(spark))).count() == 0
