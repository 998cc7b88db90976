"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from voxloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, words string, pos string, c string, label string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], SCHEMA)


def brute(seqs: dict[int, list[tuple[str, int]]]) -> dict[tuple[int, int], tuple]:
    """The contract's rows of whole sequences of (turn, words)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        s = [t for t, _ in seqs[c]]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    words = {tuple(t for t, _ in s[:d]): s[d - 1][1] if d else 0 for s in seqs.values() for d in range(len(s) + 1)}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words[k]
    return {(m[0], len(k)): (members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()}


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((f"{role or ''}\0{text or ''}", len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in list(own)}


def got(df):
    return {(r.conv_id, r.depth): tuple(r[2:]) for r in df.collect()}


def some(seed: int, n: int):
    """Conversations with shared beginnings, copies, and null turns, roles and texts."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 20 == 0 and r.random() < 0.3:
            continue
        size = r.choice([1, 2, 3, 5, 8])
        common = r.random() < 0.5
        for t in range(size):
            role = r.choice(["user", "assistant", None])
            text = f"shared {t}" if common else r.choice(["a", "b c", "", None, "d\n e \t f"])
            rows.append((c, t if t or r.random() < 0.8 else None, "user" if common else role, text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [2, 20, 10_000])
def test_trie_by_brute_force(spark, local):
    rows = some(local, 90)
    df = prefix_trie.prefix_trie(*prefix_trie.with_heads(prefix_trie.numbered(frame(spark, rows))), local)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = got(df)
    assert found == brute(rebuilt(rows)) and df.count() == len(found)


def test_long_and_hot_conversations(spark, monkeypatch):
    """A conversation of most rows, two that share a long beginning, and a group of copies whose list takes several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(40, t, "user", f"only here {t}") for t in range(900)]
    rows += [(c, t, "user", f"long {min(t, 300)}") for c in (60, 80) for t in range(300 + c)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1600, 20) for t in range(3)]
    seqs = rebuilt(rows)
    assert got(prefix_trie.prefix_trie(*prefix_trie.with_heads(prefix_trie.numbered(frame(spark, rows))), 50)) == brute(seqs)


def test_chains_that_hang_from_chains(spark):
    """Each conversation leaves the one before later than that one left its own: as many chains below each other as conversations."""
    n = 30
    seqs = {c: [(f"t{c if t > c else t}-{t}" if t > c else f"s{t}", t) for t in range(n + 2)] for c in range(n)}
    ids: dict[str, int] = {}
    rows = [(c, p, ids.setdefault(t, len(ids)), w) for c, s in seqs.items() for p, (t, w) in enumerate(s)]
    seq = spark.createDataFrame(rows, "conv_id long, pos long, turn_id long, words long")
    for local in (5, 5000):
        assert got(prefix_trie.prefix_trie(seq, seq.select("conv_id").distinct(), local)) == brute(seqs)


def test_awkward_tables(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.with_heads(prefix_trie.numbered(frame(spark, [])))).count() == 0
    turnless = [(c, 0, "user", "x") for c in range(1, 9)]  # those with h > 0 lose their only turn, and no base is there
    assert got(prefix_trie.prefix_trie(*prefix_trie.with_heads(prefix_trie.numbered(frame(spark, turnless))))) == brute(rebuilt(turnless))
    same = [(20, 1, "user", "twice")] * 3 + [(20, None, None, None), (20, None, "user", "long " * 20_000), (None, 1, "user", "no id"), (None, None, None, None)]
    found = got(prefix_trie.prefix_trie(*prefix_trie.with_heads(prefix_trie.numbered(frame(spark, same)))))
    assert sorted(d for _, d in found) == [0, 1, 2, 3, 4, 5] and {v[1] for v in found.values()} == {1}
    place = {r.pos: r.words for r in prefix_trie.numbered(frame(spark, same)).collect()}
    assert {place[0], place[1]} == {0, 20_000} and [place[p] for p in (2, 3, 4)] == [1, 1, 1]


def test_quicksort_of_a_bucket():
    r = random.Random(8)
    seqs = {tuple(r.randrange(4) for _ in range(r.randint(0, 9))) for _ in range(60)}
    rows = [(i, 1 + i % 3, list(s), [1] * len(s)) for i, s in enumerate(sorted(seqs, key=hash))]
    prefixes = defaultdict(list)
    for c, n, ids, _ in rows:
        for d in range(1, len(ids) + 1):
            prefixes[tuple(ids[:d])].append((c, n))
    found = list(prefix_trie.quicksorted(rows, 5, min(c for c, *_ in rows)))
    assert sorted((x[0], x[1], x[3]) for x in found) == sorted((min(c for c, _ in m), 5 + len(k), sum(n for _, n in m)) for k, m in prefixes.items())
