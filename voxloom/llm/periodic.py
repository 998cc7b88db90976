"""Periodic runs of words: every stretch that repeats a period three times or more, by the runs theorem.

1. A run of `least` words and exponent 3 or more holds each of its windows of WINDOW words at
   least twice, so words in no repeated window are in no run. Windows are hashed all at once; only
   stretches of `least` words or more in repeated windows go on. Two windows with one hash
   can only let a stretch go on that holds no run.
2. A stretch is scanned right to left with a stack of Lyndon words: a new word joins the one on
   the stack while it is smaller, so each position gets the longest Lyndon word that starts there.
   That is done under an order of the words and under its reverse; every run has the longest
   Lyndon words of one of the two as its periods.
3. Comparing two Lyndon words, and extending two occurrences of one to the left and right, takes the
   longest common extension: galloping and bisecting rolling-hash prefixes, then comparing
   the words themselves. Where a hash was wrong, words are compared one by one.

A text is the unit of work, and is never cut; nothing is shuffled. No suffix array is built.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.minhash import WordHashes, mix
from voxloom.llm.shared import documents, text_or_empty

#: A run's length and its number of periods, at least.
LEAST, TIMES = 24, 3
#: Words of the windows that are looked up; a run of LEAST words and TIMES periods repeats all windows of LEAST * (1 - 1 / TIMES) / 2 words.
WINDOW = 8
PRIME, BASE = (1 << 61) - 1, 1_000_003 * 7_919

_rng = np.random.Generator(np.random.PCG64(11))
_POSITION = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Extension:
    """Longest common extensions of positions of a sequence, by prefix hashes; what they say is verified on the sequence."""

    def __init__(self, seq: list[int]):
        self.seq, self.n = seq, len(seq)
        self.hash = list(accumulate(seq, lambda h, x: (h * BASE + x + 1) % PRIME, initial=0))
        self.power = list(accumulate(range(self.n), lambda p, _: p * BASE % PRIME, initial=1))

    def _equal(self, i: int, j: int, m: int) -> bool:
        h, p = self.hash, self.power[m]
        return (h[i + m] - h[i] * p - h[j + m] + h[j] * p) % PRIME == 0

    def right(self, i: int, j: int, most: int | None = None) -> int:
        """How many words from i on equal those from j on (i < j), `most` at most."""
        seq, top = self.seq, self.n - j if most is None else min(most, self.n - j)
        lo = 0
        while lo < min(4, top):  # most extensions are short
            if seq[i + lo] != seq[j + lo]:
                return lo
            lo += 1
        if lo == top:
            return lo
        step = 8
        while lo + step <= top and self._equal(i + lo, j + lo, step):
            lo += step
            step *= 2
        hi = min(top, lo + step - 1) if lo + step <= top else top
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._equal(i, j, mid) else (lo, mid - 1)
        if seq[i : i + lo] != seq[j : j + lo]:  # two stretches with one hash
            return next(k for k in range(lo) if seq[i + k] != seq[j + k])
        return lo

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        seq, lo = self.seq, 0
        while lo < min(4, i):
            if seq[i - 1 - lo] != seq[j - 1 - lo]:
                return lo
            lo += 1
        hi = i
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._equal(i - mid, j - mid, mid) else (lo, mid - 1)
        if seq[i - lo : i] != seq[j - lo : j]:
            return next(k for k in range(lo) if seq[i - 1 - k] != seq[j - 1 - k])
        return lo


def lyndon_ends(ext: Extension, sign: int) -> list[int]:
    """For each position, where the longest Lyndon word that starts there ends, when words are ordered by sign * id."""
    seq, n = ext.seq, ext.n
    end = [0] * n
    stack = [n]  # starts of the Lyndon words to the right, the nearest last
    for i in range(n - 1, -1, -1):
        x = seq[i]
        while (j := stack[-1]) < n:
            y = seq[j]
            if x == y:
                k = end[j]
                short = min(j - i, k - j)
                m = ext.right(i, j, short)
                if m == short:
                    if j - i >= k - j:  # equal, or the word on the stack begins this one
                        break
                elif (seq[i + m] - seq[j + m]) * sign > 0:
                    break
            elif (x - y) * sign > 0:
                break
            stack.pop()
        end[i] = stack[-1]
        stack.append(i)
    return end


def runs_of(seq: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `times` periods, by start, then period."""
    if len(seq) < least:
        return []
    ext = Extension(seq)
    found: dict[tuple[int, int], int] = {}
    for sign in (1, -1):
        known: dict[int, int] = {}  # of each period, where its last run found starts
        end = lyndon_ends(ext, sign)
        for i in range(len(seq) - 1, -1, -1):
            j = end[i]
            p = j - i
            if j == ext.n or seq[i] != seq[j] or known.get(p, ext.n) <= i:
                continue
            r = ext.right(i, j)
            left = ext.left(i, j)
            if left + r >= p:
                known[p] = i - left
                length = left + p + r
                if length >= least and length >= times * p:
                    found[(i - left, p)] = length
    return sorted((s, n, p) for (s, p), n in found.items())


def repeated_stretches(h: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least `least` words, all in windows of WINDOW words that occur twice or more; h: the words' hashes."""
    n = len(h) - WINDOW + 1
    if len(h) < least:
        return []
    total = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        total += h[i : i + n] * _POSITION[i]
    total = mix(total)
    order = np.sort(total)
    if not (order[1:] == order[:-1]).any():
        return []
    _, at, counts = np.unique(total, return_inverse=True, return_counts=True)
    edges = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(counts[at] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    inside = np.r_[0, (edges.cumsum()[:-1] > 0).astype(np.int8), 0]
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a >= least]


def runs_of_words(words: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int]]:
    """runs_of a text's words, looked for where windows repeat."""
    if len(words) < LEAST:
        return []
    out = []
    for a, b in repeated_stretches(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))):
        ids: dict[bytes, int] = {}
        seq = [ids.setdefault(w, len(ids)) for w in words[a:b]]
        out += [(a + s, n, p) for s, n, p in runs_of(seq)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edges[s + p] += 1
        edges[s + n] -= 1
    return [words[i] for i in np.flatnonzero(edges.cumsum()[:-1] == 0)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones that with the smallest start, then period."""
    best = None
    for s, n, p in runs:  # by start, then period
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


COLUMNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs and the text without its repeats, of every row of docs(doc_id, text).

    Words are runs without ASCII white space, compared as they are. A run is a stretch of words with
    smallest period q that no neighbouring word extends, at least LEAST words and TIMES * q long; runs
    come by start, then period. `collapsed` joins by one space the words that are in no run after its first q.
    A null or blank text has no words, no runs and an empty `collapsed`; rows that repeat a doc_id, or have
    none, are rows of their own. Other columns are ignored; an empty table gives no rows. change: rewrites the
    words of a row before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                n_words, runs, collapsed = [], [], []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone
                    words = change(doc_id, words) if change else words
                    found = runs_of_words(words, hashes)
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    collapsed.append(b" ".join(without_repeats(words, found)).decode("utf-8", "replace"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_words": pa.array(n_words, pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, COLUMNS)


def with_a_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in every tenth document, by a hash of its id; others, and rows without an id, as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run with its exponent in thousandths, and digests of all runs and of the collapsed text."""
    r = F.col("runs")
    # exact comparison of length / period: by products, the earlier run stays where they are equal
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate(r, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    each = F.transform(r, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(periodic_runs(documents(spark, sf_dir), with_a_planted_run))
