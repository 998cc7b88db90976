"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, takes letters apart from their accents and drops those together with characters
of no width, replaces homoglyphs by the Latin letters they look like, and in words
that mix letters with digits or signs undoes the substitution (l0ser, 1diot, tr@sh). The
lexicon holds whole words and word beginnings with the log odds that labelled rows give
them. A word counts once, with its heaviest entry, unless an exception phrase covers it.
A logistic curve over the sum, also normalised by length, gives the score; it is
fitted on cross-fitted sums, so that no row is scored by words that it chose itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import documents, text_or_empty, written

#: At most so many labelled rows are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 12_000
#: At most so many entries, the surest first, are kept.
LEXICON_SIZE = 3_000
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS, LEAST_Z = 4, 2.8
FOLDS = 5

#: Harmless phrases around words that may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "idiot proof", "idiot board", "pond scum", "sore loser")
#: Letters of other scripts that look like Latin ones: Cyrillic, then Greek.
HOMOGLYPHS = str.maketrans("авсеһіјкмнорԛтухѕԁցɡαβεικνορτυχ", "abcehijkmhopqtyxsdggabeikvoptux")
SUBSTITUTES = str.maketrans("013457@$!|+", "oieastasiit")
MIXED = re.compile(r"[a-z][013457@$!|+]+[a-z]|\b[013457@$][a-z]|[a-z][013457$@]\b")
MIXED_WORD = re.compile(r"[^\s.,;:?\"'()]*[a-z][^\s.,;:?\"'()]*")
WORD = re.compile(r"[^\W_]+")
#: Accents and other marks put over Latin, Greek and Cyrillic letters, then characters that show nothing.
UNSEEN = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]+")


def fold(text: str) -> str:
    """The text as entries are matched in; empty stays empty, and plain lower-case text without digits or signs in words stays as it is."""
    text = text.lower()
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text)).lower().translate(HOMOGLYPHS)
    if MIXED.search(text):
        text = MIXED_WORD.sub(_undo, text)
    return text


def _undo(m: re.Match) -> str:
    """The word with its substitutes undone; a 1 may stand for i or l, so both readings are kept, as two words. Signs at its end that close a sentence stay."""
    word = m[0].rstrip("!|+")
    if not MIXED.search(word) or sum(c.isdigit() for c in word) * 2 > len(word):
        return m[0]
    first, end = word.translate(SUBSTITUTES), m[0][len(word) :]
    return f"{first} {word.replace('1', 'l').translate(SUBSTITUTES)}{end}" if "1" in word else first + end


def entries_of(text: str) -> set[str]:
    """The lexicon entries that a text could support: '=word' and '^beginning'."""
    words = {w for w in WORD.findall(fold(text)) if len(w) > 2 and not w.isdigit()}
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


class Lexicon:
    """Entries with weights as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self._add(entry[1:], entry[0], w)
        for phrase in exceptions:
            self._add(phrase, "-", 0.0)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _add(self, word: str, kind: str, weight: float) -> None:
        """Its value: the word's length, and each kind of entry with its weight."""
        _, kinds = self.automaton.get(word, (0, ()))
        self.automaton.add_word(word, (len(word), (*kinds, (kind, weight))))

    def sums(self, text: str) -> tuple[float, int, int]:
        """Sum of the matched words' weights, matched words, words."""
        text = fold(text)
        n = max(1, text.count(" ") + text.count("\n") + 1 if text else 0)
        if not len(self.automaton):
            return 0.0, 0, n
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, kinds) in self.automaton.iter(text):
            start = end + 1 - length
            if start and text[start - 1].isalnum():
                continue
            for kind, w in kinds:
                if kind == "-":
                    spared.append((start, end))
                elif kind == "^" or end + 1 == len(text) or not text[end + 1].isalnum():
                    found[start] = max(w, found.get(start, 0.0))
        if spared:  # one sweep over both in order
            spared.sort()
            at, covered = 0, -1
            for k in sorted(found):
                while at < len(spared) and spared[at][0] <= k:
                    covered, at = max(covered, spared[at][1]), at + 1
                if k <= covered:
                    del found[k]
        return sum(found.values()), len(found), n


def features(total: float, hits: int, words: int) -> list[float]:
    return [1.0, math.log1p(total), math.log1p(100 * total / words), min(hits, 20) ** 0.5, math.log1p(words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; few features, so it is a small solve."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0


def _weights(counts: list[tuple], column: int, n: tuple[float, float]) -> dict[str, float]:
    """Entries whose smoothed log odds are sure enough; counts: (entry, toxic, clean) by half, twice."""
    found = {}
    for row in counts:
        a, b = row[column], row[column + 1]
        w = math.log((a + 0.5) / (n[0] + 1)) - math.log((b + 0.5) / (n[1] + 1))
        z = w / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= LEAST_DOCS and z >= LEAST_Z and b <= a:
            found[row[0]] = (z, w)
    return {k: w for k, (_, w) in sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:LEXICON_SIZE]}


class Model:
    """A lexicon and the curve over its sums."""

    def __init__(self, weights: dict[str, float], beta: list[float]):
        self.weights, self.beta = weights, beta


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from rows of labels(doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0, at most train_rows of them.

    Labels that are null, or not 0 or 1, are passed over; rows that repeat a doc_id count once, as
    toxic if any is. Without rows of both classes every score is the share of toxic ones.
    """
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = rows.count()
    order = F.crc32(F.concat(F.lit("train:"), F.col("doc_id").cast("string")).cast("binary"))
    if known > train_rows:
        rows = rows.orderBy(order, "doc_id").limit(train_rows)
    rows = rows.withColumn("half", (F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int"))
    sample = written(docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(rows), "doc_id"), "labelled").repartition(16)  # train_rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())
        for batch in batches:
            for text, toxic, half in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                counts[2 * half + (1 - toxic)].update(entries_of(text))
        every = list(set().union(*counts[0::2]))
        clean = list(set().union(*counts[1::2]).difference(every))
        for names in (every, clean):
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"entry": part} | {f"n{k}": pa.array([c[x] for x in part], pa.int64()) for k, c in enumerate(counts)})

    sizes = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    n = lambda half, toxic: sizes.get((half, toxic), 0)
    toxic_rows, all_rows = n(0, 1) + n(1, 1), sum(sizes.values())
    if not toxic_rows or toxic_rows == all_rows:
        share = toxic_rows / all_rows if all_rows else 0.0
        return Model({}, [math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0, 0.0])
    summed = sample.mapInArrow(count, "entry string, n0 long, n1 long, n2 long, n3 long").groupBy("entry").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    a, b = F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")
    w = F.log((a + 0.5) / (toxic_rows + 1)) - F.log((b + 0.5) / (all_rows - toxic_rows + 1))
    sure = w / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    top = summed.where(a >= LEAST_DOCS).withColumns({"a": a, "b": b, "z": sure}).where("b <= a AND z > 1.5").orderBy(F.desc("z"), "entry").limit(4 * LEXICON_SIZE).select("entry", "n0", "n1", "n2", "n3", "a", "b")
    counts = [tuple(r) for r in top.collect()]
    halves = [_weights(counts, 1, (n(0, 1), n(0, 0))), _weights(counts, 3, (n(1, 1), n(1, 0)))]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(halves[1]), Lexicon(halves[0])]
        for batch in batches:
            text, toxic, half = (batch.column(i).to_pylist() for i in (1, 2, 3))
            sums = [other[h].sums(t) for t, h in zip(text, half, strict=True)]
            yield pa.RecordBatch.from_pydict({"total": [float(s[0]) for s in sums], "hits": [s[1] for s in sums], "words": [s[2] for s in sums], "toxic": pa.array(toxic, pa.int32())})

    found = sorted(sample.mapInArrow(crossed, "total double, hits long, words long, toxic int").collect())  # train_rows at most
    beta = fit_logistic(np.array([features(r.total, r.hits, r.words) for r in found]), np.array([float(r.toxic) for r in found]))
    return Model(_weights(counts, 5, (toxic_rows, all_rows - toxic_rows)), [float(x) for x in beta])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    Whole texts are scored; null and empty ones get the score of a text without any match. Rows that repeat a doc_id are scored
    each by its own text. A null doc_id is scored too; held_out is then false. Other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = None
        for batch in batches:
            lexicon = lexicon or Lexicon(model.weights)
            x = np.array([features(*lexicon.sums(t)) for t in batch.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.beta), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": p, "predicted": pa.array((p >= 0.5).astype(np.int32))})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), text_or_empty("text").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs.

    Each row is judged by its own text, those that repeat a doc_id or have none too. Null and
    empty texts are judged as texts without any match. Columns of any name are passed on; an
    empty table gives no rows.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = None
        for batch in batches:
            lexicon = lexicon or Lexicon(model.weights)
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features(*lexicon.sums(t or "")) for t in texts])
            yield batch.filter(pa.array(x @ np.array(model.beta) < 0))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
