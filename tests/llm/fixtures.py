"""Small tables with the awkward cases: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, p double, h string, kept string, bin_id string"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    words = ["the", "of", "and", "der", "la", *[f"w{i}" for i in range(60)]]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 90))) for _ in range(n // 3)]
    out: list[str | None] = []
    for t in base:
        out.append(t)
        w = t.split()
        if w and r.random() < 0.7:
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(r.choice([t, t.upper(), t.replace(" ", "\n\t "), t + " tail", "Ünïcödé ß 漢字 😀 " + t]))
    return out + [None, "", " \n\t ", None, "x", "word " * 30_000, "the of and " * 20_000, "a", "a b", "A b"]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i, t in enumerate(texts(seed, n)):
        out.append((i * 3 - 20, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "src2", None]), None if i % 7 == 0 else 5, "x", 0.5, "h", "k", "b"))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(spark):
    """Repeated rows, repeated ids with other texts, and null ids on top."""
    data = rows()
    extra = [data[4], (data[8][0], "another text of the same id", *data[8][2:]), (None, data[6][1], *data[6][2:]), (None, None, None, None, None, None, None, None, None, None)]
    return frame(spark, data + extra)
