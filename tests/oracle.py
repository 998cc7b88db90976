"""Runs SQL on the same Parquet tables, and compares rows without regard to order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c.sql(sql).df()


def rows(pdf) -> list[str]:
    columns = sorted(pdf.columns)
    return sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None)))


def assert_same(df, expected) -> None:
    got = df.toPandas()
    for c, kind in df.dtypes:
        if kind in ("int", "bigint") and got[c].isna().any():  # whole numbers with nulls come as floats, but not from the other side
            got[c] = got[c].astype("Int64")
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not odd, odd[:3]
