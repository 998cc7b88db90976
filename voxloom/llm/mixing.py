"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are first summed to cells (source, language, topic); only the cells are raked.
Each round scales the cell weights to the source, then the language, then the topic
marginals; where cells are many, an axis is summed first and its sums are joined back, so that no value of
an axis is one task's. The calibrated probability of a document is its cell's weight over its cell's
tokens, scaled so that the largest is 1; a hash of its id decides whether it is drawn.

A topic is a given column, or else a cluster of a text's form, learned over all documents: long or
short against their mean number of words, marked or plain against their mean share of signs
that are neither letters, digits nor white space. It says something of any text in any
language, but it is coarse; a classifier's column is the better topic where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import documents, text_or_empty, written

AXES = ("source", "lang", "topic")
SIGNS = r"[^\p{L}\p{N}\x20\x09-\x0D]"
#: Up to so many cells, of some 100 bytes each, are raked in one task, without an exchange; more by sums that are joined back.
ONE_TASK = 100_000
ALPHA, SEED, TOLERANCE, ROUNDS = 0.7, 17, 1e-9, 40


def tokens_of(column: str) -> Column:
    """Words, at least 1, so that every document has a weight."""
    return F.greatest(F.lit(1), F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def form_of(column: str) -> dict[str, Column]:
    """What topics are learned from: words (at least 1), signs and characters of a text."""
    return {"n_tokens": tokens_of(column), "_signs": F.regexp_count(text_or_empty(column), F.lit(SIGNS)).cast("long"), "_chars": F.char_length(text_or_empty(column)).cast("long")}


def learned_topic(docs: DataFrame) -> Column:
    """The topic by the columns of form_of, learned from their means over all rows of docs: one row to the driver."""
    t = docs.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("n"), F.sum("_signs").alias("signs"), F.sum("_chars").alias("chars")).first()
    long = F.col("n_tokens").cast("double") * float(t.rows) >= float(t.n or 0)
    marked = F.col("_signs").cast("double") * float(t.chars or 0) > F.col("_chars").cast("double") * float(t.signs or 0)
    return F.concat_ws(" ", F.when(long, "long").otherwise("short"), F.when(marked, "marked").otherwise("plain"))


def drawn(id_column: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, axis: str, wanted: dict[str, float] | None, alpha: float) -> DataFrame:
    """(axis, target share): the shares wanted, or the shares that cells have, to the power alpha."""
    if wanted is not None:
        shares = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()] or [("", 0.0)], f"{axis} string, t double")
    else:
        shares = cells.groupBy(axis).agg(F.pow(F.sum("n").cast("double"), F.lit(alpha)).alias("t"))
    total = shares.agg(F.sum("t")).first()[0] or 1.0
    return shares.select(axis, (F.col("t") / F.lit(float(total))).alias(f"t_{axis}"))


def calibrate(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells(source, lang, topic, n tokens) with w, their raked weight (summing to 1), and p, the calibrated probability.

    targets: the share wanted of each value by axis; values that it lacks get none. An axis
    without targets takes the shares that it has to the power alpha: 1 keeps the mix, 0
    evens it out. It ends when every marginal is met to `tolerance`, or after `rounds`;
    targets that contradict the empty cells come as near as raking brings them.
    """
    targets = targets or {}
    for axis in AXES:
        cells = cells.join(_targets(cells, axis, targets.get(axis), alpha), axis, "left").fillna(0.0, [f"t_{axis}"])
    cells = written(cells.withColumn("w", F.col("n").cast("double")), "cells")
    few, done = cells.count() <= ONE_TASK, 0
    while done < rounds:
        cells = cells.coalesce(1) if few else cells
        for _ in range(4 if few else 1):
            for axis in AXES:
                if few:
                    cells = cells.withColumn("_sum", F.sum("w").over(Window.partitionBy(axis)))
                else:
                    cells = cells.join(cells.groupBy(axis).agg(F.sum("w").alias("_sum")), axis)
                cells = cells.withColumn("w", F.when(F.col("_sum") > 0, F.col("w") * F.col(f"t_{axis}") / F.col("_sum")).otherwise(0.0)).drop("_sum")
            done += 1
        cells = written(cells, "cells")
        if done % 4 == 0:
            marginals = cells.select(F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value"), F.col(f"t_{axis}").alias("t")) for axis in AXES])).alias("m"), "w")
            gap = marginals.groupBy("m.axis", "m.value").agg(F.abs(F.sum("w") - F.max("m.t")).alias("gap")).agg(F.max("gap")).first()[0]
            if (gap or 0.0) <= tolerance:
                break
    ratio = F.try_divide(F.col("w"), F.col("n").cast("double"))
    top = cells.agg(F.max(ratio)).first()[0] or 1.0
    return cells.select(*AXES, "n", "w", F.coalesce(ratio / F.lit(float(top)), F.lit(0.0)).alias("p"))


def _keys(docs: DataFrame, topic: str | None) -> DataFrame:
    """docs with _s, _l, n_tokens and what makes the topic: _t, or the columns of form_of."""
    keys = {"_s": F.coalesce(F.col("source").cast("string"), F.lit("")), "_l": F.coalesce(F.col("lang").cast("string"), F.lit(""))}
    return docs.withColumns(keys | (form_of("text") if topic is None else {"n_tokens": tokens_of("text"), "_t": F.coalesce(F.col(topic).cast("string"), F.lit(""))}))


def _calibrated(keyed: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float) -> tuple[Column, DataFrame]:
    """(the topic of rows like keyed's, p by _s, _l and _t)."""
    topic = F.col("_t") if "_t" in keyed.columns else learned_topic(keyed)
    cells = keyed.select("_s", "_l", topic.alias("_t"), "n_tokens").groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_t").alias("topic")).agg(F.sum("n_tokens").alias("n"))
    return topic, calibrate(written(cells, "cells0"), targets, alpha).select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), "p")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, seed: int = SEED, topic: str | None = None) -> DataFrame:
    """docs with topic, n_tokens, p and sampled.

    docs has doc_id, text, source and lang; a column of docs with one of the added names is
    replaced. topic names the column that holds each document's topic; without it topics
    are learned. Null sources, languages and given topics form a value of their own, ''; a null or empty
    text weighs one token. The draw depends on doc_id alone, so equal ids are drawn
    together, and a rerun draws the same documents. An empty table gives no rows.
    """
    keyed = _keys(docs, topic)
    small = written(keyed.select(*[c for c in ("_s", "_l", "_t", "n_tokens", "_signs", "_chars") if c in keyed.columns]), "keys")
    of, p = _calibrated(small, targets, alpha)
    own = keyed.withColumn("_t", of).drop("topic", "p", "sampled", "_signs", "_chars")
    return own.join(p, ["_s", "_l", "_t"]).drop("_s", "_l").withColumnRenamed("_t", "topic").withColumn("sampled", drawn("doc_id", seed) < F.col("p"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, seed: int = SEED, topic: str | None = None) -> DataFrame:
    """The sampled rows of docs, with the columns of docs; null and empty texts, repeated ids and empty tables as in `mixed`."""
    inner = [F.col(c).alias(f"_in_{c}") for c in docs.columns] + ["doc_id", "text", "source", "lang"] + ([F.col(topic).alias("_in__topic")] if topic else [])
    return mixed(docs.select(inner), targets, alpha, seed, "_in__topic" if topic else None).where("sampled").select([F.col(f"_in_{c}").alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed, without its texts: they are read once."""
    keyed = written(_keys(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), None).drop("text", "source", "lang"), "keys")
    topic, p = _calibrated(keyed, None, ALPHA)
    out = keyed.withColumn("_t", topic).join(p, ["_s", "_l", "_t"])
    return out.select("doc_id", F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_t").alias("topic"), "n_tokens", F.round("p", 6).alias("p"), (drawn("doc_id", SEED) < F.col("p")).alias("sampled"))


def mixing_sql(table: str = "documents", alpha: float = ALPHA, seed: int = SEED, rounds: int = ROUNDS, name: str = "mix") -> str:
    """Common table expressions of the same raking, its rounds written out; the last, {name}_out, has doc_id, the keys, n_tokens, p and sampled."""
    parts = [
        rf"{name}_f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens, len(regexp_extract_all(coalesce(text, ''), '{SIGNS}'))::BIGINT AS signs, length(coalesce(text, ''))::BIGINT AS chars FROM {table})",
        f"{name}_m AS (SELECT count(*)::DOUBLE AS r, sum(n_tokens)::DOUBLE AS n, sum(signs)::DOUBLE AS s, sum(chars)::DOUBLE AS c FROM {name}_f)",
        f"{name}_d AS (SELECT doc_id, source, lang, (CASE WHEN n_tokens::DOUBLE * r >= n THEN 'long' ELSE 'short' END) || ' ' || (CASE WHEN signs::DOUBLE * c > chars::DOUBLE * s THEN 'marked' ELSE 'plain' END) AS topic, n_tokens FROM {name}_f, {name}_m)",
        f"{name}_c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n FROM {name}_d GROUP BY ALL)",
    ]
    for axis in AXES:
        parts.append(f"{name}_t_{axis} AS (SELECT {axis}, pow(sum(n)::DOUBLE, {alpha}) / sum(pow(sum(n)::DOUBLE, {alpha})) OVER () AS t_{axis} FROM {name}_c GROUP BY {axis})")
    parts.append(f"{name}_w0 AS MATERIALIZED (SELECT *, n::DOUBLE AS w FROM {name}_c " + " ".join(f"JOIN {name}_t_{axis} USING ({axis})" for axis in AXES) + ")")
    last = f"{name}_w0"
    for i in range(rounds):
        for axis in AXES:
            new = f"{name}_w{i}_{axis}"
            parts.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (w * t_{axis} / sum(w) OVER (PARTITION BY {axis}) AS w) FROM {last})")
            last = new
    parts.append(f"{name}_p AS (SELECT source, lang, topic, (w / n) / max(w / n) OVER () AS p FROM {last})")
    u = f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    parts.append(f"{name}_out AS (SELECT doc_id, source, lang, topic, n_tokens, p, {u} < p AS sampled FROM {name}_d JOIN {name}_p USING (source, lang, topic))")
    return ",\n".join(parts)


SQL = {"op10_mixing": "WITH " + mixing_sql() + "\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, sampled FROM mix_out"}
