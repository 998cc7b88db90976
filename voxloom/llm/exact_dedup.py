"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters (DataFrame.stat.freqItems keeps 1/support of them per task and
merges them) name every digest that may hold more than `support` of the rows. An exact
count verifies the candidates; the winners, at most 1/support of them, are broadcast and
their rows leave the shuffle on the map side. All other digests are shuffled as usual, and
summed before they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import documents, normalised, written


def exact_dedup(docs: DataFrame, support: float = 0.002) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs(doc_id, text, ...).

    Texts are equal when they are identical after each run of ASCII white space became one
    space; the row with the smallest doc_id stays. Null texts count as empty, and all empty
    texts form one group. Rows that repeat a doc_id are the same document and share its
    verdict. A null doc_id loses to any other; a group without any other has a null keep_id
    and is kept. Other columns of docs are ignored. An empty table gives no rows.
    """
    digests = written(docs.select("doc_id", F.sha2(normalised("text"), 256).alias("text_sha256")), "digests")
    rows = digests.count()
    key = F.xxhash64("text_sha256")
    frequent = digests.select(key.alias("h")).stat.freqItems(["h"], support)
    candidates = frequent.select(F.explode("h_freqItems").alias("h")).distinct()
    winners = written(
        digests.withColumn("h", key).join(F.broadcast(candidates), "h", "left_semi")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > max(1.0, support * rows)),
        "winners",
    )
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # groups are summed before their shuffle and joined back, so that none has to fit one task
    groups = light.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    light = light.join(groups.hint("merge"), "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return heavy.select(*columns).union(light.select(*columns))


def drop_exact_copies(docs: DataFrame, support: float = 0.002) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs.

    A row goes by its id and text together, so that of rows that repeat a doc_id each text
    is judged alone, and no text leaves with its last row. Equal rows stay or go together.
    Rows with a null doc_id are never dropped. A null text is empty. Columns of any name are
    passed on; an empty table gives no rows.
    """
    dropped = exact_dedup(docs, support).where("not kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha")).distinct()
    same = (docs["doc_id"] == dropped["dropped_id"]) & (F.sha2(normalised("text"), 256) == dropped["dropped_sha"])
    return docs.join(dropped, same, "left_anti").select(docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
