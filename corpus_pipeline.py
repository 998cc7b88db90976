"""A training-data pipeline over documents: each stage's rows are written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from voxloom.llm.shared import documents, written

#: The mix keeps most of what it is given: shares move only a little towards even ones.
MIX_ALPHA = 0.9


#: The tokenizers file that packing counts and cuts by; executors have it.
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic; null and empty texts are judged as texts without any match."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id. Repeated ids are told apart by text."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); blank texts stay."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to move the mix towards even shares of source, language and form."""
    return mixing.mix(docs, alpha=MIX_ALPHA)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in the packed sequences: doc_id, piece, start, n_tokens, bin_id, position, bin_tokens, ids_crc32."""
    import public_tokenizers

    return packing.places(packing.best_fit(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: Toxicity scores, MinHash groups and best-fit bins can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.

    Rows without a doc_id are never dropped as copies; an empty table gives no rows; other
    columns pass through all stages but the last, whatever their names are.
    """
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
