"""A corpus pipeline over documents: stages that each apply one text operator to all that the stage before kept.

toxicity drops what scores as toxic; exact_dedup keeps one of equal texts; ngram_jaccard keeps one document of each group
of near copies (five-word shingles, 0.8); source_mixing samples towards target weights; byte_bpe encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchframe.llm import byte_bpe, exact_dedup, ngram_jaccard, source_mixing, toxicity
from pitchframe.llm.common import documents, landed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_rows(docs, byte_bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # SQL can't express the stages; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
