"""Columns of the caller whatever their names: they come back with their values from every call that keeps rows."""

import pytest
from fixtures import KINDS, table
from pyspark.sql import functions as F

from pitchframe.llm import byte_bpe, exact_dedup, line_dedup, ngram_jaccard, source_mixing, toxicity

NAMES = ["__id", "__mark", "__digest", "__tokens", "__text", "__lines", "__removed", "__gone", "__of", "__all", "__source", "__p", "__taken", "__x", "caller0"]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(60)]
CALLS = {
    "kept_documents": lambda df, labels: exact_dedup.kept_documents(df),
    "deduplicated": lambda df, labels: line_dedup.deduplicated(df),
    "mixed": lambda df, labels: source_mixing.mixed(df),
    "encoded": lambda df, labels: byte_bpe.encoded(df, byte_bpe.vocabulary()),
    "one_of_each": lambda df, labels: ngram_jaccard.one_of_each(df),
    "without_toxic": lambda df, labels: toxicity.without_toxic(df, labels),
}


@pytest.mark.parametrize("name", CALLS)
def test_columns_of_the_caller_survive(spark, name):
    plain = table(spark, clashing=False)
    df = plain.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in NAMES})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")
    out = CALLS[name](df, labels)
    assert out.columns[: len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns)
    found = out.collect()
    assert found
    for r in found:
        own = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[c] == f"{c} of {own}" for c in NAMES)
    same = sorted((str(r["doc_id"]) for r in CALLS[name](plain, labels).collect()))
    assert sorted(str(r["doc_id"]) for r in found) == same


def test_names_in_arguments_are_followed(spark):
    df = table(spark, [(1, "one text", "en", "web", 8), (2, "one text", "en", "web", 8)], clashing=False).withColumnsRenamed({"text": "__text", "doc_id": "__id"})
    kept = exact_dedup.kept_documents(df, "__id", "__text").collect()
    assert [(r["__id"], r["__text"]) for r in kept] == [(2, "one text")]
    found = byte_bpe.encoded(df, byte_bpe.vocabulary(), text_col="__text", keep=["__id"])
    assert found.columns == ["__id", "token_ids", "token_ends"] and found.count() == 2


def test_calls_on_empty_tables(spark):
    df = spark.createDataFrame([], KINDS).withColumn("__id", F.lit("x"))
    assert exact_dedup.kept_documents(df).columns == df.columns and exact_dedup.kept_documents(df).count() == 0
