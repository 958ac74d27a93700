"""The pipeline on the smallest tables, each stage against a plain statement of what it does to its input."""

import corpus_pipeline
from test_ngram_jaccard import brute

from pitchframe.llm.common import documents
from pitchframe.llm.source_mixing import with_probability
from pitchframe.llm.toxicity import THRESHOLD, op2_toxicity


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = corpus_pipeline.landed(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "byte_bpe":
            assert docs.columns == inputs[name].columns
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in inputs.items()}
    scores = {r["doc_id"]: r["score"] for r in op2_toxicity(spark, sf_dir).collect()}
    assert sorted(ids["exact_dedup"]) == sorted(i for i in ids["toxicity"] if scores[i] < THRESHOLD)
    best = {}
    for r in inputs["exact_dedup"].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(ids["ngram_jaccard"]) == sorted(best.values())
    given = [(r["doc_id"], r["text"]) for r in inputs["ngram_jaccard"].collect()]
    assert sorted(ids["source_mixing"]) == sorted(i for i, _, least in brute(given, 5, 80) if i == least)
    taken = {r["doc_id"] for r in with_probability(inputs["source_mixing"]).filter("__taken").collect()}
    assert sorted(ids["byte_bpe"]) == sorted(taken)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(taken)


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns) and found.count() > 0
