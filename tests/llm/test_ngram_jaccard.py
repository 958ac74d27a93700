import re

import numpy as np
import pytest
from fixtures import KINDS, rows, table

from pitchframe.llm.ngram_jaccard import BLOCK, add_packed, one_of_each, op1_ngram_jaccard, packed_counts, similar_components


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(given, width, percent):
    """(id, size, least id of the component), ids of null last; by all pairs of different sets."""
    sets = [shingles(t, width) for _, t, *_ in given]
    parent = list(range(len(given)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, *_) in enumerate(given):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return sorted(((key, len(sets[i]), least.get(root(i)) if sets[i] else key) for i, (key, *_) in enumerate(given)), key=str)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_components_equal_brute_force(spark, width, percent):
    found = similar_components(table(spark), width=width, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows(), width, percent)


def test_components_of_given_documents_equal_brute_force(spark, sf_dir):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = op1_ngram_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == brute(given, 4, 85)


def test_one_document_of_each_component_stays(spark):
    df = table(spark)
    stay = one_of_each(df)
    assert stay.columns == df.columns
    least = {c for i, n, c in brute(rows(), 5, 80) if i is not None}
    assert {r["doc_id"] for r in stay.collect() if r["doc_id"] is not None} == least


def test_an_empty_table_gives_an_empty_table(spark):
    empty = spark.createDataFrame([], KINDS)
    assert similar_components(empty).count() == 0 and one_of_each(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0)], KINDS)
    assert sorted(tuple(r)[3:] for r in similar_components(blank).collect()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("share,most", [(0.001, 9), (0.9, 9), (0.001, 70_000), (0.9, 70_000)])
def test_packed_counts_add_up(share, most):
    rng = np.random.default_rng(5)
    sums, want = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    for _ in range(3):
        counts = (rng.random(BLOCK) < share) * rng.integers(1, most, BLOCK)
        counts[0] = 1
        want += counts
        add_packed(sums, memoryview(packed_counts(counts.astype(np.uint32))))
    assert (sums == want).all()
