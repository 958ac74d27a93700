import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import KINDS, rows, table

from pitchframe.llm.toxicity import SEEDS, THRESHOLD, fitted_label_model, op2_toxicity, score, told_apart, trained, without_toxic

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in op2_toxicity(spark, BIG).collect()}


def test_held_out_rows_are_told_apart(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    out = [(scored[i]["score"], t) for i, t in labels.items() if scored[i]["held_out"]]
    toxic, clean = [s for s, t in out if t == 1], [s for s, t in out if t == 0]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.95
    assert sum(s >= THRESHOLD for s in clean) <= 0.05 * len(clean)
    assert sum(s >= THRESHOLD for s in toxic) >= 0.8 * len(toxic)


def test_what_is_held_out_follows_the_id(scored):
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    assert all(r["predicted"] == int(r["score"] >= THRESHOLD) and 0 <= r["score"] <= 1 for r in scored.values())


def test_all_cases_have_a_score(spark):
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0, None) for i in range(20)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    df = table(spark)
    _, found = trained(df, labels)
    assert found.count() == len(rows())
    kept = without_toxic(df, labels)
    assert kept.columns == df.columns


def test_without_labels_nothing_is_dropped(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert without_toxic(table(spark), none).count() == len(rows())
    assert without_toxic(spark.createDataFrame([], KINDS), none).count() == 0


def test_few_labels_or_none_leave_the_label_free_voters(spark):
    rng = random.Random(4)
    insults = [w for group in SEEDS for w in group.split()]
    rude = lambda: " ".join(rng.sample(insults, 3) + [f"w{rng.randrange(500)}" for _ in range(10)])
    calm = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(13))
    given = [(i, rude() if i % 5 == 0 else calm(), "en", "a", 0) for i in range(200)]
    few = spark.createDataFrame([(i, int(i % 5 == 0), None) for i in range(12)], "doc_id long, toxic int, quality int")
    for labels in (few, few.filter("toxic = 0"), few.limit(0)):
        model, found = trained(table(spark, given), labels)
        scores = {r["__id"]: r["s"] for r in found.select("__id", score(found["__features"], model).alias("s")).collect()}
        rude_, calm_ = [v for k, v in scores.items() if k % 5 == 0], [v for k, v in scores.items() if k % 5]
        if labels.isEmpty() or not labels.filter("toxic = 1").isEmpty():
            assert min(rude_) > max(calm_), (min(rude_), max(calm_))


def plain_em(given, voters, rounds):
    """EM row after row, voters independent given the label. given: (votes as a tuple of 0 and 1, label or None)."""
    post = [0.9 if label == 1 else (0.5 if sum(v) >= 2 else 0.01) if label is None else (0.2 if sum(v) >= 2 else 0.01) for v, label in given]
    for _ in range(rounds):
        weight = [sum(1 - p for p in post), sum(post)]
        prior = (weight[1] + 0.5) / (len(given) + 1)
        rate = [[(sum(((1 - p), p)[y] for (v, _), p in zip(given, post) if v[j]) + 0.5 * prior) / (weight[y] + 1) for j in range(voters)] for y in (0, 1)]
        said = []
        for y, extra, low, high in ((0, 0.1, 0.001, 0.2), (1, 1.9, 0.6, 0.999)):
            ones = sum(((1 - p), p)[y] for (_, label), p in zip(given, post) if label == 1)
            every = sum(((1 - p), p)[y] for (_, label), p in zip(given, post) if label is not None)
            said.append(min(high, max(low, (ones + extra) / (every + 2))))
        post = []
        for v, label in given:
            joint = []
            for y in (0, 1):
                p = prior if y else 1 - prior
                for j in range(voters):
                    p *= rate[y][j] if v[j] else 1 - rate[y][j]
                joint.append(p * (1 if label is None else said[y] if label else 1 - said[y]))
            post.append(joint[1] / sum(joint))
    return post


def drawn(n, seed, rates, prior=0.3, copies=0):
    """Votes of independent voters (the first one given again copies times) with labels on a third of the rows, one in ten wrong."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < prior)
        v = [int(rng.random() < r[y]) for r in rates]
        label = (y if rng.random() < 0.9 else 1 - y) if rng.random() < 1 / 3 else None
        out.append((tuple(v + v[:1] * copies), label, y))
    return out


def by_pattern(given):
    counted = Counter((sum(b << j for j, b in enumerate(v)), label) for v, label, _ in given)
    masks = sorted({m for m, _ in counted})
    return np.array(masks), np.array([[counted[m, k] for k in (None, 0, 1)] for m in masks], float)


BOUNDS = np.array([[0.001, 0.6], [0.2, 0.999]])
RATES = [(0.05, 0.7), (0.1, 0.6), (0.02, 0.5), (0.2, 0.4)]


def test_posteriors_equal_plain_em():
    given = drawn(400, 1, RATES)
    masks, counts = by_pattern(given)
    posterior, _ = fitted_label_model(masks, counts, voters=4, rounds=12, tree=False, bounds=BOUNDS)
    at = {int(m): i for i, m in enumerate(masks)}
    want = plain_em([(v, label) for v, label, _ in given], 4, 12)
    for (v, label, _), p in zip(given, want):
        assert math.isclose(posterior[at[sum(b << j for j, b in enumerate(v))], (None, 0, 1).index(label)], p, rel_tol=1e-6, abs_tol=1e-9)


def test_rates_of_voters_and_labels_are_recovered():
    _, model = fitted_label_model(*by_pattern(drawn(40_000, 2, RATES)), voters=4, tree=False, bounds=BOUNDS)
    assert abs(model.prior - 0.3) < 0.04
    assert all(abs(a - b) < 0.05 for own, want in zip(model.rates, RATES) for a, b in zip(own, want))
    assert abs(model.label_rates[1] - 0.9) < 0.05 and abs(model.label_rates[0] - 0.1) < 0.05


def test_a_voter_that_repeats_another_counts_little():
    """A sixth voter says what the first says in 7 of 10 documents: with the tree posteriors stay as good as without it."""
    rng = random.Random(103)
    five = drawn(20_000, 3, [*RATES, (0.03, 0.6)])
    six = [((*v, v[0] if rng.random() < 0.7 else int(rng.random() < (0.05, 0.7)[y])), label, y) for v, label, y in five]

    def loss(given, voters, tree):
        masks, counts = by_pattern(given)
        posterior, model = fitted_label_model(masks, counts, voters=voters, tree=tree, bounds=BOUNDS)
        at = {int(m): i for i, m in enumerate(masks)}
        p = [posterior[at[sum(b << j for j, b in enumerate(v))], 0] for v, _, _ in given]
        return -sum(math.log(q if y else 1 - q) for q, (_, _, y) in zip(p, given)) / len(given), model

    (with_tree, model), (without, _), (alone, _) = loss(six, 6, True), loss(six, 6, False), loss(five, 5, False)
    assert model.parents[5] == 0 and model.correlations[0][5] > 0.1
    assert with_tree < 0.6 * without and with_tree < 1.1 * alone, (with_tree, without, alone)


def test_beginnings_that_tell_the_same_are_left_out():
    given = [("idio*", 50, 1), ("idiot", 50, 1), ("idiotx", 9, 0), ("trash", 40, 0), ("tras*", 41, 0), ("tea", 8, 1)]
    assert told_apart(given) == ["idio*", "idiotx", "trash", "tea"]
