"""Newton-boosted trees against a plain version that sorts values, and their properties."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pitchframe.operators import models as M
from pitchframe.operators.newton_trees import NewtonTrees, Tree, TreesConfig, fitted

CONFIG = TreesConfig(rounds=8, depth=3, rate=0.3, l2=2.0, least_weight=1.0)


def rows(n=1500, missing=0.2, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = round(rng.gauss(0, 1), 1), rng.randrange(8), round(rng.uniform(0, 5), 1)
        gone = rng.random() < missing
        p = 1 / (1 + math.exp(-(1.5 * a - 0.4 * b + (2.0 if gone else 0.0) - (c > 3))))
        out.append((None if gone else a, float(b), float("nan") if rng.random() < 0.05 else c, rng.random() < p))
    return out


def plain_fit(data, config):
    """One value after another as threshold, gains by plain sums over rows."""
    y = [float(r[-1]) for r in data]
    x = [[None if v is None or v != v else v for v in r[:-1]] for r in data]
    mean = sum(y) / len(y)
    margin, trees = [math.log(mean / (1 - mean))] * len(y), []

    def gain(g, h):
        return g * g / (h + config.l2)

    def grown(own, depth):
        g, h = sum(grad[i] for i in own), sum(hess[i] for i in own)
        best = None
        if depth:
            for f in range(len(x[0])):
                known = sorted({x[i][f] for i in own if x[i][f] is not None})
                for cut in known:
                    for missing_left in (False, True):
                        left = [i for i in own if (missing_left if x[i][f] is None else x[i][f] <= cut)]
                        if not 0 < len(left) < len(own):
                            continue
                        gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        if min(hl, h - hl) < config.least_weight:
                            continue
                        score = gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h)
                        if score > 1e-9 and (best is None or score > best[0] * (1 + 1e-9)):
                            best = (score, f, cut, missing_left, left)
        if best is None:
            return -config.rate * g / (h + config.l2)
        _, f, cut, missing_left, left = best
        inside = set(left)
        return (f, cut, missing_left, grown(left, depth - 1), grown([i for i in own if i not in inside], depth - 1))

    def value(tree, r):
        while isinstance(tree, tuple):
            f, cut, missing_left, a, b = tree
            tree = a if (missing_left if r[f] is None else r[f] <= cut) else b
        return tree

    for _ in range(config.rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        trees.append(grown(list(range(len(y))), config.depth))
        margin = [m + value(trees[-1], r) for m, r in zip(margin, x)]
    return [1 / (1 + math.exp(-m)) for m in margin]


def loss(p, y):
    return sum(-math.log(a if b else 1 - a) for a, b in zip(p, y)) / len(y)


def table(spark, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, a double, b double, c double, y boolean").repartition(3)
    return df


def scores(df, model: NewtonTrees):
    return [r["p"] for r in df.select("i", model.probability().alias("p")).orderBy("i").collect()]


def test_losses_equal_a_plain_version(spark):
    data = rows(600)
    config = replace(CONFIG, rounds=3)
    df = table(spark, data)
    model = fitted(df, ["a", "b", "c"], "y", config)
    ours, theirs = scores(df, model), plain_fit(data, config)
    y = [r[-1] for r in data]
    assert abs(loss(ours, y) / loss(theirs, y) - 1) < 0.01
    assert max(abs(a - b) for a, b in zip(ours, theirs)) < 1e-6  # few distinct values: the bins are the values


def test_missing_values_have_a_side_of_their_own(spark):
    data = [(None if i % 2 else 1.0 + i % 5, 0.0, 0.0, bool(i % 2)) for i in range(400)]
    df = table(spark, data)
    model = fitted(df, ["a", "b", "c"], "y", replace(CONFIG, rounds=4, depth=1))
    p = scores(df, model)
    assert min(p[1::2]) > 0.7 > 0.3 > max(p[::2])
    assert model.importance()["a"] == 1.0


def test_early_stopping_keeps_the_best_round(spark):
    rng = random.Random(1)
    data = [(round(rng.random(), 2), float(rng.randrange(20)), round(rng.random(), 2), rng.random() < 0.5) for _ in range(400)]  # nothing to learn
    df = table(spark, data)
    model = fitted(df, ["a", "b", "c"], "y", replace(CONFIG, rounds=30, depth=4, rate=0.5, patience=3), valid=F.col("i") % 2 == 0)
    assert len(model.losses) < 30 and len(model.trees) == model.losses.index(min(model.losses))


def test_margins_carried_on_change_nothing(spark, monkeypatch):
    data = rows(300)
    df = table(spark, data)
    config = replace(CONFIG, rounds=5, row_share=0.8, column_share=0.7)
    whole = fitted(df, ["a", "b", "c"], "y", config)
    monkeypatch.setattr("pitchframe.operators.newton_trees.REFRESH", 2)
    parts = fitted(df, ["a", "b", "c"], "y", config)
    assert max(abs(a - b) for a, b in zip(scores(df, whole), scores(df, parts))) < 1e-9


def test_leaves_are_limited_and_the_table_tells_the_trees(spark):
    df = table(spark, rows(500))
    model = fitted(df, ["a", "b", "c"], "y", replace(CONFIG, rounds=2, depth=5, leaves=4, row_share=1.0))
    nodes = model.table(spark).collect()
    for t in range(2):
        assert sum(r["feature"] is None for r in nodes if r["tree"] == t) == 4
    assert all((r["left"] is None) == (r["feature"] is None) for r in nodes)


@pytest.mark.parametrize("outcome", [True, False])
def test_one_class_gives_its_base_rate(spark, outcome):
    df = table(spark, [(1.0, 2.0, 3.0, outcome)] * 20)
    model = fitted(df, ["a", "b", "c"], "y", CONFIG)
    assert not model.trees and all(abs(p - outcome) < 1e-6 for p in scores(df, model))


def test_an_empty_table_and_wrong_calls(spark):
    df = table(spark, rows(5)).filter("false")
    assert not fitted(df, ["a"], "y", CONFIG).trees
    with pytest.raises(ValueError):
        fitted(df, [], "y", CONFIG)
    with pytest.raises(ValueError):
        M.action_model("forest", 10)


def test_models_are_chosen_by_name_and_size():
    assert M.action_model(" XGBoost", 49_999).newton.depth == 3 and M.action_model("xgb", 50_000).newton.depth == 5
    assert M.action_model("logistic_regression", 10).kind == "logistic"
    assert M.shot_model("lightgbm").newton.leaves == 24 and M.pass_model("xgboost").newton.rounds == 500 and M.pass_model("logistic").inverse_penalty == 0.7


def test_a_tree_walks_as_it_was_split():
    import numpy as np

    tree = Tree()
    a, b = tree.split(0, 0, 2, True, 1.0)
    tree.split(b, 1, 1, False, 1.0)
    bins = np.array([[0, 1], [2, 9], [3, 1], [3, 2], [3, 0]], np.uint8)
    assert tree.nodes(bins, 2).tolist() == [a, a, 3, 4, 4]
