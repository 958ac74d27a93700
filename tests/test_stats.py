"""Rank statistics against plain statements of them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pitchframe.functions import stats as S


@pytest.mark.parametrize("levels", [3, 50, 10**9])
def test_quantiles_and_areas_are_exact_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randrange(levels) / levels, rng.random() < 0.3, f"g{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "p double, y boolean, g string")
    shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1]
    assert S.exact_quantiles(df, "p", shares) == pytest.approx(np.quantile([r[0] for r in rows], shares).tolist(), abs=1e-12)
    for r in S.rank_sums(df, "y", "p", ["g"]).collect():
        pos, neg = ([p for p, y, g in rows if g == r["g"] and y == side] for side in (True, False))
        a, b = np.array(pos)[:, None], np.array(neg)[None, :]
        assert r["auc"] == pytest.approx(float(((a > b) + (a == b) / 2).mean()))


def test_an_empty_table_has_no_quantiles(spark):
    assert S.exact_quantiles(spark.createDataFrame([], "p double"), "p", [0.5]) == []
