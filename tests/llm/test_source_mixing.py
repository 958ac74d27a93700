import random
from collections import defaultdict

import pytest
from fixtures import KINDS, rows, table
from pyspark.sql import functions as F

from pitchframe.llm.common import landed
from pitchframe.llm.source_mixing import DIMS, KEEP, REST, ROUNDS, TARGETS, counted, drawn, fitted, margins, mixed, op10_source_mixing, with_probability

CELLS = "source string, lang string, topic string, n long"


def wanted(n, dim):
    """Target shares of the categories of a dimension, from tokens by cell."""
    held = defaultdict(float)
    for cell, tokens in n.items():
        held[cell[DIMS.index(dim)]] += tokens
    target = TARGETS[dim]
    if not isinstance(target, dict):
        shares = {k: v**target for k, v in held.items()}
    else:
        rest = sum(v for k, v in held.items() if k not in target)
        shares = {k: target.get(k, REST * v / rest if rest else 0.0) for k, v in held.items()}
    return held, {k: v / sum(shares.values()) for k, v in shares.items()}


def goals_of(n, dim):
    """What the sample should take of each category: its share of the kept tokens, what is missing spread over the others."""
    held, shares = wanted(n, dim)
    goal, open_, left = {}, dict(shares), KEEP * sum(held.values())
    while open_:
        scale = left / sum(open_.values())
        full = [k for k, v in open_.items() if v * scale >= held[k]]
        if not full:
            return goal | {k: v * scale for k, v in open_.items()}
        for k in full:
            goal[k] = held[k]
            left -= held[k]
            del open_[k]
    return goal


def raked(n, rounds=40):
    """Plain iterative proportional fitting under p <= 1: each margin's factor by bisection, no Newton step."""
    u = dict.fromkeys(n, KEEP)
    for _ in range(rounds):
        for d, dim in enumerate(DIMS):
            for category, goal in goals_of(n, dim).items():
                own = [k for k in n if k[d] == category]
                low, high = 0.0, 1e9
                for _ in range(80):
                    middle = (low * high) ** 0.5 if low else high / 1e6
                    low, high = (middle, high) if sum(n[k] * min(1, u[k] * middle) for k in own) < goal * (1 - 1e-12) else (low, middle)
                for k in own:
                    u[k] = min(u[k] * high, 1e9)
    return {k: min(1.0, v) for k, v in u.items()}


def cells_of(spark, n, times=1):
    return spark.createDataFrame([(*k, v * times) for k, v in n.items()], CELLS).coalesce(2)


def given_cells(seed=3, es=0.08):
    """Tokens near the targets; Spanish is short of its own, and two languages have none."""
    rng = random.Random(seed)
    langs = {"en": 0.55, "de": 0.2, "fr": 0.2, "es": es, "": 0.03, "xx": 0.01}
    return {
        (s, t, k): round(100_000 * share * lang * form * rng.uniform(0.7, 1.3))
        for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)) for t, lang in langs.items() for k, form in TARGETS["topic"].items()
    }


def test_probabilities_equal_those_of_plain_raking(spark):
    n = given_cells()
    want = raked(n)
    found = {tuple(r[d] for d in DIMS): r["p"] for r in fitted(cells_of(spark, n), rounds=ROUNDS).collect()}
    assert set(found) == set(n) and all(abs(found[k] - want[k]) < 1e-4 for k in n)


def test_margins_meet_their_goals_and_tell_what_is_short(spark):
    n = given_cells(5)
    found = margins(landed(fitted(cells_of(spark, n)), "test-cells")).collect()
    whole = sum(n.values())
    for r in found:
        goal, (held, shares) = goals_of(n, r["dim"])[r["category"]], wanted(n, r["dim"])
        assert abs(r["goal"] - goal) < 1e-6 * whole and abs(r["expected"] - goal) < 1e-4 * whole
        assert r["short"] == (shares[r["category"]] * KEEP * whole > held[r["category"]])
    assert abs(sum(r["expected"] for r in found if r["dim"] == "lang") - KEEP * whole) < 1e-3 * whole


@pytest.mark.parametrize("times", [100, 10_000_000])
def test_size_changes_nothing(spark, times):
    n = given_cells(9)
    small, large = ({tuple(r[d] for d in DIMS): r["p"] for r in fitted(cells_of(spark, n, t), rounds=2).collect()} for t in (1, times))
    assert all(abs(small[k] - large[k]) < 1e-9 for k in n)


def test_query_meets_its_targets(spark):
    """On the given tables: every feasible margin within 1 per cent, weighed by the probabilities that the query returns."""
    found = op10_source_mixing(spark, "/root/testdata/sf0.01").collect()
    n, kept = defaultdict(float), defaultdict(float)
    for r in found:
        cell = tuple(r[d] for d in DIMS)
        n[cell] += r["n_tokens"]
        for d in DIMS:
            kept[d, r[d]] += r["n_tokens"] * r["probability"]
    for d in DIMS:
        for category, goal in goals_of(n, d).items():
            assert abs(kept[d, category] - goal) <= 0.01 * goal + 1, (d, category)


def test_rows_keep_their_columns_and_equal_ids_are_drawn_alike(spark):
    df = table(spark)
    found = mixed(df)
    assert found.columns == df.columns
    seen = defaultdict(set)
    for r in with_probability(df).collect():
        seen[r["doc_id"], r["text"]].add(r["__taken"])
        assert 0 <= r["__p"] <= 1
    assert all(len(v) == 1 for v in seen.values())
    assert {r["doc_id"] for r in found.collect()} <= {i for i, *_ in rows()}


def test_draws_are_even(spark):
    share = spark.range(20_000).select((drawn(F.col("id")) < 0.3).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(share - 0.3) < 0.02


def test_an_empty_table_gives_an_empty_table(spark):
    empty = spark.createDataFrame([], KINDS)
    assert mixed(empty).count() == 0
    assert empty.select(*counted(empty)).count() == 0
