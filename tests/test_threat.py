"""The threat surface as a recursive query, against the loop on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.operators import threat as T
from pitchframe.plans import surrogates as S


def test_the_recursion_equals_the_loop_round_by_round(spark, matches_dir):
    actions = S.actions(spark, matches_dir)
    surface = T.fitted(actions, 8, 6)
    rounds = {(r["round"], r["cell"]): r["value"] for r in T.iterations(actions, 8, 6).collect()}
    assert max(k for k, _ in rounds) == surface.rounds == len(surface.history)
    assert all(abs(rounds[k + 1, c] - v) < 1e-12 for k, own in enumerate(surface.history) for c, v in enumerate(own))
    last = {r["cell"]: (r["rounds"], r["value"]) for r in T.converged(actions, 8, 6).collect()}
    assert all(last[c][0] == surface.rounds and abs(last[c][1] - v) < 1e-12 for c, v in enumerate(surface.values))


def test_rounds_are_limited_and_no_actions_give_nothing(spark, matches_dir):
    actions = S.actions(spark, matches_dir)
    assert T.iterations(actions, 4, 3, epsilon=0.0, most_rounds=5).agg(F.max("round")).first()[0] == 5
    none = T.converged(actions.filter("false"), 4, 3).collect()
    assert len(none) == 12 and all(r["value"] == 0 and r["rounds"] == 1 for r in none)
