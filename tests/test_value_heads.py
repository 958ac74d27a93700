"""The two heads of action values: what they need no median for, and that joined and carried labels give the same."""

import pytest
from pyspark.ml.feature import ImputerModel

from pitchframe.operators import models as M
from pitchframe.operators import value_chain as V
from pitchframe.plans.chain_queries import scored

KEYS = ["match_id", "action_id"]


@pytest.fixture(scope="module")
def labelled(spark):
    own = V.with_labels(scored(spark, "/root/testdata/sf0.01"))
    return M.last_matches_split(V.with_state_features(own, states=1, keep=["scores", "concedes"]), 2).select(*KEYS, "scores", "concedes", "split", "start_x_a0", "end_y_a0", "type_pass_a0")


def medians(models):
    return [s.getInputCols() for m in models.values() for s in m.pipeline.stages if isinstance(s, ImputerModel)]


def test_only_numbers_with_gaps_get_a_median(labelled):
    models, whole = M.two_heads_of(labelled, KEYS)
    assert medians(models) == [] and whole.filter("p_scores is null or p_concedes is null").isEmpty()
    some = labelled.selectExpr(*[c for c in labelled.columns if c != "end_y_a0"], "CASE WHEN action_id % 7 > 0 THEN end_y_a0 END AS end_y_a0")
    models, out = M.two_heads_of(some, KEYS)
    assert medians(models) == [["__n_end_y_a0"]] * 2 and out.count() == whole.count() and out.filter("p_scores is null").isEmpty()


def test_joined_and_carried_labels_give_the_same(labelled):
    features = labelled.drop("scores", "concedes", "split")
    a, b = ({tuple(r)[:2]: tuple(r)[2:] for r in out.collect()} for out in (M.two_heads(features, labelled, KEYS)[1], M.two_heads_of(labelled, KEYS)[1]))
    assert a.keys() == b.keys() and all(a[k][:3] == b[k][:3] and a[k][3:] == pytest.approx(b[k][3:], abs=1e-6) for k in a)
