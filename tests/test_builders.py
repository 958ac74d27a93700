"""From folders to tables: discovery with and without an index, actions, shots, passes, and ranks over whole tables."""

from __future__ import annotations

import json

import pytest
from test_feeds import MATCH, root  # noqa: F401  the fixture

from pitchframe.functions.stats import agreement
from pitchframe.operators import physical as Y
from pitchframe.plans import builders as B


def test_matches_of_an_index_need_files(spark, root):  # noqa: F811
    index = str(root / "matches_index.csv")
    assert [r["match_id"] for r in B.matches(spark, str(root), index).collect()] == ["77", "88"]  # 66 has no files, 99 is open
    assert [r["match_id"] for r in B.matches(spark, str(root), index, ["2024"], 1).collect()] == ["77"]
    assert {r["match_id"]: bool(r["match_path"]) for r in B.matches(spark, str(root)).collect()} == {"77": True, "88": False}
    with pytest.raises(FileNotFoundError):
        B.matches(spark, str(root), index, ["1999"])


def test_actions_shots_and_passes_from_files(spark, root):  # noqa: F811
    made = B.action_table(spark, str(root)).collect()
    assert [(r["match_id"], r["event_id"]) for r in made] == [("77", "1:carry"), ("77", "1:pass"), ("88", "1:shot")]  # 88 says no start of its carry
    carry = made[0]
    assert abs(carry["end_x"] - 10 * 105 / 100) < 1e-9 and carry["season_name"] == "2024"  # a pitch of 100 m
    assert B.shot_table(spark, str(root)).count() == 1 and B.pass_table(spark, str(root), per_season=1).count() == 1
    assert B.pass_table(spark, str(root), in_all=1, limit=1).count() == 1
    B.action_table(spark, str(root)).write.parquet(str(root / "cache" / "77_cache" / "events_aug.parquet"))
    assert B.action_source(spark, "cache", str(root / "cache" / "*" / "events_aug.parquet")).count() == 3
    with pytest.raises(ValueError):
        B.action_source(spark, "other", str(root))


def test_matches_in_nested_folders_are_found(spark, tmp_path):
    deep = tmp_path / "data" / "matches" / "12"
    deep.mkdir(parents=True)
    (deep / "12_dynamic_events.csv").write_text("event_id,event_type,end_type,x_start,y_start,x_end,y_end\n1,player_possession,shot,0,0,40,3\n")
    (deep / "12_match.json").write_text(json.dumps({**MATCH, "id": 12}))
    assert B.shot_table(spark, str(tmp_path)).first()["match_id"] == "12"


@pytest.mark.parametrize("grouped", [True, False])
def test_ranks_of_a_whole_table_equal_those_of_a_group(spark, grouped):
    rows = [(float(i * 7 % 13), float(i % 5), "g") for i in range(60)] + [(None, 1.0, "g")]
    df = spark.createDataFrame(rows, "a double, b double, g string")
    found = agreement(df, "a", "b", ["g"] if grouped else []).first()
    a, b = [r[0] for r in rows[:60]], [r[1] for r in rows[:60]]
    rank = lambda v, x: sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2
    ra, rb = [rank(a, x) for x in a], [rank(b, x) for x in b]
    mean = lambda v: sum(v) / len(v)
    cov = mean([x * y for x, y in zip(ra, rb)]) - mean(ra) * mean(rb)
    spread = lambda v: (mean([x * x for x in v]) - mean(v) ** 2) ** 0.5
    assert found["n"] == 60 and abs(found["spearman"] - cov / spread(ra) / spread(rb)) < 1e-9


def test_rates_by_30_and_90_minutes(spark):
    rows = spark.createDataFrame([("l", "m", "p", 90.0, 60.0, 20.0, 30.0, "Midfield"), ("l", "m", "q", 80.0, 0.0, 0.0, 8.0, "Midfield")], "league string, match_id string, player_id string, played_minutes double, bip_minutes double, tip_minutes double, runs double, position_group string")
    assert [round(r["runs_p30_tip"], 6) for r in Y.p30_rates(rows, ["runs"]).collect()] == [45.0]
    assert sorted(round(r["runs_p90"], 6) for r in Y.p90_rates(rows, ["runs"]).collect()) == [9.0, 30.0]
    assert Y.league_rates(rows, ["runs"], ["league"]).first()["runs_p60_bip"] == 30.0
