"""Whole runs on the driver's tables, written and counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.operators import models as M
from pitchframe.operators import shots_passes as P
from pitchframe.plans import surrogates as S
from pitchframe.plans import workflows as W
from pitchframe.sources import sinks


def test_threat_run_is_written_whole(spark, matches_dir, tmp_path):
    actions = S.actions(spark, matches_dir)
    run = W.threat_run(actions, provider="provider_threat")
    counts = run.write(str(tmp_path / "threat"))
    assert counts["rated"] == actions.count() and counts["agreement"] == 1
    told = sinks.load_manifest(spark, str(tmp_path / "threat"))
    assert told["rounds"] == run.models["surface"].rounds and told["tables"]["rated"]["rows"] == counts["rated"]
    assert told["tables"]["rated"]["n_shot"] == actions.filter("action_type = 'shot'").count() and 0 < told["tables"]["rated"]["rated_share"] < 1
    assert sinks.load_surface(spark, str(tmp_path / "threat/models/surface")).values == run.models["surface"].values
    values = run.models["surface"].values
    assert all(0 <= v <= 1 for v in values) and max(values) > 0


def test_value_run_rates_every_player(spark, matches_dir):
    actions = S.actions(spark, matches_dir)
    run = W.value_run(actions, ["event_id"], test_matches=2, states=1)
    assert run.tables["ratings"].count() == actions.select("player_id").distinct().count()
    whole = run.tables["valued"].agg(F.count("vaep_value"), F.count(F.lit(1))).first()
    assert whole[0] == whole[1] == actions.count()
    assert {(r["split"], r["head"]) for r in run.tables["metrics"].collect()} == {(s, h) for s in ("train", "test") for h in ("scores", "concedes")}


def test_shot_and_pass_runs_score_both_sides(spark, matches_dir):
    few = {"logistic": M.ModelConfig(), "trees": M.ModelConfig("trees", rounds=3, depth=2)}
    shots = P.with_set_piece_flags(S.shots(spark, matches_dir))
    run = W.shot_run(shots, ["s0", "s1"], ["s2"], few, (["shot_x", "distance_to_goal", "shot_angle"], ["is_header"], ["start_type"]))
    best = run.tables["metrics"].filter("split = 'test'").orderBy("log_loss").first()
    assert 0 < best["log_loss"] < 0.7 and run.tables["scored"].count() == shots.count()
    run = W.pass_run(S.passes(spark, matches_dir).drop("model_xpass"), ["s0", "s1"], ["s2"], {"logistic": few["logistic"]}, (["pass_distance_feature", "pass_progression"], ["high_pass"], ["player_position"]))
    assert run.tables["types"].count() == 8 and run.tables["teams"].count() == 8


def test_physical_run_with_a_lineup(spark, matches_dir):
    frame = S.tracks(spark, matches_dir).filter("match_id in ('m0', 'm1')").drop("position_group", "team_id")
    lineup = frame.select("match_id", "player_id").distinct().withColumns({"position_group": F.lit("Midfield"), "team_id": F.lit("1"), "player_name": F.col("player_id"), "provider_playing_time_ms": F.lit(3.6e6)})
    run = W.physical_run(frame, lineup, least_matches=1)
    rows = run.tables["player_matches"]
    assert rows.count() == lineup.count() and "position_group_lineup" in rows.columns
    profiles = run.tables["profiles"].collect()
    assert len(profiles) == lineup.count() and 0 < min(r["max_speed_kmh_pct"] for r in profiles) < max(r["max_speed_kmh_pct"] for r in profiles) <= 100.0


def test_a_manifest_tells_configuration_eligibility_and_figures(spark, matches_dir, tmp_path):
    frame = S.tracks(spark, matches_dir).filter("match_id = 'm0'")
    run = W.physical_run(frame, least_minutes=0.0, least_matches=1)
    counts = run.write(str(tmp_path / "physical"))
    told = sinks.load_manifest(spark, str(tmp_path / "physical"))
    assert told["eligibility"]["least_minutes"] == 0.0 and told["config"]["estimator"] == "trailing_mean" and told["speed_thresholds_kmh"]["sprint"] == 25.0
    rows = spark.read.parquet(str(tmp_path / "physical/player_matches"))
    own = told["tables"]["player_matches"]
    assert own["rows"] == counts["player_matches"] == rows.count() and own["matches"] == 1
    assert abs(own["bip_minutes"] - rows.agg(F.sum("bip_minutes")).first()[0]) < 1e-9


def test_a_table_is_written_and_counted_in_one_job(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    found = sinks.observed(df, str(tmp_path / "t"), {"most": F.max("x"), "share": W.share(F.col("x") > 2)}, partition_by=["x"])
    assert found == {"rows": 1000, "most": 6, "share": 0.571} and spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_value_run_from_event_json_to_ratings(spark, tmp_path):
    """Event JSON of several matches through actions, labels, chosen trees and values to ratings of players."""
    import json
    import random

    from pitchframe.plans import builders as B

    rng, kinds = random.Random(2), ["Pass", "Carry", "Shot", "Pass"]
    for match in range(4):
        events = []
        for i in range(240):
            kind, team = rng.choice(kinds), 1 + (i // 6) % 2
            x = rng.uniform(60, 120)
            detail = {"Pass": {"pass": {"end_location": [min(119.0, x + 5), 40.0], "body_part": {"name": "Right Foot"}}}, "Carry": {"carry": {"end_location": [min(119.0, x + 3), 38.0]}},
                      "Shot": {"shot": {"end_location": [120.0, 40.0], "outcome": {"name": "Goal" if x > 105 else "Saved"}, "body_part": {"name": "Head"}, "type": {"name": "Open Play"}}}}[kind]
            events.append({"id": f"{match}-{i}", "index": i + 1, "period": 1 + i // 120, "timestamp": f"00:{i % 120 // 2:02d}:{i % 2 * 30:02d}.000", "minute": i // 4, "second": 0,
                           "type": {"name": kind}, "team": {"id": team, "name": f"t{team}"}, "player": {"id": 10 * team + i % 5, "name": "p"}, "location": [x, rng.uniform(0, 80)], **detail})
        (tmp_path / f"{match}.json").write_text(json.dumps(events))
    games = spark.createDataFrame([(str(m), "1", "2", "s") for m in range(4)], "match_id string, home_team_id string, away_team_id string, season_name string")
    chain = B.chain_table(spark, [str(tmp_path / f"{m}.json") for m in range(4)], games)
    assert chain.count() > 500
    few = M.ModelConfig("newton", newton=M.TreesConfig(rounds=3, depth=2, rate=0.3, least_weight=1.0))
    run = W.value_run(chain, ["source_index"], test_matches=1, config=few, states=1)
    players = run.tables["ratings"].collect()
    assert {r["player_id"] for r in players} == {r[0] for r in chain.select("player_id").distinct().collect()}
    counts = run.write(str(tmp_path / "out"))
    assert counts["valued"] == chain.count() and spark.read.parquet(str(tmp_path / "out/models/scores")).count() > 0
    rates = {r["split"]: r["log_loss"] for r in run.tables["metrics"].filter("head = 'scores'").collect()}
    assert set(rates) == {"train", "test"}
