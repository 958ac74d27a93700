"""Feeds of files: index, events of differing shapes, match JSON, tracking, the action language, sinks, streams."""

from __future__ import annotations

import json

import pytest

from pitchframe.operators import actions as A
from pitchframe.operators import animation as N
from pitchframe.operators import threat as T
from pitchframe.operators import tracking
from pitchframe.operators import value_chain as V
from pitchframe.sources import feeds, sinks, spadl
from pitchframe.streaming.tracks import arriving, live_segments

MATCH = {
    "id": 77, "date_time": "2024-05-01T18:00:00Z", "pitch_length": 100, "pitch_width": 68, "home_team": {"id": 1, "name": "Home FC", "short_name": "Home"},
    "away_team": {"id": 2, "name": "Away FC", "short_name": "Away"}, "home_team_score": 2, "away_team_score": None, "home_team_side": ["left_to_right", "right_to_left"],
    "competition_edition": {"competition": {"id": 5, "name": "Cup"}, "season": {"id": 9, "name": "2024"}}, "competition_round": {"id": 3, "name": "R3", "round_number": 3},
    "match_periods": [{"period": 1, "name": "p1", "start_frame": 10, "end_frame": 20}, {"period": 2, "name": "p2", "start_frame": 30, "end_frame": 40}],
    "players": [
        {"id": 11, "team_id": 1, "short_name": "A", "number": 1, "start_time": "00:00:00", "player_role": {"name": "Goalkeeper", "acronym": "GK", "position_group": "Other"}, "playing_time": {"total": {"minutes_played": 90.0, "start_frame": 10, "end_frame": 40}}},
        {"id": 12, "team_id": 2, "short_name": "B", "number": 9, "start_time": None, "player_role": {"name": "Center Forward", "acronym": "CF", "position_group": "Center Forward"}, "playing_time": {"total": None}},
    ],
}


@pytest.fixture
def root(tmp_path):
    a, b = tmp_path / "77", tmp_path / "88"
    a.mkdir(), b.mkdir()
    (a / "77_dynamic_events.csv").write_text("event_id,match_id,event_type,end_type,x_start,y_start,x_end,y_end,pass_outcome\n1,77,player_possession,pass,0,0,10,5,successful\n2,77,off_ball_run,,1,1,2,2,\n")
    (b / "dynamic_events.csv").write_text("y_end,x_end,event_id,event_type,end_type,carry\n3,40,1,player_possession,shot,True\n")
    (a / "77_match.json").write_text(json.dumps(MATCH, indent=1))
    frames = [
        {"frame": 12, "timestamp": "00:00:00.20", "period": 1, "ball_data": {"x": 1.0, "y": 2.0, "z": 0.0, "is_detected": True}, "possession": {"player_id": 11, "group": "home team"}, "player_data": [{"x": 10.0, "y": 4.0, "player_id": 11, "is_detected": True}]},
        {"frame": 31, "timestamp": "00:45:00.10", "period": 2, "ball_data": {"x": None, "y": None, "z": None, "is_detected": None}, "possession": {"player_id": None, "group": None}, "player_data": [{"x": 10.0, "y": 4.0, "player_id": 12, "is_detected": False}]},
        {"frame": 1, "timestamp": None, "period": None, "ball_data": {}, "possession": {}, "player_data": []},
    ]
    (a / "77_tracking.jsonl").write_text("\n".join(map(json.dumps, frames)))
    (tmp_path / "matches_index.csv").write_text("match_id,season_name,status,date_time,match_dir\n88,2024,closed,2024-02,x\n77,2024,Closed,2024-01,x\n99,2024,open,2024-03,x\n66,2023,closed,2023-01,x\n")
    return tmp_path


def test_index_and_discovery(spark, root):
    assert [r["match_id"] for r in feeds.match_index(spark, str(root / "matches_index.csv"), ["2024"]).collect()] == ["77", "88"]
    assert feeds.match_index(spark, str(root / "matches_index.csv"), with_open=True).count() == 4
    assert [r["match_id"] for r in feeds.discovered_matches(spark, str(root)).collect()] == ["77", "88"]
    assert feeds.discovered_matches(spark, str(root), 1).count() == 1
    (root / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        feeds.discovered_matches(spark, str(root / "none"))


def test_events_of_files_with_differing_columns(spark, root):
    paths = [r["path"] for r in feeds.discovered_matches(spark, str(root)).collect()]
    wanted = ["event_id", "end_type", "x_start", "y_start", "x_end", "y_end", "pass_outcome", "carry"]
    rows = {(r["match_id"], r["event_id"]): r for r in feeds.dynamic_events(spark, paths, wanted).collect()}
    assert rows["88", "1"]["x_end"] == "40" and rows["88", "1"]["x_start"] is None and rows["77", "1"]["y_end"] == "5"
    assert feeds.dynamic_events(spark, paths, wanted, ["off_ball_run"]).count() == 1
    made = A.prepared(A.from_possessions(feeds.dynamic_events(spark, paths, wanted)))
    assert sorted(r["event_id"] for r in made.collect()) == ["1:carry", "1:pass", "1:shot"]


def test_match_json_gives_metadata_lineup_and_tracking(spark, root):
    raw = feeds.match_json(spark, [str(root / "77" / "77_match.json")])
    meta = feeds.match_metadata(raw).first()
    assert (meta["match_id"], meta["season_name"], meta["home_team_shortname"], meta["final_score"], meta["raw_pitch_length"]) == ("77", "2024", "Home", None, 100.0)
    players = feeds.lineups(raw)
    by_id = {r["player_id"]: r for r in players.collect()}
    assert by_id["11"]["position_group"] == "Goalkeeper" and by_id["11"]["appearance_end_seconds"] == 3.0 and by_id["11"]["provider_playing_time_ms"] == 5_400_000.0
    assert by_id["12"]["home_away"] == "away" and by_id["12"]["appearance_start_seconds"] is None
    rows = feeds.tracking_rows(feeds.tracking_jsonl(spark, [str(root / "77" / "77_tracking.jsonl")]), raw, players)
    got = {(r["frame_id"], r["player_id"]): r for r in rows.collect()}
    assert set(got) == {(12, "ball"), (12, "11"), (31, "12")}
    assert got[12, "11"]["x"] == pytest.approx(10.5) and got[12, "11"]["ball_state"] == "alive" and got[12, "11"]["timestamp"] == pytest.approx(0.2)
    assert got[31, "12"]["x"] == pytest.approx(-10.5) and got[31, "12"]["ball_state"] == "dead" and got[31, "12"]["match_seconds"] == pytest.approx(2.1)
    assert feeds.first_frames(rows, 1).count() == 2
    assert tracking.canonical(rows).count() == 2
    assert tracking.with_ball_owner(rows).count() == 3


def event(index, kind, team, x, y, **more):
    return {"id": str(index), "index": index, "period": 1, "timestamp": f"00:00:{index:02d}.500", "type": {"id": 1, "name": kind}, "team": {"id": team, "name": "t"}, "player": {"id": 7, "name": "P"}, "location": [x, y], **more}


def test_event_json_to_actions(spark, tmp_path):
    rows = [
        event(1, "Pass", 1, 60.0, 40.0, **{"pass": {"end_location": [80.0, 20.0], "body_part": {"id": 1, "name": "Right Foot"}}}),
        event(2, "Pass", 2, 60.0, 40.0, **{"pass": {"end_location": [120.0, 80.0], "type": {"id": 1, "name": "Corner"}, "cross": True, "outcome": {"id": 1, "name": "Incomplete"}}}),
        event(3, "Shot", 1, 110.0, 40.0, shot={"end_location": [120.0, 40.0, 1.0], "outcome": {"id": 1, "name": "Goal"}, "type": {"id": 1, "name": "Penalty"}, "body_part": {"id": 1, "name": "Head"}}),
        event(4, "Pressure", 1, 1.0, 1.0),
    ]
    (tmp_path / "555.json").write_text(json.dumps(rows))
    games = spark.createDataFrame([("555", "s", "1", "2")], "match_id string, season_name string, home_team_id string, away_team_id string")
    raw = spadl.events(spark, [str(tmp_path / "555.json")])
    out = V.with_score(V.canonical(spadl.to_actions(raw, games), {"1": 1, "2": 2}), ["source_index"]).orderBy("action_id").collect()
    assert [(r["type_name"], r["result_name"], r["bodypart_name"]) for r in out] == [("pass", "success", "foot"), ("corner_crossed", "fail", "foot"), ("shot_penalty", "success", "head")]
    assert out[0]["start_x"] == 0 and out[0]["end_y"] == pytest.approx(17.0) and out[1]["end_x"] == pytest.approx(-52.5) and out[1]["end_y"] == pytest.approx(34.0)
    assert out[2]["scoring_team_id"] == "1" and out[1]["period_id"] == 1 and out[1]["time_seconds"] == 2.5
    assert spadl.player_directory(raw).collect()[0]["player_name"] == "P"


def test_sinks_can_be_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    from pyspark.sql import functions as F

    summary = sinks.table_with_summary(df, str(tmp_path / "t"), df.agg(F.sum("v").alias("v"), F.count("k").alias("n")))
    assert summary == {"v": 3, "n": 2} and json.loads(sinks.read_text(spark, str(tmp_path / "t/summary"))) == summary
    assert sinks.tables({"x": df, "y": df.limit(1)}, str(tmp_path / "many"), "csv") == {"x": 2, "y": 1}
    surface = T.Surface(2, 2, [0.1, 0.2, 0.3, 0.4])
    sinks.save_surface(spark, surface, str(tmp_path / "s"))
    assert sinks.load_surface(spark, str(tmp_path / "s")).values == surface.values
    page = sinks.danger_zone_page('[{"team":"</script>","cells":[]}]', "zones")
    assert page.count("</script>") == 2


def test_the_window_of_an_event(spark):
    frames = spark.createDataFrame([(f, "1", "m", f / 10, o, o == "b", float(f), 1.0) for f in range(30) for o in ("h", "b")], "frame_id long, period string, match_id string, timestamp double, object_id string, ball boolean, x double, y double")
    event = spark.createDataFrame([("e1", "1", 10, None, "pass", "success", "h", "r", 0.0, 0.0, 3.0, 4.0, None, None, None, None)], "original_event_id string, period_id string, tracking_frame_id long, tracking_frame_id_end long, spadl_type string, result_name string, object_id string, receiver_object_id string, start_x double, start_y double, start_x_synced double, start_y_synced double, end_x double, end_y double, end_x_synced double, end_y_synced double")
    out = N.event_window(event, frames, "e1", 5, 7).collect()
    assert [r["frame_id"] for r in out] == list(range(5, 18))
    assert out[0]["h_x"] == 57.5 and out[0]["ball_x"] == 57.5 and out[0]["sync_start_x"] == 55.5 and out[0]["delta_text"] == "delta_start=5.00m, delta_end=nanm" and out[0]["orig_end_x"] is None
    with pytest.raises(KeyError):
        N.event_window(event, frames, "none")
    assert len(N.with_history(frames, ["object_id"], 3).filter("frame_id = 9").first()["trail"]) == 3


def test_segments_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda t: json.dumps({"match_id": "m", "player_id": "a", "period_id": 1, "timestamp": t, "x": t, "y": 0.0, "at": f"2024-01-01T00:00:{t:06.3f}Z"})
    (tmp_path / "in" / "1.json").write_text("\n".join(row(t) for t in (0.0, 0.1, 0.2, 1.5, 1.6, 40.0)))
    (tmp_path / "in" / "2.json").write_text(row(55.0))
    stream = live_segments(arriving(spark, str(tmp_path / "in")), late="1 seconds")
    run = stream.writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = sorted((r["first"], r["last"], r["samples"]) for r in spark.table("segments").collect())
    assert found[:2] == [(0.0, 0.2, 3), (1.5, 1.6, 2)]
