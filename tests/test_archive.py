"""The archive source: layouts, index, pushed filters, ranges of lines, mixed types."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pitchframe.sources import archive as R


@pytest.fixture
def root(tmp_path):
    def put(path, text):
        path = tmp_path / path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    frames = [{"frame": i, "timestamp": "t", "period": 1, "ball_data": {"x": i / 2, "y": 1}, "possession": {"player_id": 5, "group": "home team"}, "player_data": [{"player_id": 5, "x": 1.5, "y": 2, "is_detected": True}]} for i in range(50)]
    for match, folder in (("1", "data/matches/1"), ("2", "matches/2"), ("3", "3"), ("4", ".")):  # the four layouts
        put(f"{folder}/{match}_match.json", json.dumps({"id": match}, indent=1))
        put(f"{folder}/{match}_tracking_extrapolated.jsonl", "\n".join(map(json.dumps, frames)) + "\n" * (match == "2"))
        put(f"{folder}/{match}_dynamic_events.csv", "event_id,event_type,x\n" + f"a,\"one,\ntwo\",{match}\nb,,\n" if match != "3" else "x,event_id\n9,c\n")
    put("1/1_match.json", "another that comes later")
    put("index.csv", "match_id,season_name,status\n1,s0,closed\n2,s0,Closed\n3,s1,closed\n4,s1,open\n7,s1,closed\n")
    return tmp_path


def test_layouts_and_kinds(spark, root):
    rows = R.archive(spark, str(root))
    counts = {(r["match_id"], r["kind"]): r["count"] for r in rows.groupBy("match_id", "kind").count().collect()}
    assert counts == {(m, k): n for m in "1234" for k, n in (("match", 1), ("tracking", 50), ("dynamic_events", 1 if m == "3" else 2))}
    sheet = rows.filter("match_id = '1' and kind = 'match'").first()
    assert json.loads(sheet["value"]) == {"id": "1"} and sheet["path"].endswith("data/matches/1/1_match.json")


def test_tables_of_differing_shapes(spark, root):
    rows = R.table_rows(R.archive(spark, str(root)).filter("kind = 'dynamic_events'"), ["event_id", "event_type", "x"])
    assert sorted(tuple(map(str, r)) for r in rows.drop("season_name").collect() if r["match_id"] in "13") == [
        ("1", "a", "one,\ntwo", "1"), ("1", "b", "None", "None"), ("3", "c", "None", "9")
    ]


def test_an_index_gives_seasons_and_closed_matches(spark, root):
    rows = R.archive(spark, str(root), str(root / "index.csv")).filter("kind = 'match'")
    assert sorted((r["match_id"], r["season_name"]) for r in rows.collect()) == [("1", "s0"), ("2", "s0"), ("3", "s1")]


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 1000, 1 << 20])
def test_every_line_is_read_once_whatever_the_ranges(spark, root, range_bytes):
    rows = R.archive(spark, str(root), range_bytes=max(range_bytes, 60)).filter("kind = 'tracking' and match_id in ('1', '2')")
    frames = [json.loads(r["value"])["frame"] for r in rows.filter("match_id = '2'").collect()]
    assert sorted(frames) == list(range(50)) and rows.count() == 100


def test_filters_prune_files_before_they_are_planned(spark, root):
    reader = R.ArchiveReader({"path": str(root), "index": str(root / "index.csv"), "rangebytes": "1"})
    left = list(reader.pushFilters([R.EqualTo(("season_name",), "s0"), R.In(("kind",), ("match", "tracking")), R.EqualTo(("at",), 0)]))
    assert [f.attribute for f in left] == [("at",)]
    own = {(r[0], r[2]) for p in reader.partitions() for r in p.ranges}
    assert own == {(m, k) for m in "12" for k in ("match", "tracking")}
    rows = R.archive(spark, str(root), str(root / "index.csv"))
    plan = rows.filter("season_name = 's1' and kind = 'match'")
    assert [r["match_id"] for r in plan.collect()] == ["3"] and plan.rdd.getNumPartitions() == 1
    assert rows.filter("match_id = '1' and match_id = '2'").count() == 0


def test_mixed_types_cost_a_field_not_a_row(spark):
    lines = [
        {"frame": 1, "timestamp": "t", "period": 1, "ball_data": {"x": 1.5, "y": "2.5", "is_detected": True}, "possession": {"player_id": 7, "group": "home team"}, "player_data": [{"player_id": 7, "x": "far", "y": 1, "is_detected": "true"}]},
        {"frame": "x", "period": "2", "ball_data": None, "possession": {"player_id": "a"}, "player_data": {"player_id": 1}},
        {},
    ]
    texts = [*map(json.dumps, lines), "not json"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "match_id string, value string")
    rows = {r["match_id"]: r for r in R.typed_frames(df).collect()}
    a, b, c, d = (rows[str(i)] for i in range(4))
    assert (a["frame"], a["ball_data"]["y"], a["possession"]["player_id"], a["rejects"]) == (1, 2.5, "7", 1)
    assert a["player_data"][0]["x"] is None and a["player_data"][0]["y"] == 1.0 and a["player_data"][0]["is_detected"]
    assert (b["frame"], b["period"], b["possession"]["player_id"], b["player_data"], b["rejects"]) == (None, 2, "a", [], 2)
    assert (c["rejects"], d["rejects"]) == (0, 1) and d["frame"] is None
    counts = R.reject_counts(R.typed_frames(df).withColumn("all", F.lit(1)), ["all"]).first()
    assert (counts["frames"], counts["frames_with_rejects"], counts["rejects"]) == (4, 3, 4)


def test_written_files_are_read_back(spark, tmp_path):
    lines = spark.createDataFrame([("m1", 2, "b"), ("m1", 1, "a"), ("m2", 1, "é")], "match_id string, at long, line string")
    made = R.written(lines, f"file://{tmp_path}", "tracking.jsonl").collect()
    assert sorted((r["match_id"], r["bytes"]) for r in made) == [("m1", 4), ("m2", 3)]
    rows = R.archive(spark, f"file://{tmp_path}").orderBy("match_id", "at").collect()
    assert [(r["match_id"], r["value"]) for r in rows] == [("m1", "a"), ("m1", "b"), ("m2", "é")]
