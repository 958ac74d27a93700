"""Rankings by sums and distances: what ties must tie to the last bit, as it does in SQL."""

import duckdb
from oracle import same_rows
from pyspark.sql import functions as F

from pitchframe.operators import animation, report
from pitchframe.plans.catalog import ORACLE_SQL, QUERIES


def test_sums_of_a_zone_tie_however_they_were_added(spark):
    rows = [("b", 0.1), ("b", 0.2), ("b", 0.3), ("a", 0.6), ("c", 0.5)]  # 0.1 + 0.2 + 0.3 is more than 0.6 by a bit
    moves = spark.createDataFrame([("T", 0, 0, p, 1 + (p == "a"), 0, v) for p, v in rows], "team_shortname string, x_cell int, y_cell int, player_name string, end_x_cell int, end_y_cell int, value double")
    moves = moves.coalesce(1).withColumns({"net_value": F.col("value"), "progression": F.lit(1.0)})
    ranked = report.danger_players(moves).orderBy("place").collect()
    assert [(r["player_name"], r["xT"]) for r in ranked] == [("a", 0.6), ("b", 0.6), ("c", 0.5)]
    zones = report.danger_destinations(moves.filter("player_name <> 'c'")).orderBy("place").collect()
    assert [(r["end_x_cell"], r["xT"]) for r in zones] == [(1, 0.6), (2, 0.6)]


def test_leaders_of_zones_on_more_events(spark, tmp_path):
    source = "read_parquet('/root/testdata/sf0.1/events.parquet')"
    duckdb.sql(f"SELECT * EXCLUDE (k) REPLACE (event_id + k * 100000 AS event_id, user_id + k * 1500 AS user_id) FROM {source}, range(6) r(k)").write_parquet(str(tmp_path / "events.parquet"))
    same_rows(QUERIES["danger_zone_players"](spark, str(tmp_path)), ORACLE_SQL["danger_zone_players"], str(tmp_path))


def test_shifts_that_tie_are_ranked_by_what_follows(spark):
    # Distances whose sums of squares are equal; hypot gives those of the first two one bit more.
    events = spark.createDataFrame([(i,) for i in (1591895, 5170550, 3419584, 4851046)], "original_event_id long")
    at = lambda factor, size, half: F.expr(f"original_event_id * {factor} % {size} / 10D - {half}D")
    x0, y0, x1, y1 = at(37, 1051, 52.5), at(53, 681, 34), at(71, 1051, 52.5), at(89, 681, 34)
    synced = events.select(
        "original_event_id", x0.alias("start_x"), y0.alias("start_y"), x1.alias("start_x_synced"), y1.alias("start_y_synced"),
        F.lit(0.0).alias("end_x"), y1.alias("end_y"), F.expr("CASE WHEN original_event_id % 5 <> 0 THEN 0D END").alias("end_x_synced"), y0.alias("end_y_synced"),
    )
    assert [r["original_event_id"] for r in animation.ranked_shifts(synced, 2).collect()] == [3419584, 4851046]
