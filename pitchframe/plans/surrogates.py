"""Match data made from the driver's tables by integer arithmetic, the same in Spark and in DuckDB.

The tables hold no matches. Each column is one SQL expression that both engines read; `//` is whole division. Matches are
groups of 15 users, so their number grows with the data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = {
    "event_id": "event_id",
    "parent_pp_id": "'e' || (event_id // 2)",
    "match_id": "'m' || (user_id // 15)",
    "season_name": "'s' || (user_id // 15 % 3)",
    "phase_index": "event_id // 40",
    "player_id": "'p' || user_id",
    "player_name": "'player ' || (user_id % 40)",
    "player_position": "CASE user_id % 5 WHEN 0 THEN 'CB' WHEN 1 THEN 'LB' WHEN 2 THEN 'CM' WHEN 3 THEN 'LW' ELSE 'CF' END",
    "team_id": "'t' || (user_id // 15 * 2 + user_id % 2)",
    "home_team_id": "'t' || (user_id // 15 * 2)",
    "away_team_id": "'t' || (user_id // 15 * 2 + 1)",
    "team_shortname": "'Team ' || (user_id % 8)",
    "period_id": "1 + event_id // 40 % 2",
    "time_seconds": "event_id / 10e0",
    "action_type": "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'carry' WHEN 'signup' THEN 'cross' WHEN 'purchase' THEN 'shot' ELSE 'pass' END",
    "move_success": "event_type <> 'error' AND event_type <> 'purchase'",
    "goal": "event_type = 'purchase' AND event_id % 7 = 0",
    "start_x": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id * 37 % 1051 / 10e0 - 52.5e0 END",
    "start_y": "event_id * 53 % 681 / 10e0 - 34e0",
    "end_x": "CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_id * 71 % 1051 / 10e0 - 52.5e0 END",
    "end_y": "event_id * 89 % 681 / 10e0 - 34e0",
    "provider_threat": "CASE WHEN event_id % 3 = 0 THEN event_id * 13 % 1000 / 1000e0 END",
    "p_scores": "event_id * 13 % 1000 / 1000e0",
    "p_concedes": "event_id * 17 % 1000 / 1000e0",
    "type_name": "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'dribble' WHEN 'signup' THEN 'throw_in' WHEN 'purchase' THEN 'shot' ELSE 'tackle' END",
    "result_name": "CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND event_id % 7 <> 0) THEN 'fail' ELSE 'success' END",
    "bodypart_name": "CASE event_id % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'other' ELSE 'foot' END",
}
#: Passes: places, labels and two estimates for the rows of `events` that aren't purchases.
PASS = {c: EVENT[c] for c in ("event_id", "match_id", "season_name", "player_id", "player_name", "player_position", "team_shortname", "start_x", "start_y", "end_x", "end_y")} | {
    "passer_x": EVENT["start_x"], "passer_y": EVENT["start_y"], "target_x": EVENT["end_x"], "target_y": EVENT["end_y"],
    "possession_start_x": "event_id * 41 % 1051 / 10e0 - 52.5e0", "possession_start_y": "event_id * 43 % 681 / 10e0 - 34e0",
    "pass_outcome": "CASE WHEN event_type = 'error' THEN 'unsuccessful' WHEN event_id % 50 = 3 THEN 'offside' ELSE 'successful' END",
    "pass_completed": "event_type <> 'error' AND event_id % 50 <> 3",
    "model_xpass": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE (event_id * 13 % 997 + 1) / 1000e0 END",
    "provider_xpass": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE (event_id * 19 % 997 + 1) / 1000e0 END",
    "pass_range": "CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END",
    "pass_direction": "CASE event_id % 4 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'sideways_left' END",
    "first_line_break": "CASE WHEN event_id % 11 = 0 THEN 'yes' ELSE 'false' END",
    "last_line_break": "CASE WHEN event_id % 23 = 0 THEN 'TRUE' ELSE '0' END",
    "high_pass": "CASE WHEN event_id % 9 = 0 THEN '1' ELSE 'no' END",
    "third_start": "CASE event_id % 3 WHEN 0 THEN 'defensive_third' WHEN 1 THEN 'middle_third' ELSE 'attacking_third' END",
    "player_targeted_third_pass": "CASE event_id * 7 % 3 WHEN 0 THEN 'defensive_third' WHEN 1 THEN 'middle_third' ELSE 'attacking_third' END",
    "start_type": "CASE event_id % 13 WHEN 0 THEN 'corner_reception' WHEN 1 THEN 'throw_in_interception' ELSE 'pass_reception' END",
}
SHOT = {
    "event_id": "event_id", "season_name": EVENT["season_name"], "match_id": EVENT["match_id"],
    "shot_x": "event_id * 37 % 351 / 10e0 + 17.4e0", "shot_y": "event_id * 53 % 601 / 10e0 - 30e0",
    "possession_start_x": "event_id * 41 % 1051 / 10e0 - 52.5e0", "possession_start_y": "event_id * 43 % 681 / 10e0 - 34e0",
    "goal": "(event_id * 37 % 351) // 10 + event_id % 23 > 40", "is_header": "CASE WHEN event_id % 5 = 0 THEN 'True' ELSE 'false' END",
    "duration": "value", "start_type": PASS["start_type"],
    "model_xg": "(event_id * 13 % 997 + 1) / 1000e0",
}
#: Raw possessions as a feed gives them: text columns.
POSSESSION = {
    "event_id": "'e' || event_id", "match_id": EVENT["match_id"], "team_id": EVENT["team_id"], "player_id": EVENT["player_id"],
    "event_type": "CASE WHEN event_id % 10 = 9 THEN 'passing_option' ELSE 'player_possession' END",
    "end_type": "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'pass' WHEN 'purchase' THEN 'shot' ELSE 'clearance' END",
    "start_type": "CASE event_id % 13 WHEN 0 THEN 'corner' WHEN 1 THEN NULL ELSE 'pass_reception' END",
    "x_start": f"CAST({EVENT['start_x']} AS VARCHAR(20))", "y_start": f"CAST({EVENT['start_y']} AS VARCHAR(20))",
    "x_end": f"CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE CAST({EVENT['end_x']} AS VARCHAR(20)) END", "y_end": f"CAST({EVENT['end_y']} AS VARCHAR(20))",
    "player_targeted_x_pass": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id * 29 % 1101 / 10e0 - 55e0 AS VARCHAR(20)) END",
    "player_targeted_y_pass": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id * 31 % 681 / 10e0 - 34e0 AS VARCHAR(20)) END",
    "pass_outcome": "CASE event_id % 3 WHEN 0 THEN 'unsuccessful' ELSE 'successful' END",
    "carry": "CASE WHEN event_id % 6 = 0 THEN 'True' WHEN event_id % 6 = 1 THEN '0' END",
    "game_interruption_after": "CASE WHEN event_id % 7 = 0 THEN 'goal_for' END",
    "player_targeted_xthreat": "CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 100 / 100e0 AS VARCHAR(20)) END",
}
#: Positions at ten a second: a user's events in their order, a pause of two seconds after every 30, speeds in blocks of 8.
TRACK_BASE = {
    "event_id": "event_id", "user_id": "user_id",
    "n": "row_number() OVER (PARTITION BY user_id ORDER BY event_id)",
}
TRACK_STEP = {
    "event_id": "event_id", "user_id": "user_id", "n": "n",
    "mm": "CASE (n // 8 + user_id) % 4 WHEN 0 THEN 150 WHEN 1 THEN 480 WHEN 2 THEN 620 ELSE 780 END",
}
TRACK = {
    "match_id": EVENT["match_id"], "player_id": EVENT["player_id"], "period_id": "1", "frame_id": "n",
    "timestamp": "(n + 20 * ((n - 1) // 30)) / 10e0",
    "x": "CAST(sum(mm) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) / 1000e0 - 52.5e0", "y": "user_id * 53 % 681 / 10e0 - 34e0",
    "ball_state": "CASE WHEN n // 20 % 3 = 2 THEN 'dead' ELSE 'alive' END",
    "ball_owning_team_id": "CAST(user_id // 15 * 2 + n // 10 % 2 AS VARCHAR(20))", "team_id": "CAST(user_id // 15 * 2 + user_id % 2 AS VARCHAR(20))",
    "position_group": "CASE user_id % 5 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Full Back' WHEN 2 THEN 'Midfield' WHEN 3 THEN 'Winger' ELSE 'Forward' END",
    "is_detected": "event_id % 4 <> 0",
}
#: Player-match rows from orders.
PERFORMANCE = {
    "match_id": "'m' || (o_orderkey % 64)", "player_id": "'p' || o_custkey", "player_name": "'player ' || (o_custkey % 500)",
    "season_name": "'s' || (o_orderkey % 3)",
    "position_group": "CASE o_custkey % 6 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Full Back' WHEN 2 THEN 'Midfield' WHEN 3 THEN 'Winger' WHEN 4 THEN 'Forward' ELSE NULL END",
    "played_minutes": "o_orderkey % 97 / 1e0", "bip_minutes": "o_orderkey % 61 / 1e0", "tip_minutes": "o_orderkey % 29 / 1e0", "otip_minutes": "o_orderkey % 31 / 1e0",
    "total_distance_m": "o_orderkey * 7 % 12000 / 1e0", "hsr_distance_m": "o_orderkey * 11 % 900 / 1e0", "sprint_count": "o_orderkey % 17",
    "distance_tip_m": "o_orderkey * 13 % 5000 / 1e0", "psv99_kmh": "o_orderkey * 3 % 300 / 10e0 + 5e0", "max_speed_kmh": "o_orderkey * 5 % 300 / 10e0 + 8e0",
}


def _duck(columns: dict[str, str], table: str, where: str = "") -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}" + (f" WHERE {where}" if where else "")


def _spark(df: DataFrame, columns: dict[str, str], where: str = "") -> DataFrame:
    df = df.where(where) if where else df
    return df.selectExpr(*[f"{e.replace('//', 'div').replace('VARCHAR(20)', 'STRING')} AS {c}" for c, e in columns.items()])


NOT_SHOT = "event_type <> 'purchase'"
IS_SHOT = "event_type = 'purchase'"
CTES = {
    "actions": _duck(EVENT, "events"),
    "passes": _duck(PASS, "events", NOT_SHOT),
    "shots": _duck(SHOT, "events", IS_SHOT),
    "possessions": _duck(POSSESSION, "events"),
    "track_base": _duck(TRACK_BASE, "events"),
    "track_step": _duck(TRACK_STEP, "track_base"),
    "tracks": _duck(TRACK, "track_step"),
    "performances": _duck(PERFORMANCE, "orders"),
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(_events(spark, sf_dir), EVENT)


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(_events(spark, sf_dir), PASS, NOT_SHOT)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(_events(spark, sf_dir), SHOT, IS_SHOT)


def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(_events(spark, sf_dir), POSSESSION)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _spark(_events(spark, sf_dir).select("event_id", "user_id"), TRACK_BASE)
    return _spark(_spark(base, TRACK_STEP), TRACK)


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark.read.parquet(f"{sf_dir}/orders.parquet"), PERFORMANCE)


@dataclass
class Registry:
    """Queries by name, and their SQL where SQL can express them."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, plain: str, numbers: str = "", uses: str = "", ctes: str = "", rows: str | None = None, recursive: bool = False):
        """plain and numbers: output columns; numbers are rounded to six places on both sides.

        uses: surrogate tables of the SQL; ctes: further ones; rows: what follows FROM (None: no SQL); recursive: whether a CTE reads itself."""

        def register(make: Callable[[SparkSession, str], DataFrame]):
            a, b = plain.split(), numbers.split()

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = make(spark, sf_dir)
                whole = {"int", "smallint", "tinyint"}
                kinds = dict(df.dtypes)
                own = [F.col(c).cast("long").alias(c) if kinds[c] in whole else F.col(c) for c in a]
                return df.select(*own, *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in b])

            self.queries[name] = run
            if rows is not None:
                needed = [f"{t} AS ({CTES[t]})" for t in uses.split()]
                head = ",\n".join([*needed, *([ctes] if ctes else [])])
                out = ", ".join([*a, *[f"round({c}::DOUBLE, 6) + 0e0 AS {c}" for c in b]])
                self.sql[name] = (f"WITH {'RECURSIVE ' * recursive}{head}\n" if head else "") + f"SELECT {out} FROM {rows}"
            return make

        return register
