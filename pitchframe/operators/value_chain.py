"""Values of actions in their chain: order, score, look-ahead labels, states of the game, value and ratings.

All windows are by match; ties of time are broken by an id, so that results don't depend on how files were read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import identity, number, number_or_null, ratio
from pitchframe.functions.pitch import GOAL_X

# Kinds that shoot, kinds that restart play, and the phase of each kind.
SHOTS = ["shot", "shot_penalty", "shot_freekick"]
RESTARTS = ["goalkick", "throw_in", "corner_crossed", "corner_short", "freekick_short", "freekick_crossed"]
PHASES = {
    "pass": ["pass", "cross", "throw_in", "freekick_short", "freekick_crossed", "corner_short", "corner_crossed", "goalkick"],
    "carry": ["dribble", "take_on"],
    "shot": SHOTS,
    "defend": ["tackle", "interception", "clearance", "ball_recovery", "dispossessed", "bad_touch", "foul", "shot_block",
               "keeper_save", "keeper_claim", "keeper_punch"],
}
# The public vocabulary of action kinds, results and body parts, with three further kinds.
KINDS = [
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short", "take_on", "foul",
    "tackle", "interception", "shot", "shot_penalty", "shot_freekick", "keeper_save", "keeper_claim", "keeper_punch",
    "keeper_pick_up", "clearance", "bad_touch", "non_action", "dribble", "goalkick", "ball_recovery", "dispossessed", "shot_block",
]
RESULTS = ["fail", "success", "offside", "owngoal", "yellow_card", "red_card"]
BODY_PARTS = ["foot", "head", "other", "head/other"]
HORIZON, STATES = 10, 3


def canonical(raw: DataFrame, periods: dict[str, int]) -> DataFrame:
    """The action schema: kinds known, ends where starts are if missing, periods as numbers, missing times 0."""
    period = F.lit(0)
    for name, n in periods.items():
        period = F.when(F.col("period_id").cast("string") == name, F.lit(n)).otherwise(period)
    out = raw.filter("type_name is not null").withColumns(
        {c: identity(c) for c in ("match_id", "team_id", "player_id", "home_team_id", "away_team_id")}
        | {"start_x": number("start_x"), "start_y": number("start_y"), "period_id": period}
        | {"bodypart_name": F.coalesce("bodypart_name", F.lit("other")), "time_seconds": F.coalesce(number_or_null(raw, "time_seconds"), F.lit(0.0))}
    )
    out = out.withColumns({f"end_{a}": F.coalesce(number_or_null(raw, f"end_{a}"), F.col(f"start_{a}")) for a in "xy"})
    return out.dropna(subset=["start_x", "start_y"])


def in_match(tie: list[str]) -> W:
    return W.partitionBy("match_id").orderBy("period_id", "time_seconds", *tie)


def with_score(actions: DataFrame, tie: list[str]) -> DataFrame:
    """action_id, opponent, who scored, and the score before the action from the actor's side."""
    w = in_match(tie)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    home = F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False))
    goal = F.coalesce(F.col("type_name").isin(SHOTS) & (F.col("result_name") == "success"), F.lit(False))
    out = actions.withColumns(
        {
            "action_id": F.row_number().over(w) - 1,
            "opp_team_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")),
            "scoring_team_id": F.when(goal, F.col("team_id")),
        }
    )
    side = lambda c: F.coalesce(F.sum(F.coalesce(F.col("scoring_team_id") == F.col(c), F.lit(False)).cast("int")).over(before), F.lit(0))
    out = out.withColumns({"__h": side("home_team_id"), "__a": side("away_team_id")})
    out = out.withColumns({"team_goals_before": F.when(home, F.col("__h")).otherwise(F.col("__a")), "opp_goals_before": F.when(home, F.col("__a")).otherwise(F.col("__h"))})
    return out.withColumn("goal_diff_before", F.col("team_goals_before") - F.col("opp_goals_before")).drop("__h", "__a")


def with_labels(actions: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """scores and concedes: whether this team, or its opponent, scores within this and the next horizon - 1 actions."""
    ahead = W.partitionBy("match_id").orderBy("action_id").rowsBetween(0, horizon - 1)
    seen = F.collect_set("scoring_team_id").over(ahead)
    holds = lambda c: F.coalesce(F.array_contains(seen, F.col(c)), F.lit(False))
    return actions.withColumns({"scores": holds("team_id"), "concedes": holds("opp_team_id")})


def with_values(actions: DataFrame, p_scores: str = "p_scores", p_concedes: str = "p_concedes") -> DataFrame:
    """offensive, defensive and whole value: the change of both chances since the action before.

    The chances swap when the ball changes sides; after a goal and at restarts they begin at 0."""
    w = W.partitionBy("match_id").orderBy("action_id")
    lag = lambda c: F.lag(c).over(w)
    team = F.coalesce("team_id", F.lit(""))
    out = actions.withColumn("__team", team)
    same = F.coalesce(lag("__team"), F.lit("")) == F.col("__team")
    fresh = F.coalesce(lag(F.col("scoring_team_id").isNotNull()), F.lit(False)) | F.coalesce(F.col("type_name").isin(RESTARTS), F.lit(False))
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            "__s": F.when(fresh, zero).otherwise(F.coalesce(F.when(same, lag(p_scores)).otherwise(lag(p_concedes)), zero)),
            "__c": F.when(fresh, zero).otherwise(F.coalesce(F.when(same, lag(p_concedes)).otherwise(lag(p_scores)), zero)),
        }
    )
    out = out.withColumns({"offensive_value": F.col(p_scores) - F.col("__s"), "defensive_value": -(F.col(p_concedes) - F.col("__c"))})
    return out.withColumn("vaep_value", F.col("offensive_value") + F.col("defensive_value")).drop("__s", "__c", "__team")


def phase_of(kind: Column) -> Column:
    out = F.lit("other")
    for phase, kinds in PHASES.items():
        out = F.when(kind.isin(kinds), phase).otherwise(out)
    return out


def player_ratings(valued: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Values by player, whole and by phase, in one aggregation; players without an id keep their row, without phases."""
    phase = phase_of(F.col("type_name"))
    goal = F.coalesce(F.col("type_name").isin(SHOTS) & (F.col("result_name") == "success"), F.lit(False))
    known = F.col("player_id").isNotNull()
    order = F.struct("match_id", "action_id")
    out = valued.groupBy("player_id").agg(
        F.min_by("team_id", F.when(F.col("team_id").isNotNull(), order)).alias("team_id"),
        F.countDistinct("match_id").alias("matches"),
        F.count(F.lit(1)).alias("actions"),
        *[F.sum(c).alias(n) for c, n in (("vaep_value", "vaep"), ("offensive_value", "offensive"), ("defensive_value", "defensive"))],
        F.count_if(goal).alias("goals"),
        *[F.sum(F.when(known, F.when(phase == p, F.col("vaep_value")).otherwise(0.0))).alias(f"vaep_{p}") for p in [*PHASES, "other"]],
    )
    out = out.withColumn("vaep_per_action", ratio(F.col("vaep"), F.col("actions")))
    if directory is None:
        return out.withColumn("player_name", F.col("player_id"))
    first = directory.groupBy("player_id").agg(F.min("player_name").alias("player_name"))
    return out.join(first, "player_id", "left").withColumn("player_name", F.coalesce("player_name", "player_id"))


def with_state_features(actions: DataFrame, states: int = STATES, keep: list[str] = []) -> DataFrame:
    """match_id, action_id, the columns keep and the features of this action and of those before it, seen from the actor's side.

    A missing earlier value takes the present one. Nothing is null or infinite."""
    w = W.partitionBy("match_id").orderBy("action_id")
    away = F.coalesce(F.col("team_id") != F.col("home_team_id"), F.lit(False))
    flip = F.when(away, F.lit(-1.0)).otherwise(F.lit(1.0))
    base = ["start_x", "start_y", "end_x", "end_y", "time_seconds", "type_name", "result_name", "bodypart_name"]
    back = actions.withColumn("__flip", flip).withColumns(
        {f"__{c}_{s}": (F.coalesce(F.lag(c, s).over(w), F.col(c)) if s else F.col(c)) for c in base for s in range(states)}
    )
    own: dict[str, Column] = {}
    for s in range(states):
        sx, sy, ex, ey = (F.col(f"__{c}_{s}") * F.col("__flip") for c in base[:4])
        own |= {f"start_x_a{s}": sx, f"start_y_a{s}": sy, f"end_x_a{s}": ex, f"end_y_a{s}": ey}
        for side, x, y in (("start", sx, sy), ("end", ex, ey)):
            own |= {f"{side}_dist_goal_a{s}": F.hypot(GOAL_X - x, y), f"{side}_angle_goal_a{s}": F.atan2(F.abs(y), F.abs(GOAL_X - x))}
        own |= {f"dx_a{s}": ex - sx, f"dy_a{s}": ey - sy, f"movement_a{s}": F.hypot(ex - sx, ey - sy)}
        for column, names, prefix in (("type_name", KINDS, "type"), ("result_name", RESULTS, "result"), ("bodypart_name", BODY_PARTS, "bodypart")):
            own |= {f"{prefix}_{v.replace('/', '_').replace(' ', '_')}_a{s}": F.coalesce(F.col(f"__{column}_{s}") == v, F.lit(False)).cast("double") for v in names}
    own |= {f"{c}_a0": F.col(c).cast("double") for c in ("period_id", "time_seconds")}
    own |= {c: F.col(c).cast("double") for c in ("team_goals_before", "opp_goals_before", "goal_diff_before")}
    for s in range(1, states):
        dx = (F.col("__start_x_0") - F.col(f"__end_x_{s}")) * F.col("__flip")
        dy = (F.col("__start_y_0") - F.col(f"__end_y_{s}")) * F.col("__flip")
        own |= {f"time_delta_a0a{s}": F.col("__time_seconds_0") - F.col(f"__time_seconds_{s}"), f"space_dx_a0a{s}": dx, f"space_dy_a0a{s}": dy, f"space_dist_a0a{s}": F.hypot(dx, dy)}
    return back.select("match_id", "action_id", *keep, *[F.coalesce(c, F.lit(0.0)).cast("float").alias(n) for n, c in own.items()])
