"""On-ball actions from possessions: one scan makes passes, carries and shots; joins that attach what other tables know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import first_number, flag, flag_or_default, has, identity, number, number_or_null
from pitchframe.functions.pitch import LENGTH, WIDTH, in_pitch, rescaled

CARRY_LEAST = 1.0
# Starts that aren't open play for this table.
SET_PIECES = [
    "corner", "corner_crossed", "corner_short", "free_kick", "free_kick_crossed", "free_kick_short",
    "goal_kick", "throw_in", "kick_off", "penalty",
]
MOVES = ["pass", "carry"]
X_COLUMNS = ["x_start", "x_end", "player_targeted_x_pass", "player_targeted_x_reception"]
Y_COLUMNS = ["y_start", "y_end", "player_targeted_y_pass", "player_targeted_y_reception"]
PASS_ONLY = ["target_threat", "target_dangerous", "xpass_completion", "provider_pass_outcome"]
FIRST = [
    "event_id", "parent_pp_id", "match_id", "season_name", "period", "time_start", "time_end", "frame_event", "frame_start",
    "frame_end", "team_id", "team_shortname", "player_id", "player_name", "player_position", "action_type",
    "source_action_type", "start_x", "start_y", "end_x", "end_y", "move_success", "goal", "outcome_flag", *PASS_ONLY,
    "team_in_possession_phase_type", "start_type", "end_type", "is_open_play", "distance_covered", "trajectory_angle", "is_header",
]


def home_or_away(team: Column, home: Column, away: Column) -> Column:
    """By equal ids as text; null if neither."""
    team = team.cast("string")
    return F.when(team == home.cast("string"), "home").when(team == away.cast("string"), "away")


def opponent_of(side: Column) -> Column:
    return F.when(side == "home", "away").when(side == "away", "home")


def on_common_pitch(events: DataFrame, length: Column, width: Column) -> DataFrame:
    """All coordinates on the common pitch; what the feed said stays as source_*."""
    out = {}
    for names, source, target in ((X_COLUMNS, length, LENGTH), (Y_COLUMNS, width, WIDTH)):
        for name in names:
            if has(events, name):
                out[f"source_{name}"] = number(name)
                out[name] = rescaled(number(name), source, target)
    return events.withColumns(out)


def with_match(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events with the constants of their match (matches: one row a match, small) and home_away."""
    new = [c for c in matches.columns if c == "match_id" or c not in events.columns]
    out = events.withColumn("match_id", identity("match_id")).join(
        matches.withColumn("match_id", identity("match_id")).select(*new).dropDuplicates(["match_id"]), "match_id", "left"
    )
    if has(out, "team_id") and has(out, "home_team_id"):
        side = home_or_away(F.col("team_id"), F.col("home_team_id"), F.col("away_team_id"))
        out = out.withColumn("home_away", side).withColumn("opponent_home_away", opponent_of(F.col("home_away")))
    start = F.col("start_type").cast("string") if has(out, "start_type") else F.lit(None).cast("string")
    return out.withColumn("is_open_play", F.coalesce(~start.isin(SET_PIECES), F.lit(True)))


def from_possessions(events: DataFrame, open_play_only: bool = True, carry_least: float = CARRY_LEAST) -> DataFrame:
    """A row for each pass, carry and shot of the player possessions, in one pass over the events."""
    own = events.filter(F.col("event_type").cast("string") == "player_possession")
    if open_play_only and has(own, "is_open_play"):
        own = own.filter(F.coalesce("is_open_play", F.lit(False)))
    x0, y0, x1, y1 = (number_or_null(own, c) for c in ("x_start", "y_start", "x_end", "y_end"))
    null, no, yes = F.lit(None).cast("double"), F.lit(False), F.lit(True)
    won = F.coalesce(F.col("pass_outcome").cast("string") == "successful", no) if has(own, "pass_outcome") else no
    if has(own, "game_interruption_after"):
        scored = F.coalesce(F.col("game_interruption_after").cast("string") == "goal_for", no)
    else:
        scored = flag_or_default(own, "lead_to_goal")
    text = lambda c: F.col(c).cast("string") if has(own, c) else F.lit(None).cast("string")

    def row(kind: str, sx, sy, ex, ey, success, goal, actual, is_pass: bool) -> Column:
        own_number = lambda c: first_number(own, [c]) if is_pass else null
        own_text = lambda c: text(c) if is_pass else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("action_type"), sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"),
            success.alias("outcome_flag"), success.alias("move_success"), goal.alias("goal"), actual.alias("shot_goal_actual"),
            own_number("player_targeted_xthreat").alias(PASS_ONLY[0]), own_text("player_targeted_dangerous").alias(PASS_ONLY[1]),
            own_number("player_targeted_xpass_completion").alias(PASS_ONLY[2]), own_text("pass_outcome").alias(PASS_ONLY[3]),
        )

    end = F.col("end_type").cast("string")
    carried = F.coalesce(flag_or_default(own, "carry") | (F.hypot(x1 - x0, y1 - y0) >= carry_least), flag_or_default(own, "carry"))
    to_x = first_number(own, ["player_targeted_x_reception", "player_targeted_x_pass", "x_end"])
    to_y = first_number(own, ["player_targeted_y_reception", "player_targeted_y_pass", "y_end"])
    unknown = F.lit(None).cast("boolean")
    made = F.array_compact(
        F.array(
            F.when(carried, row("carry", x0, y0, x1, y1, yes, no, unknown, False)),
            F.when(end == "pass", row("pass", x1, y1, to_x, to_y, won, no, unknown, True)),
            F.when(end == "shot", row("shot", x1, y1, x1, y1, no, scored, scored, False)),
        )
    )
    rest = [c for c in own.columns if c not in ("event_id", "carry", "goal")]
    out = own.select(F.col("event_id").cast("string").alias("parent_pp_id"), *rest, F.explode(made).alias("__a"))
    return out.select(
        F.concat_ws(":", "parent_pp_id", "__a.action_type").alias("event_id"),
        "parent_pp_id",
        *rest,
        F.col("__a.action_type").alias("source_action_type"),
        "__a.*",
    )


def prepared(actions: DataFrame, open_play_only: bool = False, in_pitch_only: bool = True, drive_is_carry: bool = True) -> DataFrame:
    """The action table in its canonical form: four kinds, success only of moves, goals only of shots, places on the pitch."""
    out = actions
    if open_play_only and has(out, "is_open_play"):
        out = out.filter(F.coalesce("is_open_play", F.lit(False)))
    out = out.filter(F.col("action_type").isin("pass", "drive", "carry", "shot"))
    for old, new in (("x_origin", "start_x"), ("y_origin", "start_y"), ("x_dest", "end_x"), ("y_dest", "end_y")):
        if has(out, old):
            out = out.withColumnRenamed(old, new)
    kind = F.col("action_type").cast("string")
    given = kind
    if drive_is_carry:
        kind = F.when(kind == "drive", "carry").otherwise(kind)
    out = out.withColumns({"source_action_type": given, "__kind": kind})
    is_pass, is_shot, is_move = F.col("__kind") == "pass", F.col("__kind") == "shot", F.col("__kind").isin(MOVES)
    fallback = flag(F.col("shot_goal")) if has(out, "shot_goal") else F.lit(False)
    actual = F.coalesce(F.col("shot_goal_actual").cast("boolean"), fallback) if has(out, "shot_goal_actual") else fallback
    columns = {c: number_or_null(out, c) for c in ("start_x", "start_y", "end_x", "end_y")}
    columns |= {c: F.when(is_pass, F.col(c)) for c in PASS_ONLY if has(out, c)}
    if has(out, "shot_goal_actual"):
        columns["shot_goal_actual"] = F.when(is_shot, F.col("shot_goal_actual"))
    columns |= {"move_success": is_move & F.coalesce(F.col("outcome_flag").cast("boolean"), F.lit(False)), "goal": is_shot & actual}
    out = out.withColumns(columns).drop("action_type").withColumnRenamed("__kind", "action_type")
    start = in_pitch(F.col("start_x"), F.col("start_y"))
    is_move = F.col("action_type").isin(MOVES)
    keep = (is_move & start & in_pitch(F.col("end_x"), F.col("end_y"))) if in_pitch_only else is_move
    out = out.filter(((F.col("action_type") == "shot") & start) | keep)
    return out.select(*[c for c in FIRST if has(out, c)], *[c for c in out.columns if c not in FIRST])


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a stated order (a plain drop of duplicates keeps any)."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", first).filter("__n = 1").drop("__n")


def with_metadata(actions: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Left join of match metadata; earlier sources win, and columns they have replace those of actions."""
    names = list(dict.fromkeys(c for s in sources for c in s.columns))
    parts = [
        s.select(identity("match_id").alias("match_id"), F.lit(k).alias("__p"), *[(F.col(c) if has(s, c) else F.lit(None)).alias(c) for c in names if c != "match_id"])
        for k, s in enumerate(sources)
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    meta = one_of_each(both, ["match_id"], [F.col("__p"), *[F.col(c) for c in names if c != "match_id"]]).drop("__p")
    kept = [c for c in actions.columns if c == "match_id" or c not in names]
    return actions.select(*kept).withColumn("match_id", identity("match_id")).join(meta, "match_id", "left")


def with_reference(actions: DataFrame, reference: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Left join on (match_id, parent_pp_id) of columns of a pass or shot table, its first row a key."""
    own = {old: new for old, new in renamed.items() if has(reference, old)}
    right = reference.select(
        identity("match_id").alias("match_id"), identity("event_id").alias("parent_pp_id"), *[F.col(o).alias(n) for o, n in own.items()]
    )
    right = one_of_each(right, ["match_id", "parent_pp_id"], [F.col(n).asc_nulls_last() for n in own.values()])
    left = actions.drop(*own.values()).withColumns({c: identity(c) for c in ("match_id", "parent_pp_id")})
    return left.join(right, ["match_id", "parent_pp_id"], "left")


def with_provider_threat(actions: DataFrame, passes: DataFrame) -> DataFrame:
    return with_reference(
        actions, passes,
        {"player_targeted_xthreat": PASS_ONLY[0], "player_targeted_dangerous": PASS_ONLY[1],
         "player_targeted_xpass_completion": PASS_ONLY[2], "pass_outcome": PASS_ONLY[3]},
    )


def with_actual_goals(actions: DataFrame, shots: DataFrame) -> DataFrame:
    return with_reference(actions, shots, {"goal": "shot_goal_actual"})


def table_stats(actions: DataFrame) -> DataFrame:
    """One row of counters of an action table."""
    kind = F.col("action_type")
    known = lambda c: F.count(F.col(c)) if has(actions, c) else F.lit(0).cast("long")
    return actions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.col("match_id").cast("string")).alias("n_matches"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("pass", "carry", "shot")],
        F.count_if(kind.isin(MOVES) & F.col("move_success")).alias("n_successful_moves"),
        F.count_if(F.col("goal")).alias("n_goals"),
        known(PASS_ONLY[0]).alias("n_passes_with_provider_threat"),
        known("shot_goal_actual").alias("n_shots_with_actual_goal"),
    )
