"""Queries of action values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.operators import models as M
from pitchframe.operators import value_chain as V
from pitchframe.plans.surrogates import Registry, actions

registry = Registry()
query = registry.add
ORDERED = """o AS (SELECT *, row_number() OVER w - 1 AS action_id, CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opp_team_id,
CASE WHEN type_name = 'shot' AND result_name = 'success' THEN team_id END AS scoring_team_id FROM actions WINDOW w AS (PARTITION BY match_id ORDER BY period_id, time_seconds, event_id)),
h AS (SELECT *, coalesce(count(*) FILTER (scoring_team_id = home_team_id) OVER w, 0) AS hg, coalesce(count(*) FILTER (scoring_team_id = away_team_id) OVER w, 0) AS ag
FROM o WINDOW w AS (PARTITION BY match_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN team_id = home_team_id THEN hg ELSE ag END AS team_goals_before, CASE WHEN team_id = home_team_id THEN ag ELSE hg END AS opp_goals_before FROM h)"""


def scored(spark, sf_dir):
    return V.with_score(actions(spark, sf_dir), ["event_id"])


@query("score_before_action", "event_id action_id opp_team_id scoring_team_id team_goals_before opp_goals_before goal_diff_before", "", "actions", ORDERED,
       "(SELECT *, team_goals_before - opp_goals_before AS goal_diff_before FROM s)")
def score_before_action(spark, sf_dir):
    return scored(spark, sf_dir)


AHEAD = ORDERED + """,
l AS (SELECT *, list(scoring_team_id) OVER (PARTITION BY match_id ORDER BY action_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS nxt FROM s)"""


@query("value_labels", "event_id scores concedes", "", "actions", AHEAD,
       "(SELECT event_id, coalesce(list_contains(nxt, team_id), false) AS scores, coalesce(list_contains(nxt, opp_team_id), false) AS concedes FROM l)")
def value_labels(spark, sf_dir):
    return V.with_labels(scored(spark, sf_dir))


VALUED = ORDERED + """,
g AS (SELECT *, lag(team_id) OVER w AS lt, lag(p_scores) OVER w AS ls, lag(p_concedes) OVER w AS lc, lag(scoring_team_id IS NOT NULL) OVER w AS lg
FROM s WINDOW w AS (PARTITION BY match_id ORDER BY action_id)),
b AS (SELECT *, CASE WHEN coalesce(lg, false) OR type_name = 'throw_in' THEN 0 WHEN lt = team_id THEN coalesce(ls, 0) ELSE coalesce(lc, 0) END AS bs,
CASE WHEN coalesce(lg, false) OR type_name = 'throw_in' THEN 0 WHEN lt = team_id THEN coalesce(lc, 0) ELSE coalesce(ls, 0) END AS bc FROM g),
v AS (SELECT *, p_scores - bs AS offensive_value, -(p_concedes - bc) AS defensive_value, p_scores - bs - (p_concedes - bc) AS vaep_value FROM b)"""


@query("action_values", "event_id", "offensive_value defensive_value vaep_value", "actions", VALUED, "v")
def action_values(spark, sf_dir):
    return V.with_values(scored(spark, sf_dir))


@query("player_ratings", "player_id team_id matches actions goals player_name", "vaep offensive defensive vaep_per_action vaep_pass vaep_carry vaep_shot vaep_defend vaep_other", "actions", VALUED,
       """(SELECT player_id, arg_min(team_id, action_id) AS team_id, count(DISTINCT match_id) AS matches, count(*) AS actions, count(scoring_team_id) AS goals, 'name of ' || player_id AS player_name,
       sum(vaep_value) AS vaep, sum(offensive_value) AS offensive, sum(defensive_value) AS defensive, avg(vaep_value) AS vaep_per_action,
       coalesce(sum(vaep_value) FILTER (type_name IN ('pass', 'throw_in')), 0) AS vaep_pass, coalesce(sum(vaep_value) FILTER (type_name = 'dribble'), 0) AS vaep_carry,
       coalesce(sum(vaep_value) FILTER (type_name = 'shot'), 0) AS vaep_shot, coalesce(sum(vaep_value) FILTER (type_name = 'tackle'), 0) AS vaep_defend, 0e0 AS vaep_other FROM v GROUP BY player_id)""")  # fmt: skip
def player_ratings(spark, sf_dir):
    own = V.with_values(scored(spark, sf_dir))
    directory = own.select("player_id", F.concat(F.lit("name of "), "player_id").alias("player_name"))
    return V.player_ratings(own, directory)


@query("state_features", "match_id action_id", "start_x_a0 end_x_a1 start_y_a2 start_dist_goal_a0 end_angle_goal_a1 movement_a0 type_pass_a0 type_shot_a2 result_success_a1 bodypart_head_a0 time_delta_a0a1 space_dist_a0a2 goal_diff_before", "actions", ORDERED + """,
       f AS (SELECT *, CASE WHEN team_id <> home_team_id THEN -1e0 ELSE 1e0 END AS fl, coalesce(lag(end_x, 1) OVER w, end_x) AS ex1, coalesce(lag(end_y, 1) OVER w, end_y) AS ey1,
       coalesce(lag(end_x, 2) OVER w, end_x) AS ex2, coalesce(lag(end_y, 2) OVER w, end_y) AS ey2, coalesce(lag(start_y, 2) OVER w, start_y) AS sy2, coalesce(lag(type_name, 2) OVER w, type_name) AS t2,
       coalesce(lag(result_name, 1) OVER w, result_name) AS r1, coalesce(lag(time_seconds, 1) OVER w, time_seconds) AS tm1 FROM s WINDOW w AS (PARTITION BY match_id ORDER BY action_id)),
       q AS (SELECT match_id, action_id, coalesce(start_x * fl, 0) AS start_x_a0, coalesce(ex1 * fl, 0) AS end_x_a1, coalesce(sy2 * fl, 0) AS start_y_a2,
       coalesce(sqrt((52.5e0 - start_x * fl) ** 2 + start_y ** 2), 0) AS start_dist_goal_a0, coalesce(atan2(abs(ey1), abs(52.5e0 - ex1 * fl)), 0) AS end_angle_goal_a1,
       coalesce(sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2), 0) AS movement_a0, (type_name = 'pass')::INT AS type_pass_a0, (t2 = 'shot')::INT AS type_shot_a2,
       (r1 = 'success')::INT AS result_success_a1, (bodypart_name = 'head')::INT AS bodypart_head_a0, time_seconds - tm1 AS time_delta_a0a1,
       coalesce(sqrt((start_x - ex2) ** 2 + (start_y - ey2) ** 2), 0) AS space_dist_a0a2, team_goals_before - opp_goals_before AS goal_diff_before FROM f)""",
       "(SELECT match_id, action_id, " + ", ".join(f"round({c}::FLOAT::DOUBLE, 3) AS {c}" for c in "start_x_a0 end_x_a1 start_y_a2 start_dist_goal_a0 end_angle_goal_a1 movement_a0 type_pass_a0 type_shot_a2 result_success_a1 bodypart_head_a0 time_delta_a0a1 space_dist_a0a2 goal_diff_before".split()) + " FROM q)")
def state_features(spark, sf_dir):
    out = V.with_state_features(scored(spark, sf_dir))
    return out.select("match_id", "action_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in out.columns[2:]])


@query("canonical_actions", "match_id team_id period_id type_name bodypart_name", "time_seconds start_x start_y end_x end_y", "actions",
       """k AS (SELECT *, CASE period_id WHEN 1 THEN 'first' ELSE 'other' END AS p FROM actions)""",
       """(SELECT match_id, team_id, CASE p WHEN 'first' THEN 1 ELSE 0 END::BIGINT AS period_id, type_name, bodypart_name, time_seconds, start_x, start_y,
       coalesce(end_x, start_x) AS end_x, coalesce(end_y, start_y) AS end_y FROM k WHERE start_x IS NOT NULL AND type_name <> 'tackle')""")  # fmt: skip
def canonical_actions(spark, sf_dir):
    raw = actions(spark, sf_dir).withColumns(
        {"period_id": F.when(F.col("period_id") == 1, "first").otherwise("other"), "type_name": F.when(F.col("type_name") != "tackle", F.col("type_name")), "match_id": F.concat(F.lit(" "), "match_id")}
    )
    return V.canonical(raw, {"first": 1, "second": 2})


@query("value_model_two_heads", "split", "rows_n scores_rate p_scores_mean p_concedes_mean")
def value_model_two_heads(spark, sf_dir):
    own = V.with_labels(scored(spark, sf_dir))
    labelled = M.last_matches_split(V.with_state_features(own, states=2, keep=["scores", "concedes"]), 2)
    _, out = M.two_heads_of(labelled, ["match_id", "action_id"])
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows_n"), F.avg(F.col("scores").cast("double")).alias("scores_rate"), F.avg("p_scores").alias("p_scores_mean"), F.avg("p_concedes").alias("p_concedes_mean")
    )
