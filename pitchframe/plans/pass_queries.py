"""Queries of shots and passes: features, types, summaries, scores and models, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitchframe.functions import stats as S
from pitchframe.operators import models as M
from pitchframe.operators import report as R
from pitchframe.operators import shots_passes as P
from pitchframe.operators.newton_trees import TreesConfig
from pitchframe.operators.newton_trees import fitted as newton_fitted
from pitchframe.plans.surrogates import Registry, passes, shots

registry = Registry()
query = registry.add

SHOT_FEATURES = """f AS (SELECT *, abs(shot_y) AS ay, sqrt((52.5e0 - shot_x) ** 2 + shot_y ** 2) AS d,
((52.5e0 - shot_x) ** 2 + (3.66e0 - shot_y) * (-3.66e0 - shot_y)) / nullif(sqrt((52.5e0 - shot_x) ** 2 + (3.66e0 - shot_y) ** 2) * sqrt((52.5e0 - shot_x) ** 2 + (-3.66e0 - shot_y) ** 2), 0) AS co FROM shots),
a AS (SELECT *, acos(greatest(least(co, 1), -1)) AS ang FROM f)"""


@query("shot_features", "event_id in_box in_six_yard_box central_shot wide_shot very_close_shot long_shot is_header is_corner_start is_set_piece_start goal", "abs_shot_y distance_to_goal distance_to_goal_sq shot_angle shot_angle_deg shot_angle_sin shot_angle_cos possession_distance_to_shot", "shots", SHOT_FEATURES,
       """(SELECT event_id, shot_x >= 36 AND ay <= 20.16 AS in_box, shot_x >= 47 AND ay <= 9.16 AS in_six_yard_box, ay <= 8.5 AS central_shot, ay >= 20.16 AS wide_shot, d <= 8 AS very_close_shot, d >= 25 AS long_shot,
       is_header = 'True' AS is_header, start_type = 'corner_reception' AS is_corner_start, start_type <> 'pass_reception' AS is_set_piece_start, goal, ay AS abs_shot_y, d AS distance_to_goal, d * d AS distance_to_goal_sq, ang AS shot_angle,
       degrees(ang) AS shot_angle_deg, sin(ang) AS shot_angle_sin, cos(ang) AS shot_angle_cos, sqrt((shot_x - possession_start_x) ** 2 + (shot_y - possession_start_y) ** 2) AS possession_distance_to_shot FROM a)""")  # fmt: skip
def shot_features(spark, sf_dir):
    return P.with_shot_features(P.with_set_piece_flags(shots(spark, sf_dir)))


PASS_FEATURES = """f AS (SELECT *, sqrt((target_x - passer_x) ** 2 + (target_y - passer_y) ** 2) AS d, target_x - passer_x AS pr, abs(target_y - passer_y) AS la,
sqrt((52.5e0 - passer_x) ** 2 + passer_y ** 2) AS pg, sqrt((52.5e0 - target_x) ** 2 + target_y ** 2) AS tg FROM passes)"""


@query("pass_features", "event_id is_short_pass is_medium_pass is_long_pass high_pass is_throw_in_start", "passer_distance_to_goal target_distance_to_goal pass_distance_feature pass_progression target_goal_distance_gain pass_lateral_distance pass_angle_model_deg pass_angle_sin passer_distance_to_sideline possession_start_to_pass_distance", "passes", PASS_FEATURES,
       """(SELECT event_id, coalesce(d < 10, false) AS is_short_pass, coalesce(d BETWEEN 10 AND 30, false) AS is_medium_pass, coalesce(d > 30, false) AS is_long_pass, high_pass = '1' AS high_pass, start_type = 'throw_in_interception' AS is_throw_in_start,
       pg AS passer_distance_to_goal, tg AS target_distance_to_goal, d AS pass_distance_feature, pr AS pass_progression, pg - tg AS target_goal_distance_gain, la AS pass_lateral_distance, degrees(atan2(la, pr)) AS pass_angle_model_deg, sin(atan2(la, pr)) AS pass_angle_sin,
       34 - abs(passer_y) AS passer_distance_to_sideline, sqrt((passer_x - possession_start_x) ** 2 + (passer_y - possession_start_y) ** 2) AS possession_start_to_pass_distance FROM f)""")  # fmt: skip
def pass_features(spark, sf_dir):
    return P.with_pass_features(P.with_set_piece_flags(passes(spark, sf_dir)))


@query("modelled_passes", "pass_outcome n", "", "passes", "", "(SELECT pass_outcome, count(*) AS n FROM passes WHERE pass_outcome IN ('successful', 'unsuccessful') GROUP BY 1)")
def modelled_passes(spark, sf_dir):
    return P.modelled_passes(passes(spark, sf_dir)).groupBy("pass_outcome").agg(F.count(F.lit(1)).alias("n"))


TYPED = PASS_FEATURES + """,
b AS (SELECT *, coalesce(abs(passer_y) >= 23, false) AS wf, coalesce(abs(target_y) >= 23, false) AS wt, last_line_break = 'TRUE' AS lb, first_line_break = 'yes' AS fb, high_pass = '1' AS hp FROM f),
s0 AS (SELECT *, coalesce(d >= 28 AND la >= 22 AND (passer_y * target_y < -80 OR (wf AND wt)), false) AS sw FROM b),
k AS (SELECT *, CASE
WHEN coalesce(target_x >= 36 AND abs(target_y) <= 20.16, false) THEN 'Box entry pass'
WHEN lb OR coalesce(player_targeted_third_pass = 'attacking_third' AND target_x >= 28 AND pr >= 10 AND d <= 35, false) THEN 'Penetrative pass'
WHEN sw THEN 'Switch of play'
WHEN coalesce(d >= 30, false) OR pass_range = 'long' OR (hp AND coalesce(d >= 25, false)) THEN 'Long pass'
WHEN coalesce(wt AND la >= 8 AND pr >= -5 AND NOT sw, false) THEN 'Wide progression pass'
WHEN pass_direction = 'forward' OR coalesce(pr >= 8, false) OR fb THEN 'Progressive pass'
WHEN coalesce(third_start = 'defensive_third' AND target_x <= 5, false) OR coalesce(passer_x <= -10 AND d <= 30, false)
  OR coalesce(player_position IN ('CB', 'LB') AND passer_x <= 5 AND d <= 35, false) THEN 'Build-up pass'
WHEN (coalesce(d <= 15, false) OR pass_range = 'short') AND (coalesce(abs(pr) <= 7, false) OR pass_direction LIKE '%sideway%') THEN 'Short lateral pass'
WHEN passer_x <= -10 THEN 'Build-up pass'
ELSE 'Short lateral pass' END AS pass_cluster FROM s0)"""


def typed(spark, sf_dir):
    return P.with_pass_type(passes(spark, sf_dir).withColumns({"pass_distance_feature": F.hypot(F.col("target_x") - F.col("passer_x"), F.col("target_y") - F.col("passer_y")), "pass_progression": F.col("target_x") - F.col("passer_x")}))


@query("pass_types", "event_id pass_cluster", "", "passes", TYPED, "k")
def pass_types(spark, sf_dir):
    return typed(spark, sf_dir)


PASS_SUMS = """count(*) AS passes, sum(pass_completed::INT) AS completed, sum(model_xpass) AS expected_completed, avg(model_xpass) AS avg_xpass,
sum(pass_completed::INT - model_xpass) AS pax, sum(pass_completed::INT - model_xpass) / count(*) * 100 AS pax_per_100"""


@query("pax_summary", "team_shortname player_position passes", "completed expected_completed avg_xpass pax pax_per_100 completion_rate avg_pass_distance", "passes", PASS_FEATURES + """,
       m AS (SELECT team_shortname, player_position, row_number() OVER (PARTITION BY team_shortname ORDER BY count(*) DESC, player_position) AS i FROM f WHERE model_xpass IS NOT NULL GROUP BY 1, 2 QUALIFY i = 1)""",
       f"""(SELECT team_shortname, any_value(m.player_position) AS player_position, {PASS_SUMS}, sum(pass_completed::INT) / count(*) AS completion_rate, avg(d) AS avg_pass_distance
       FROM f JOIN m USING (team_shortname) WHERE model_xpass IS NOT NULL GROUP BY 1)""")  # fmt: skip
def pax_summary(spark, sf_dir):
    return P.pax_summary(typed(spark, sf_dir), ["team_shortname"])


@query("pass_type_summary", "pass_cluster place passes", "completed expected_completed avg_xpass pax pax_per_100 share", "passes", TYPED + """,
       o AS (SELECT unnest(['Short lateral pass', 'Build-up pass', 'Progressive pass', 'Wide progression pass', 'Switch of play', 'Box entry pass', 'Penetrative pass', 'Long pass']) AS pass_cluster, unnest(range(8)) AS place),
       z AS (SELECT pass_cluster, """ + PASS_SUMS + " FROM k WHERE model_xpass IS NOT NULL GROUP BY 1)",
       """(SELECT pass_cluster, place, coalesce(passes, 0) AS passes, completed, expected_completed, avg_xpass, pax, pax_per_100, coalesce(passes, 0) / sum(coalesce(passes, 0)) OVER () AS share FROM o LEFT JOIN z USING (pass_cluster))""")  # fmt: skip
def pass_type_summary(spark, sf_dir):
    return P.cluster_summary(typed(spark, sf_dir))


@query("player_pass_profile", "player_name passes n_short n_long primary_cluster", "share_long pax pax_per_100", "passes", TYPED + """,
       n AS (SELECT player_name, pass_cluster, count(*) AS c FROM k WHERE model_xpass IS NOT NULL GROUP BY 1, 2),
       o AS (SELECT unnest(['Short lateral pass', 'Build-up pass', 'Progressive pass', 'Wide progression pass', 'Switch of play', 'Box entry pass', 'Penetrative pass', 'Long pass']) AS pass_cluster, unnest(range(8)) AS place),
       p AS (SELECT player_name, pass_cluster AS primary_cluster FROM n JOIN o USING (pass_cluster) QUALIFY row_number() OVER (PARTITION BY player_name ORDER BY c DESC, place) = 1)""",
       f"""(SELECT player_name, any_value(primary_cluster) AS primary_cluster, count(*) FILTER (pass_cluster = 'Short lateral pass') AS n_short, count(*) FILTER (pass_cluster = 'Long pass') AS n_long,
       count(*) FILTER (pass_cluster = 'Long pass') / count(*) AS share_long, {PASS_SUMS} FROM k JOIN p USING (player_name) WHERE model_xpass IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)""")  # fmt: skip
def player_pass_profile(spark, sf_dir):
    out = P.player_profile(typed(spark, sf_dir), ["player_name"], least=5)
    return out.withColumnsRenamed({"Short lateral pass": "n_short", "Long pass": "n_long", "share_Long pass": "share_long"})


@query("two_pass_estimates", "team_shortname passes", "completed provider_expected model_expected provider_pax model_pax expected_difference pax_per_100_difference", "passes", "",
       """(SELECT team_shortname, count(*) AS passes, sum(pass_completed::INT) AS completed, sum(provider_xpass) AS provider_expected, sum(model_xpass) AS model_expected,
       sum(pass_completed::INT - provider_xpass) AS provider_pax, sum(pass_completed::INT - model_xpass) AS model_pax, sum(provider_xpass) - sum(model_xpass) AS expected_difference,
       (sum(model_xpass) - sum(provider_xpass)) / count(*) * 100 AS pax_per_100_difference FROM passes WHERE model_xpass IS NOT NULL AND provider_xpass IS NOT NULL GROUP BY 1)""")  # fmt: skip
def two_pass_estimates(spark, sf_dir):
    return P.two_estimates(passes(spark, sf_dir), ["team_shortname"])


@query("team_pass_type_ranks", "team_shortname pass_cluster passes rank", "share league_share over_index", "passes", TYPED + """,
       c AS (SELECT team_shortname, pass_cluster, count(*) AS passes FROM k GROUP BY 1, 2),
       w AS (SELECT *, passes / sum(passes) OVER (PARTITION BY team_shortname) AS share, sum(passes) OVER (PARTITION BY pass_cluster) / sum(passes) OVER () AS league_share FROM c),
       v AS (SELECT *, share / league_share AS over_index FROM w)""",
       "(SELECT *, row_number() OVER (PARTITION BY team_shortname ORDER BY over_index DESC, passes DESC, pass_cluster) AS rank FROM v QUALIFY rank <= 3)")
def team_pass_type_ranks(spark, sf_dir):
    return P.ranked_team_clusters(typed(spark, sf_dir), 3)


@query("season_pass_summary", "season_name passes with_provider", "completion_rate avg_provider", "passes", "",
       "(SELECT season_name, count(*) AS passes, count(provider_xpass) AS with_provider, avg(pass_completed::INT) AS completion_rate, avg(provider_xpass) AS avg_provider FROM passes GROUP BY 1)")
def season_pass_summary(spark, sf_dir):
    own = passes(spark, sf_dir)
    return own.groupBy("season_name").agg(F.count(F.lit(1)).alias("passes"), F.count("provider_xpass").alias("with_provider"), F.avg(F.col("pass_completed").cast("double")).alias("completion_rate"), F.avg("provider_xpass").alias("avg_provider"))


@query("final_third_entries", "event_id", "", "passes", "",
       """(SELECT event_id FROM passes WHERE (third_start <> 'attacking_third' AND player_targeted_third_pass = 'attacking_third') OR (passer_x < 17.5 AND target_x >= 17.5))""")  # fmt: skip
def final_third_entries(spark, sf_dir):
    return R.final_third_entries(passes(spark, sf_dir))


@query("top_and_bottom_players", "player_name group_name passes", "pax", "passes", f"z AS (SELECT player_name, {PASS_SUMS} FROM passes WHERE model_xpass IS NOT NULL GROUP BY 1), y AS (SELECT player_name, passes, round(pax, 6) AS pax FROM z)",
       """(SELECT *, 'top' AS group_name FROM (FROM y ORDER BY pax DESC, player_name LIMIT 5) UNION ALL SELECT *, 'bottom' FROM (FROM y ORDER BY pax, player_name LIMIT 5))""")  # fmt: skip
def top_and_bottom_players(spark, sf_dir):
    own = P.pax_summary(passes(spark, sf_dir), ["player_name"]).withColumn("pax", F.round("pax", 6))
    return R.top_and_bottom(own, "pax", 5, ["player_name"]).withColumnRenamed("group", "group_name")


@query("first_matches_of_season", "season_name match_id event_id", "", "passes", "k AS (SELECT *, row_number() OVER (PARTITION BY season_name ORDER BY match_id, event_id) AS i FROM passes)",
       "(SELECT season_name, match_id, event_id FROM k WHERE i <= 4 ORDER BY season_name, match_id, event_id LIMIT 10)")
def first_matches_of_season(spark, sf_dir):
    return P.first_of_each_season(passes(spark, sf_dir), 4, ["match_id", "event_id"], 10)


SCORES = """k AS (SELECT season_name, goal, model_xg, count(*) OVER (PARTITION BY season_name, model_xg) AS ties, rank() OVER (PARTITION BY season_name ORDER BY model_xg) AS rk FROM shots),
e AS (SELECT season_name, count(*) AS rows_n, sum(goal::INT) AS positives, sum(model_xg) AS expected, avg(goal::INT) AS base_rate,
CASE WHEN min(goal::INT) = 0 AND max(goal::INT) = 1 THEN avg(-CASE WHEN goal THEN ln(model_xg) ELSE ln(1 - model_xg) END) END AS log_loss, avg((model_xg - goal::INT) ** 2) AS brier,
(sum(CASE WHEN goal THEN rk + (ties - 1) / 2e0 END) - sum(goal::INT) * (sum(goal::INT) + 1) / 2e0) / nullif(sum(goal::INT) * (count(*) - sum(goal::INT)), 0) AS auc FROM k GROUP BY 1)"""


@query("estimate_scores", "season_name rows_n positives", "expected base_rate log_loss brier auc", "shots", SCORES, "(SELECT * REPLACE (positives::BIGINT AS positives) FROM e)")
def estimate_scores(spark, sf_dir):
    return S.binary_scores(shots(spark, sf_dir), "goal", "model_xg", ["season_name"]).withColumnRenamed("rows", "rows_n")


@query("calibration_bins", "bin rows_n", "mean_score observed least most", "shots", """
       q AS (SELECT list_distinct(quantile_cont(model_xg, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e0 FROM shots), e AS (SELECT list_sort(e0) AS e FROM q),
       k AS (SELECT shots.*, greatest(1, len(list_filter(e, lambda v: v < model_xg))) AS bin FROM shots, e)""",
       "(SELECT bin, count(*) AS rows_n, avg(model_xg) AS mean_score, avg(goal::INT) AS observed, min(model_xg) AS least, max(model_xg) AS most FROM k GROUP BY 1)")
def calibration_bins(spark, sf_dir):
    return S.calibration(shots(spark, sf_dir), "goal", "model_xg", 10).withColumnRenamed("rows", "rows_n")


@query("provider_deciles", "bin rows_n", "observed provider model", "passes", """
       b AS (SELECT * FROM passes WHERE model_xpass IS NOT NULL AND provider_xpass IS NOT NULL),
       e AS (SELECT list_sort(list_distinct(quantile_cont(provider_xpass, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM b),
       k AS (SELECT b.*, greatest(1, len(list_filter(e, lambda v: v < provider_xpass))) AS bin FROM b, e)""",
       "(SELECT bin, count(*) AS rows_n, avg(pass_completed::INT) AS observed, avg(provider_xpass) AS provider, avg(model_xpass) AS model FROM k GROUP BY 1)")
def provider_deciles(spark, sf_dir):
    return M.provider_deciles(passes(spark, sf_dir), "model_xpass", "provider_xpass", "pass_completed").withColumnRenamed("rows", "rows_n")


@query("season_split", "split n", "", "passes", "", "(SELECT CASE season_name WHEN 's0' THEN 'train' WHEN 's1' THEN 'test' ELSE 'unused' END AS split, count(*) AS n FROM passes GROUP BY 1)")
def season_split(spark, sf_dir):
    return M.season_split(passes(spark, sf_dir), ["s0"], ["s1"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("last_matches_split", "split match_id", "", "passes", "m AS (SELECT DISTINCT match_id FROM passes)",
       "(SELECT match_id, CASE WHEN row_number() OVER (ORDER BY match_id DESC) <= 3 THEN 'test' ELSE 'train' END AS split FROM m)")
def last_matches_split(spark, sf_dir):
    return M.last_matches_split(passes(spark, sf_dir), 3).select("match_id", "split").distinct()


@query("template_shot", "start_type is_header in_box", "shot_x shot_y distance_to_goal", "shots", SHOT_FEATURES + """,
       o AS (SELECT *, shot_x >= 36 AND ay <= 20.16 AS ib FROM a WHERE is_header <> 'True' AND start_type = 'pass_reception')""",
       """(SELECT 'pass_reception' AS start_type, false AS is_header, count(*) FILTER (ib) > count(*) / 2e0 AS in_box, quantile_cont(shot_x, 0.5) AS shot_x, quantile_cont(shot_y, 0.5) AS shot_y, quantile_cont(d, 0.5) AS distance_to_goal FROM o)""")  # fmt: skip
def template_shot(spark, sf_dir):
    return M.template_shot(P.with_set_piece_flags(shots(spark, sf_dir)))


def _shot_model(spark, sf_dir, name):
    own = P.with_shot_features(P.with_set_piece_flags(shots(spark, sf_dir)))
    split = M.season_split(own, ["s0", "s1"], ["s2"])
    numbers = ["shot_x", "abs_shot_y", "distance_to_goal", "shot_angle", "duration"]
    return M.train_and_score(split, numbers, ["is_header", "in_box", "is_set_piece_start"], ["start_type"], "goal", M.SHOT_MODELS[name], "xg")


@query("shot_model_logistic", "split rows_n positives", "expected log_loss brier auc")
def shot_model_logistic(spark, sf_dir):
    _, out = _shot_model(spark, sf_dir, "logistic")
    return M.evaluated(out, "goal", "xg").withColumnRenamed("rows", "rows_n")


@query("shot_model_trees", "split rows_n positives", "expected log_loss brier auc")
def shot_model_trees(spark, sf_dir):
    _, out = _shot_model(spark, sf_dir, "trees")
    return M.evaluated(out, "goal", "xg").withColumnRenamed("rows", "rows_n")


@query("shot_model_newton", "split rows_n positives", "expected log_loss brier auc")
def shot_model_newton(spark, sf_dir):
    own = P.with_shot_features(P.with_set_piece_flags(shots(spark, sf_dir)))
    split = M.season_split(own, ["s0", "s1"], ["s2"])
    numbers = ["shot_x", "abs_shot_y", "distance_to_goal", "shot_angle", "duration"]
    config = replace(M.shot_model("xgboost"), newton=replace(M.SHOT_TREES["depthwise"], rounds=40, rate=0.1, patience=5), valid_share=0.2)
    _, out = M.train_and_score(split, numbers, ["is_header", "in_box", "is_set_piece_start"], ["start_type"], "goal", config, "xg")
    return M.evaluated(out, "goal", "xg").withColumnRenamed("rows", "rows_n")


NEWTON_EDGES = list(range(0, 60))


@query("newton_first_split", "feature", "threshold gain left_value right_value", "shots",
       """f AS (SELECT floor(shot_x) AS sx, floor(abs(shot_y)) AS sy, coalesce(goal, false)::INT AS y FROM shots),
       p AS (SELECT avg(y) AS p FROM f),
       v AS (SELECT unnest([struct_pack(f := 'sx', x := sx), struct_pack(f := 'sy', x := sy)], recursive := true), p.p - y AS g, p.p * (1 - p.p) AS h FROM f, p),
       t AS (SELECT f, sum(g) AS tg, sum(h) AS th FROM v GROUP BY f),
       c AS (SELECT v.f, e.e, sum(g) AS lg, sum(h) AS lh FROM v, (SELECT unnest(range(0, 60)) AS e) e WHERE v.x <= e.e GROUP BY v.f, e.e),
       s AS (SELECT c.f AS feature, e AS threshold, lg ** 2 / (lh + 2) + (tg - lg) ** 2 / (th - lh + 2) - tg ** 2 / (th + 2) AS gain,
             -0.5 * lg / (lh + 2) AS left_value, -0.5 * (tg - lg) / (th - lh + 2) AS right_value
             FROM c JOIN t ON t.f = c.f WHERE lh >= 8 AND th - lh >= 8)""",
       "(SELECT * FROM s ORDER BY round(gain, 9) DESC, feature, threshold LIMIT 1)")
def newton_first_split(spark, sf_dir):
    own = shots(spark, sf_dir).select(F.floor("shot_x").alias("sx"), F.floor(F.abs("shot_y")).alias("sy"), F.coalesce("goal", F.lit(False)).alias("y"))
    model = newton_fitted(own, ["sx", "sy"], "y", TreesConfig(rounds=1, depth=1, rate=0.5, l2=2.0, least_weight=8), edges=[NEWTON_EDGES, NEWTON_EDGES])
    nodes = model.table(spark)
    side = lambda n: F.max(F.when(F.col("node") == n, F.col("value")))
    row = nodes.agg(F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.max("gain").alias("gain"), side(1).alias("left_value"), side(2).alias("right_value"))
    return row.filter("feature is not null")


@query("shot_model_coefficients", "feature", "weight")
def shot_model_coefficients(spark, sf_dir):
    model, _ = _shot_model(spark, sf_dir, "logistic")
    return M.coefficients(model)


@query("shot_location_surface", "", "shot_x shot_y xg")
def shot_location_surface(spark, sf_dir):
    model, _ = _shot_model(spark, sf_dir, "logistic")
    return M.location_surface(model, P.with_set_piece_flags(shots(spark, sf_dir)))


@query("pass_model_comparison", "model split rows_n", "log_loss brier auc")
def pass_model_comparison(spark, sf_dir):
    own = P.with_pass_features(P.modelled_passes(passes(spark, sf_dir)))
    split = M.season_split(own, ["s0", "s1"], ["s2"])
    numbers = ["passer_x", "target_x", "pass_distance_feature", "pass_progression", "pass_angle_model"]
    configs = {"logistic": M.PASS_MODELS["logistic"], "trees": M.ModelConfig("trees", min_frequency=30, rounds=10, depth=3)}
    _, _, rows = M.compared(split, numbers, ["high_pass", "is_long_pass"], ["player_position", "start_type"], "pass_completed", configs, "xpass")
    return rows.withColumnRenamed("rows", "rows_n")
