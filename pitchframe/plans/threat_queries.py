"""Queries of on-ball actions and possession threat, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.pitch import route_channel
from pitchframe.functions.stats import agreement
from pitchframe.operators import actions as A
from pitchframe.operators import report as R
from pitchframe.operators import threat as T
from pitchframe.plans.surrogates import Registry, actions, possessions

registry = Registry()
query = registry.add
L, H, ROUNDS = 4, 3, 5  # a small grid and fixed rounds, so that SQL can write the iteration out


def cell_sql(x: str, y: str, columns: int, rows: int) -> str:
    at = lambda c, size, n: f"least(greatest(floor(({c} + {size / 2}e0) / {size}e0 * {n}), 0), {n - 1})"
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL ELSE CAST({at(y, 68, rows)} * {columns} + {at(x, 105, columns)} AS INTEGER) END"


def grid_sql(columns: int, rows: int) -> str:
    """c: actions with cells; g: probabilities by cell; t: transitions."""
    return f"""
c AS (SELECT *, {cell_sql("start_x", "start_y", columns, rows)} AS start_cell, {cell_sql("end_x", "end_y", columns, rows)} AS end_cell FROM actions),
g0 AS (SELECT start_cell AS cell, count(*) FILTER (action_type = 'shot') AS shots, count(*) FILTER (action_type = 'shot' AND goal) AS goals,
       count(*) FILTER (action_type IN ('pass', 'carry', 'cross')) AS moves FROM c WHERE start_cell IS NOT NULL GROUP BY 1),
g AS (SELECT *, coalesce(goals / nullif(shots, 0), 0)::DOUBLE AS p_goal, coalesce(shots / nullif(shots + moves, 0), 0)::DOUBLE AS p_shot,
      coalesce(moves / nullif(shots + moves, 0), 0)::DOUBLE AS p_move FROM g0),
t0 AS (SELECT start_cell, end_cell, count(*) AS every, count(*) FILTER (move_success) AS n FROM c
       WHERE start_cell IS NOT NULL AND end_cell IS NOT NULL AND action_type IN ('pass', 'carry', 'cross') GROUP BY 1, 2),
t AS (SELECT start_cell, end_cell, n, n / sum(every) OVER (PARTITION BY start_cell) AS p FROM t0 QUALIFY n > 0)"""


def surface_sql(columns: int, rows: int, rounds: int) -> str:
    """x{rounds}: cell, value."""
    n = columns * rows
    parts = [grid_sql(columns, rows), f"x0 AS (SELECT unnest(range({n}))::INTEGER AS cell, 0e0 AS value)"]
    for k in range(rounds):
        parts.append(
            f"x{k + 1} AS MATERIALIZED (SELECT x0.cell, coalesce(any_value(g.p_goal * g.p_shot), 0) + coalesce(any_value(g.p_move), 0) * coalesce(sum(t.p * v.value), 0) AS value"
            f" FROM x0 LEFT JOIN g ON g.cell = x0.cell LEFT JOIN t ON t.start_cell = x0.cell LEFT JOIN x{k} v ON v.cell = t.end_cell GROUP BY x0.cell)"
        )
    return ",\n".join(parts)


RATED = (
    surface_sql(L, H, ROUNDS)
    + f""",
r AS (SELECT c.*, s.value AS xt_start, e.value AS xt_end,
      CASE WHEN action_type IN ('pass', 'carry', 'cross') AND move_success THEN e.value - s.value END AS xt_added
      FROM c LEFT JOIN x{ROUNDS} s ON s.cell = c.start_cell LEFT JOIN x{ROUNDS} e ON e.cell = c.end_cell)"""
)


def rated(spark, sf_dir):
    own = actions(spark, sf_dir)
    return T.rated(own, T.fitted(own, L, H, epsilon=0.0, most_rounds=ROUNDS), prefix="xt")


SUMMARY = """(SELECT team_shortname, count(*) AS actions, count(DISTINCT match_id) AS matches, count(xt_added) AS rated_actions,
coalesce(sum(xt_added), 0) AS xT, avg(xt_added) AS avg_xT, coalesce(sum(xt_added) FILTER (xt_added > 0), 0) AS positive_xT,
coalesce(sum(xt_added), 0) / nullif(count(xt_added), 0) * 100 AS xT_per_100, count(*) FILTER (action_type = 'pass') AS n_pass,
count(*) FILTER (action_type = 'carry') AS n_carry, count(*) FILTER (action_type = 'shot') AS n_shot FROM r GROUP BY 1)"""


@query("xt_leaderboard", "team_shortname actions matches rated_actions n_pass n_carry n_shot", "xT avg_xT positive_xT xT_per_100", "actions", RATED, SUMMARY)
def xt_leaderboard(spark, sf_dir):
    return T.summary(rated(spark, sf_dir), ["team_shortname"], "xt_added", kinds=["pass", "carry", "shot"])


@query("xt_player_leaders", "player_id actions rated_actions", "xT xT_per_100", "actions", RATED,
       """(SELECT player_id, count(*) AS actions, count(xt_added) AS rated_actions, coalesce(sum(xt_added), 0) AS xT,
       coalesce(sum(xt_added), 0) / nullif(count(xt_added), 0) * 100 AS xT_per_100 FROM r GROUP BY 1 HAVING count(*) >= 60)""")  # fmt: skip
def xt_player_leaders(spark, sf_dir):
    return T.summary(rated(spark, sf_dir), ["player_id"], "xt_added", least_actions=60)


@query("xt_metrics", "actions matches rated_actions", "xT xT_per_100 positive_xT", "actions", RATED,
       """(SELECT count(*) AS actions, count(DISTINCT match_id) AS matches, count(xt_added) AS rated_actions, coalesce(sum(xt_added), 0) AS xT,
       coalesce(sum(xt_added), 0) / greatest(count(xt_added), 1) * 100 AS xT_per_100, coalesce(sum(xt_added) FILTER (xt_added > 0), 0) AS positive_xT FROM r)""")  # fmt: skip
def xt_metrics(spark, sf_dir):
    return T.metrics(rated(spark, sf_dir), "xt_added")


@query("xt_surface_value_iteration", "cell", "value", "actions", surface_sql(16, 12, ROUNDS), f"x{ROUNDS}")
def xt_surface_value_iteration(spark, sf_dir):
    surface = T.fitted(actions(spark, sf_dir), epsilon=0.0, most_rounds=ROUNDS)
    return spark.createDataFrame(list(enumerate(surface.values)), "cell int, value double")


#: Rounds k of all cells until the largest change is 1e-5 or less.
CONVERGED = """,
       every_cell AS MATERIALIZED (SELECT c.cell, coalesce(g.p_goal * g.p_shot, 0) AS gain, coalesce(g.p_move, 0) AS stay FROM (SELECT unnest(range(0, 192)) AS cell) c LEFT JOIN g USING (cell)),
       onward AS MATERIALIZED (SELECT start_cell, end_cell, p FROM t),
       it AS (SELECT 0 AS k, cell, 0e0 AS value, 1e9 AS delta FROM every_cell
              UNION ALL
              SELECT k + 1, cell, new, abs(new - value) FROM (
                SELECT q.k, q.cell, q.value, every_cell.gain + every_cell.stay * coalesce((SELECT sum(onward.p * o.value) FROM onward JOIN it o ON o.cell = onward.end_cell WHERE onward.start_cell = q.cell), 0) AS new
                FROM it q JOIN every_cell ON every_cell.cell = q.cell WHERE (SELECT max(delta) FROM it) > 1e-5 AND q.k < 200))"""


@query("xt_surface_converged", "cell rounds", "value", "actions", grid_sql(16, 12) + CONVERGED, "(SELECT cell, k AS rounds, value FROM it WHERE k = (SELECT max(k) FROM it))", recursive=True)
def xt_surface_converged(spark, sf_dir):
    return T.converged(actions(spark, sf_dir))


@query("xt_iterations", "round cell", "value change", "actions", grid_sql(16, 12) + CONVERGED,
       "(SELECT k AS round, cell, value, max(delta) OVER (PARTITION BY k) AS change FROM it WHERE k > 0)", recursive=True)
def xt_iterations(spark, sf_dir):
    return T.iterations(actions(spark, sf_dir))


@query("xt_cell_probabilities", "cell shots goals moves", "p_goal p_shot p_move", "actions", grid_sql(16, 12), "g")
def xt_cell_probabilities(spark, sf_dir):
    return T.cell_probabilities(actions(spark, sf_dir))


@query("xt_component_mask", "cell shots", "p_goal", "actions", grid_sql(L, H), "(SELECT cell, shots, CASE WHEN shots >= 30 THEN p_goal END AS p_goal FROM g)")
def xt_component_mask(spark, sf_dir):
    return T.masked_components(T.cell_probabilities(actions(spark, sf_dir), L, H), 30)


@query("xt_transitions", "start_cell end_cell n", "p", "actions", grid_sql(16, 12), "t")
def xt_transitions(spark, sf_dir):
    return T.transitions(actions(spark, sf_dir))


@query("xt_rated_actions", "event_id", "xt_start xt_end xt_added xt_zero xt_lost", "actions",
       RATED.rstrip() + """, m AS (SELECT *, action_type IN ('pass', 'carry', 'cross') AS is_move FROM r)""",
       """(SELECT event_id, xt_start, xt_end, xt_added, CASE WHEN is_move AND move_success THEN xt_end - xt_start WHEN is_move THEN 0 END AS xt_zero,
       CASE WHEN is_move AND move_success THEN xt_end - xt_start WHEN is_move THEN -xt_start END AS xt_lost FROM m)""")  # fmt: skip
def xt_rated_actions(spark, sf_dir):
    own = actions(spark, sf_dir)
    surface = T.fitted(own, L, H, epsilon=0.0, most_rounds=ROUNDS)
    out = T.rated(own, surface, prefix="xt")
    out = T.rated(out, surface, "zero", "z")
    return T.rated(out, surface, "negative_start", "l").withColumnsRenamed({"z_added": "xt_zero", "l_added": "xt_lost"})


@query("xt_precomputed_surface", "event_id", "v_start v_end v_added", "actions",
       f"""s AS (SELECT *, {cell_sql("start_x", "-start_y", 4, 3).replace("(-start_y", "(start_y")} AS sc, {cell_sql("end_x", "end_y", 4, 3)} AS ec FROM actions),
       f AS (SELECT *, CASE WHEN sc IS NULL THEN NULL ELSE (2 - sc // 4) * 4 + sc % 4 END AS s2, CASE WHEN ec IS NULL THEN NULL ELSE (2 - ec // 4) * 4 + ec % 4 END AS e2 FROM s)""",
       """(SELECT event_id, s2 / 100e0 AS v_start, e2 / 100e0 AS v_end,
       CASE WHEN action_type IN ('pass', 'carry', 'cross') AND move_success THEN e2 / 100e0 - s2 / 100e0 END AS v_added FROM f)""")  # fmt: skip
def xt_precomputed_surface(spark, sf_dir):
    surface = T.Surface(4, 3, [k / 100 for k in range(12)], top_first=True)
    return T.rated(actions(spark, sf_dir), surface, prefix="v")


RANKS = """b AS (SELECT season_name, xt_added, provider_threat FROM r WHERE xt_added IS NOT NULL AND provider_threat IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY season_name ORDER BY xt_added) + (count(*) OVER (PARTITION BY season_name, xt_added) - 1) / 2e0 AS ra,
      rank() OVER (PARTITION BY season_name ORDER BY provider_threat) + (count(*) OVER (PARTITION BY season_name, provider_threat) - 1) / 2e0 AS rb FROM b)"""


@query("xt_against_provider", "season_name n", "pearson mean_difference mae rmse", "actions", RATED + ",\n" + RANKS,
       """(SELECT season_name, count(*) AS n, corr(xt_added, provider_threat) AS pearson, avg(xt_added - provider_threat) AS mean_difference,
       avg(abs(xt_added - provider_threat)) AS mae, sqrt(avg((xt_added - provider_threat) ** 2)) AS rmse FROM k GROUP BY 1)""")  # fmt: skip
def xt_against_provider(spark, sf_dir):
    return agreement(rated(spark, sf_dir), "xt_added", "provider_threat", ["season_name"])


@query("rank_agreement", "season_name n", "spearman", "actions",
       """k AS (SELECT season_name, rank() OVER (PARTITION BY season_name ORDER BY end_x) + (count(*) OVER (PARTITION BY season_name, end_x) - 1) / 2e0 AS ra,
          rank() OVER (PARTITION BY season_name ORDER BY provider_threat) + (count(*) OVER (PARTITION BY season_name, provider_threat) - 1) / 2e0 AS rb
          FROM actions WHERE end_x IS NOT NULL AND provider_threat IS NOT NULL)""",
       "(SELECT season_name, count(*) AS n, corr(ra, rb) AS spearman FROM k GROUP BY 1)")
def rank_agreement(spark, sf_dir):
    return agreement(actions(spark, sf_dir), "end_x", "provider_threat", ["season_name"])


CHANNEL = """h AS (SELECT *, abs((start_y + end_y) / 2) AS my FROM r),
ch AS (SELECT *, CASE WHEN my <= 68e0 / 6 THEN 'central' WHEN my <= 68e0 / 3 THEN 'half-space' WHEN my IS NOT NULL THEN 'wide' ELSE 'unknown' END AS route_channel FROM h)"""


@query("xt_route_channels", "team_shortname route_channel", "xT_pass xT_carry", "actions", RATED + ",\n" + CHANNEL,
       """(SELECT team_shortname, route_channel, sum(CASE WHEN action_type = 'pass' THEN coalesce(xt_added, 0) ELSE 0 END) AS xT_pass,
       sum(CASE WHEN action_type = 'carry' THEN coalesce(xt_added, 0) ELSE 0 END) AS xT_carry FROM ch GROUP BY 1, 2)""")  # fmt: skip
def xt_route_channels(spark, sf_dir):
    return R.route_value(rated(spark, sf_dir), "xt_added", ["team_shortname"])


@query("route_channel_counts", "route_channel n", "", "actions", RATED + ",\n" + CHANNEL, "(SELECT route_channel, count(*) AS n FROM ch GROUP BY 1)")
def route_channel_counts(spark, sf_dir):
    own = actions(spark, sf_dir).withColumn("route_channel", F.coalesce(route_channel(F.col("start_y"), F.col("end_y")), F.lit("unknown")))
    return R.value_counts(own, "route_channel")


# --- from raw possessions -------------------------------------------------------------------------------------------
NUM = """q AS (SELECT *, TRY_CAST(x_start AS DOUBLE) AS x0, TRY_CAST(y_start AS DOUBLE) AS y0, TRY_CAST(x_end AS DOUBLE) AS x1, TRY_CAST(y_end AS DOUBLE) AS y1,
TRY_CAST(player_targeted_x_pass AS DOUBLE) AS tx, TRY_CAST(player_targeted_y_pass AS DOUBLE) AS ty, coalesce(lower(carry) IN ('true', '1'), false) AS cf,
coalesce(start_type NOT IN ('corner', 'free_kick', 'throw_in', 'goal_kick', 'kick_off', 'penalty'), true) AS open_play
FROM possessions WHERE event_type = 'player_possession'),
made AS (
SELECT event_id || ':carry' AS event_id, match_id, 'carry' AS action_type, x0 AS start_x, y0 AS start_y, x1 AS end_x, y1 AS end_y, true AS move_success, false AS goal, NULL AS target_threat
  FROM q WHERE open_play AND (cf OR coalesce(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 1, false))
UNION ALL SELECT event_id || ':pass', match_id, 'pass', x1, y1, coalesce(tx, x1), coalesce(ty, y1), pass_outcome = 'successful', false, TRY_CAST(player_targeted_xthreat AS DOUBLE)
  FROM q WHERE open_play AND end_type = 'pass'
UNION ALL SELECT event_id || ':shot', match_id, 'shot', x1, y1, x1, y1, false, coalesce(game_interruption_after = 'goal_for', false), NULL
  FROM q WHERE open_play AND end_type = 'shot'),
kept AS (SELECT * FROM made WHERE start_x BETWEEN -52.5 AND 52.5 AND start_y BETWEEN -34 AND 34
  AND (action_type = 'shot' OR (end_x BETWEEN -52.5 AND 52.5 AND end_y BETWEEN -34 AND 34)))"""


def from_feed(spark, sf_dir):
    own = possessions(spark, sf_dir)
    open_play = F.coalesce(~F.col("start_type").isin(A.SET_PIECES), F.lit(True))
    return A.from_possessions(own.withColumn("is_open_play", open_play))


@query("actions_from_possessions", "event_id match_id action_type move_success goal", "start_x start_y end_x end_y target_threat", "possessions", NUM, "made")
def actions_from_possessions(spark, sf_dir):
    return from_feed(spark, sf_dir)


@query("actions_prepared", "event_id match_id action_type move_success goal", "start_x start_y end_x end_y target_threat", "possessions", NUM, "kept")
def actions_prepared(spark, sf_dir):
    return A.prepared(from_feed(spark, sf_dir))


@query("action_table_stats", "n_rows n_matches n_pass n_carry n_shot n_successful_moves n_goals", "", "possessions", NUM,
       """(SELECT count(*) AS n_rows, count(DISTINCT match_id) AS n_matches, count(*) FILTER (action_type = 'pass') AS n_pass, count(*) FILTER (action_type = 'carry') AS n_carry,
       count(*) FILTER (action_type = 'shot') AS n_shot, count(*) FILTER (action_type <> 'shot' AND move_success) AS n_successful_moves, count(*) FILTER (goal) AS n_goals FROM kept)""")  # fmt: skip
def action_table_stats(spark, sf_dir):
    return A.table_stats(A.prepared(from_feed(spark, sf_dir)))


@query("actions_with_metadata", "event_id match_id kickoff source", "", "actions",
       """m1 AS (SELECT match_id, min(event_id) AS kickoff, 'a' AS source FROM actions WHERE event_id % 2 = 0 AND match_id < 'm5' GROUP BY 1),
       m2 AS (SELECT match_id, max(event_id) AS kickoff, 'b' AS source FROM actions GROUP BY 1),
       m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 WHERE match_id NOT IN (SELECT match_id FROM m1))""",
       "(SELECT event_id, a.match_id, kickoff, source FROM actions a LEFT JOIN m ON a.match_id = m.match_id)")
def actions_with_metadata(spark, sf_dir):
    own = actions(spark, sf_dir)
    first = own.filter("event_id % 2 = 0 and match_id < 'm5'").groupBy("match_id").agg(F.min("event_id").alias("kickoff")).withColumn("source", F.lit("a"))
    second = own.groupBy("match_id").agg(F.max("event_id").alias("kickoff")).withColumn("source", F.lit("b"))
    return A.with_metadata(own.select("event_id", "match_id"), [first, second])


@query("actions_with_provider_threat", "event_id parent_pp_id", "target_threat", "actions passes",
       """one AS (SELECT match_id, 'e' || (event_id // 4) AS k, min(model_xpass) AS target_threat FROM passes GROUP BY 1, 2)""",
       "(SELECT event_id, parent_pp_id, target_threat FROM actions a LEFT JOIN one ON a.match_id = one.match_id AND a.parent_pp_id = one.k)")
def actions_with_provider_threat(spark, sf_dir):
    from pitchframe.plans.surrogates import passes

    right = passes(spark, sf_dir).selectExpr("match_id", "'e' || (event_id div 4) AS event_id", "model_xpass AS player_targeted_xthreat")
    return A.with_provider_threat(actions(spark, sf_dir).select("event_id", "match_id", "parent_pp_id"), right)


@query("actions_with_actual_goals", "event_id shot_goal_actual", "", "actions",
       "one AS (SELECT match_id, 'e' || event_id AS k, bool_and(goal) AS g FROM actions WHERE action_type = 'shot' GROUP BY 1, 2)",
       "(SELECT event_id, one.g AS shot_goal_actual FROM actions a LEFT JOIN one ON a.match_id = one.match_id AND a.parent_pp_id = one.k)")
def actions_with_actual_goals(spark, sf_dir):
    own = actions(spark, sf_dir)
    right = own.filter("action_type = 'shot'").selectExpr("match_id", "'e' || event_id AS event_id", "goal")
    return A.with_actual_goals(own.select("event_id", "match_id", "parent_pp_id"), right)


@query("match_sides", "event_id home_away opponent_home_away is_open_play", "", "possessions",
       """s AS (SELECT event_id, CASE WHEN team_id = 't' || (substr(match_id, 2)::INT * 2) THEN 'home' WHEN team_id = 't' || (substr(match_id, 2)::INT * 2 + 1) THEN 'away' END AS home_away,
       coalesce(start_type <> 'corner', true) AS is_open_play FROM possessions)""",
       "(SELECT *, CASE home_away WHEN 'home' THEN 'away' WHEN 'away' THEN 'home' END AS opponent_home_away FROM s)")
def match_sides(spark, sf_dir):
    own = possessions(spark, sf_dir)
    matches = own.select("match_id").distinct().selectExpr("match_id", "'t' || (int(substr(match_id, 2)) * 2) AS home_team_id", "'t' || (int(substr(match_id, 2)) * 2 + 1) AS away_team_id")
    return A.with_match(own, matches)


# --- reports ----------------------------------------------------------------------------------------------------------
DANGER = RATED + """,
d AS (SELECT *, greatest(coalesce(xt_added, 0), 0) AS v, coalesce(xt_added, 0) AS nv, end_x - start_x AS pr,
      least(greatest(floor((start_x + 52.5e0) / 105e0 * 16), 0), 15)::INT AS x_cell, least(greatest(floor((start_y + 34e0) / 68e0 * 12), 0), 11)::INT AS y_cell,
      least(greatest(floor((end_x + 52.5e0) / 105e0 * 16), 0), 15)::INT AS end_x_cell, least(greatest(floor((end_y + 34e0) / 68e0 * 12), 0), 11)::INT AS end_y_cell
      FROM r WHERE action_type IN ('pass', 'carry') AND start_x IS NOT NULL AND end_x IS NOT NULL)"""


def danger(spark, sf_dir):
    return R.danger_rows(rated(spark, sf_dir), "xt_added")


@query("danger_zone_cells", "team_shortname x_cell y_cell actions passes carries", "xT net_xT avg_xT avg_progression xT_per_100", "actions", DANGER + """,
       grid AS (SELECT DISTINCT team_shortname, x::INT AS x_cell, y::INT AS y_cell FROM d, range(16) a(x), range(12) b(y)),
       s AS (SELECT team_shortname, x_cell, y_cell, count(*) AS actions, count(*) FILTER (action_type = 'pass') AS passes, count(*) FILTER (action_type = 'carry') AS carries,
             sum(v) AS xT, sum(nv) AS net_xT, avg(v) AS avg_xT, avg(pr) AS avg_progression FROM d GROUP BY 1, 2, 3)""",
       """(SELECT team_shortname, x_cell::BIGINT AS x_cell, y_cell::BIGINT AS y_cell, coalesce(actions, 0) AS actions, coalesce(passes, 0) AS passes, coalesce(carries, 0) AS carries,
       coalesce(xT, 0) AS xT, coalesce(net_xT, 0) AS net_xT, coalesce(avg_xT, 0) AS avg_xT, coalesce(avg_progression, 0) AS avg_progression,
       coalesce(xT / nullif(actions, 0), 0) * 100 AS xT_per_100 FROM grid LEFT JOIN s USING (team_shortname, x_cell, y_cell))""")  # fmt: skip
def danger_zone_cells(spark, sf_dir):
    return R.danger_cells(danger(spark, sf_dir))


@query("danger_zone_players", "team_shortname x_cell y_cell player_name actions place", "xT net_xT", "actions", DANGER + """,
       s AS (SELECT team_shortname, x_cell, y_cell, player_name, count(*) AS actions, round(sum(v), 9) AS xT, sum(nv) AS net_xT FROM d GROUP BY 1, 2, 3, 4)""",
       """(SELECT *, row_number() OVER (PARTITION BY team_shortname, x_cell, y_cell ORDER BY xT DESC, player_name) AS place FROM s QUALIFY place <= 5)""")  # fmt: skip
def danger_zone_players(spark, sf_dir):
    return R.danger_players(danger(spark, sf_dir))


@query("danger_zone_payload", "team payload")
def danger_zone_payload(spark, sf_dir):
    return R.danger_payload(danger(spark, sf_dir))


@query("heat_map", "x_bin y_bin n", "total mean", "actions", RATED,
       """(SELECT least(floor((start_x + 52.5e0) / 105e0 * 12), 11)::BIGINT AS x_bin, least(floor((start_y + 34e0) / 68e0 * 8), 7)::BIGINT AS y_bin, count(*) AS n,
       sum(coalesce(xt_added, 0)) AS total, avg(coalesce(xt_added, 0)) AS mean FROM r WHERE start_x BETWEEN -52.5 AND 52.5 AND start_y BETWEEN -34 AND 34 GROUP BY 1, 2 HAVING count(*) >= 3)""")  # fmt: skip
def heat_map(spark, sf_dir):
    return R.heat_map(rated(spark, sf_dir), "start_x", "start_y", 12, 8, "xt_added", 3)


@query("sequence_trajectory", "event_id action_number", "cumulative", "actions", RATED,
       """(SELECT event_id, row_number() OVER w AS action_number, sum(coalesce(xt_added, 0)) OVER w AS cumulative FROM r
       WINDOW w AS (PARTITION BY match_id, phase_index, team_shortname ORDER BY period_id, event_id ROWS UNBOUNDED PRECEDING))""")  # fmt: skip
def sequence_trajectory(spark, sf_dir):
    return R.sequence_trajectory(rated(spark, sf_dir), "xt_added", ["match_id", "phase_index", "team_shortname"], ["period_id", "event_id"])


@query("top_sequences", "event_id", "", "actions", "s AS (SELECT match_id, phase_index, sum(p_scores) AS v FROM actions GROUP BY 1, 2 ORDER BY round(v, 6) DESC, match_id, phase_index LIMIT 5)",
       "(SELECT event_id FROM actions a WHERE EXISTS (SELECT 1 FROM s WHERE s.match_id = a.match_id AND s.phase_index = a.phase_index))")
def top_sequences(spark, sf_dir):
    own = actions(spark, sf_dir)
    summary = own.groupBy("match_id", "phase_index").agg(F.round(F.sum("p_scores"), 6).alias("xT"))
    return R.top_sequences(own, summary, ["match_id", "phase_index"], 5)


@query("surface_comparison", "cell", "a b difference", "actions",
       surface_sql(L, H, ROUNDS),
       f"(SELECT cell, value AS a, cell / 100e0 AS b, value - cell / 100e0 AS difference FROM x{ROUNDS})")
def surface_comparison(spark, sf_dir):
    a = T.fitted(actions(spark, sf_dir), L, H, epsilon=0.0, most_rounds=ROUNDS)
    return T.surface_difference(spark, a, T.Surface(L, H, [k / 100 for k in range(L * H)]))


@query("phase_shares", "team_shortname n", "pass carry other", "actions", "",
       """(SELECT team_shortname, count(*) AS n, count(*) FILTER (action_type = 'pass') / count(*) AS pass, count(*) FILTER (action_type = 'carry') / count(*) AS carry,
       count(*) FILTER (action_type NOT IN ('pass', 'carry')) / count(*) AS other FROM actions GROUP BY 1)""")  # fmt: skip
def phase_shares(spark, sf_dir):
    return R.row_shares(actions(spark, sf_dir), "team_shortname", "action_type", ["pass", "carry"])


@query("mean_of_three_least", "player_id n", "mean_start_y", "actions", "k AS (SELECT player_id, start_y, row_number() OVER (PARTITION BY player_id ORDER BY start_y) AS i FROM actions)",
       "(SELECT player_id, avg(start_y) AS mean_start_y, count(*) AS n FROM k WHERE i <= 3 GROUP BY 1)")
def mean_of_three_least(spark, sf_dir):
    return R.mean_of_least(actions(spark, sf_dir), ["player_id"], "start_y")
