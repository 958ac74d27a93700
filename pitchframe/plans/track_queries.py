"""Queries of tracking and physical output, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitchframe.functions.shared import fresh_path
from pitchframe.operators import animation as N
from pitchframe.operators import efforts as E
from pitchframe.operators import explosive as X
from pitchframe.operators import physical as Y
from pitchframe.operators import report as R
from pitchframe.operators import tracking as T
from pitchframe.plans import workflows as W
from pitchframe.plans.surrogates import Registry, actions, performances, tracks
from pitchframe.sources import archive

registry = Registry()
query = registry.add
CONFIG = T.TrackingConfig()
SEGMENTS = """l AS (SELECT *, timestamp - lag(timestamp) OVER w AS st FROM tracks WINDOW w AS (PARTITION BY match_id, player_id, period_id ORDER BY timestamp)),
g AS (SELECT *, sum(CASE WHEN st IS NULL OR st <= 0 OR st > 0.5 + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id, period_id ORDER BY timestamp) AS segment_id FROM l)"""
#: Kinematics: the speed of the last ten steps, acceleration, live play.
KINEMATICS = SEGMENTS + """,
d AS (SELECT *, timestamp - lag(timestamp) OVER w AS dt, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS rs, row_number() OVER w AS i, count(*) OVER (PARTITION BY match_id, player_id, segment_id) AS n,
ball_state = 'alive' AS bip FROM g WINDOW w AS (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp)),
v AS (SELECT *, CASE WHEN rs IS NOT NULL THEN sum(rs) OVER w / sum(dt) OVER w END AS raw FROM d WINDOW w AS (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN raw <= 40 / 3.6e0 THEN raw END AS speed FROM v),
k AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN i = 1 THEN (lead(speed) OVER w - speed) / 0.1e0 WHEN i = n THEN (speed - lag(speed) OVER w) / 0.1e0 ELSE (lead(speed) OVER w - lag(speed) OVER w) / 0.2e0 END AS acc,
speed * dt AS step, dt IS NOT NULL AND speed IS NOT NULL AS valid FROM s WINDOW w AS (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp))"""


def kinematics(spark, sf_dir, config=CONFIG):
    return T.with_kinematics(T.with_segments(T.with_live(tracks(spark, sf_dir)), config.max_gap_seconds), config)


@query("track_segments", "match_id player_id frame_id segment_id", "", "track_base track_step tracks", SEGMENTS, "(SELECT match_id, player_id, frame_id, segment_id::BIGINT AS segment_id FROM g)")
def track_segments(spark, sf_dir):
    return T.with_segments(tracks(spark, sf_dir), 0.5)


@query("track_kinematics", "match_id player_id frame_id valid_interval is_bip", "dt raw_speed_mps speed_mps acceleration_mps2 step_distance_m", "track_base track_step tracks", KINEMATICS,
       "(SELECT match_id, player_id, frame_id, valid AS valid_interval, bip AS is_bip, dt, raw AS raw_speed_mps, speed AS speed_mps, CASE WHEN abs(acc) <= 8 THEN acc END AS acceleration_mps2, step AS step_distance_m FROM k)")
def track_kinematics(spark, sf_dir):
    return kinematics(spark, sf_dir)


@query("track_prepared_default", "match_id player_id frame_id", "speed_mps effective_sample_hz", "track_base track_step tracks", KINEMATICS, "(SELECT match_id, player_id, frame_id, speed AS speed_mps, 10 AS effective_sample_hz FROM k)")
def track_prepared_default(spark, sf_dir):
    return T.prepared(tracks(spark, sf_dir))


@query("track_resampled", "match_id player_id frame_id", "timestamp x y", "track_base track_step tracks", SEGMENTS + """,
       a AS (SELECT *, lead(timestamp) OVER w AS nt, lead(x) OVER w AS nx, min(timestamp) OVER p AS t0, max(timestamp) OVER p AS tn FROM g
       WINDOW w AS (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp), p AS (PARTITION BY match_id, player_id, segment_id)),
       b AS (SELECT *, ceil((timestamp - t0) / 0.04e0 - 1e-7)::BIGINT AS ka, CASE WHEN nt IS NULL THEN floor((tn - t0) / 0.04e0 + 1e-7) ELSE ceil((nt - t0) / 0.04e0 - 1e-7) - 1 END::BIGINT AS kb FROM a),
       c AS (SELECT *, unnest(range(ka, kb + 1)) AS k FROM b)""",
       "(SELECT match_id, player_id, frame_id, round(t0 + k * 0.04e0, 9) AS timestamp, CASE WHEN nx IS NULL THEN x ELSE x + coalesce((round(t0 + k * 0.04e0, 9) - timestamp) / nullif(nt - timestamp, 0), 0) * (nx - x) END AS x, y FROM c)")
def track_resampled(spark, sf_dir):
    return T.resampled(T.with_segments(tracks(spark, sf_dir), 0.5), 0.04)


@query("track_step_seconds", "match_id", "median_step deviation", "track_base track_step tracks", SEGMENTS + """,
       p AS (SELECT match_id, timestamp - lag(timestamp) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS st2 FROM g), m AS (SELECT match_id, quantile_cont(st2, 0.5) AS median_step FROM p WHERE st2 > 0 GROUP BY 1)""",
       "(SELECT match_id, median_step, max(abs(st2 - median_step)) AS deviation FROM p JOIN m USING (match_id) WHERE st2 > 0 GROUP BY 1, 2)")
def track_step_seconds(spark, sf_dir):
    return T.step_seconds(T.with_segments(tracks(spark, sf_dir), 0.5))


@query("track_cap_report", "match_id samples n_segments", "capped_speed_share capped_acceleration_share", "track_base track_step tracks", KINEMATICS,
       """(SELECT match_id, count(*) AS samples, count(DISTINCT player_id || ':' || segment_id) AS n_segments, avg(coalesce(raw > 40 / 3.6e0, false)::INT) AS capped_speed_share,
       avg(coalesce(abs(acc) > 8, false)::INT) AS capped_acceleration_share FROM k GROUP BY 1)""")  # fmt: skip
def track_cap_report(spark, sf_dir):
    return T.cap_report(kinematics(spark, sf_dir))


#: Efforts above 20 km/h (gaps and islands), those over at least 0.7 s.
EFFORTS = KINEMATICS + """,
u AS (SELECT *, coalesce(speed > 20 / 3.6e0, false) AS m FROM k),
r AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS e
FROM (SELECT *, lag(m) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS pm FROM u)),
f AS (SELECT match_id, player_id, segment_id, e AS effort, min(timestamp) AS first, max(timestamp) AS last, count(*) AS samples, count(*) * 0.1e0 AS above_seconds, max(speed) AS peak, avg(bip::INT) AS live_share
FROM r WHERE m GROUP BY 1, 2, 3, 4 HAVING count(*) * 0.1e0 >= 0.7 - 1e-9)"""


@query("track_efforts", "match_id player_id segment_id effort samples", "first last above_seconds peak live_share", "track_base track_step tracks", EFFORTS,
       "(SELECT * REPLACE (segment_id::BIGINT AS segment_id, effort::BIGINT AS effort) FROM f)")
def track_efforts(spark, sf_dir):
    own = kinematics(spark, sf_dir)
    return E.efforts(own, F.col("speed_mps") > 20 * T.KMH, CONFIG.dt, 0.7, shares={"live": F.col("is_bip")}, peak=F.col("speed_mps"))


#: Runs above 20 km/h and below it, with the dips that may be passed.
SENSITIVITY = KINEMATICS + """,
u AS (SELECT match_id, player_id, segment_id, i, coalesce(speed > 20 / 3.6e0, false) AS m FROM k),
t AS (SELECT *, CASE WHEN lag(m) OVER w IS DISTINCT FROM m THEN 1 ELSE 0 END AS turn FROM u WINDOW w AS (PARTITION BY match_id, player_id, segment_id ORDER BY i)),
o AS (SELECT *, sum(turn) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY i) AS run FROM t),
r AS (SELECT match_id, player_id, segment_id, run, m, count(*) AS len FROM o GROUP BY ALL),
p AS (SELECT r.*, dip, lag(run) OVER w IS NOT NULL AND lead(run) OVER w IS NOT NULL AS between_runs FROM r, (SELECT unnest([0e0, 0.1e0, 0.2e0, 0.3e0]) AS dip)
      WINDOW w AS (PARTITION BY match_id, player_id, segment_id, dip ORDER BY run)),
h AS (SELECT *, m OR (between_runs AND dip > 0 AND len * 0.1e0 <= dip + 1e-9) AS held FROM p),
e AS (SELECT *, CASE WHEN held AND NOT coalesce(lag(held) OVER (PARTITION BY match_id, player_id, segment_id, dip ORDER BY run), false) THEN 1 ELSE 0 END AS opened FROM h),
n AS (SELECT *, sum(opened) OVER (PARTITION BY match_id, player_id, segment_id, dip ORDER BY run) AS effort FROM e),
x AS (SELECT match_id, player_id, dip, sum(len) AS samples, sum(len) FILTER (m) * 0.1e0 AS above FROM n WHERE held GROUP BY match_id, player_id, segment_id, dip, effort)"""


@query("track_effort_sensitivity", "match_id player_id rule efforts", "dip_seconds", "track_base track_step tracks", SENSITIVITY,
       """(SELECT match_id, player_id, 'samples' AS rule, dip AS dip_seconds, count(*) AS efforts FROM x WHERE above >= 0.7e0 - 1e-9 GROUP BY ALL
       UNION ALL SELECT match_id, player_id, 'span', dip, count(*) FROM x WHERE (samples - 1) * 0.1e0 >= 0.7e0 - 1e-9 GROUP BY ALL)""")  # fmt: skip
def track_effort_sensitivity(spark, sf_dir):
    return E.sensitivity(kinematics(spark, sf_dir), F.col("speed_mps") > 20 * T.KMH, CONFIG)


PEAK = KINEMATICS + """,
u AS (SELECT *, coalesce(raw > 15 / 3.6e0, false) AS m FROM k),
r AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS e
FROM (SELECT *, lag(m) OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS pm FROM u)),
f AS (SELECT match_id, player_id, max(raw) AS peak FROM r WHERE m GROUP BY match_id, player_id, segment_id, e HAVING max(raw) <= 40 / 3.6e0)"""


@query("peak_speed_percentile", "match_id player_id", "psv99_kmh", "track_base track_step tracks", PEAK, "(SELECT match_id, player_id, quantile_cont(peak, 0.99) / (1 / 3.6e0) AS psv99_kmh FROM f GROUP BY 1, 2)")
def peak_speed_percentile(spark, sf_dir):
    return E.peak_percentile(kinematics(spark, sf_dir), CONFIG)


@query("frame_speed_percentile", "match_id player_id", "psv99_frame_kmh", "track_base track_step tracks", KINEMATICS + """,
       q AS (SELECT match_id, player_id, raw AS s, dt FROM k WHERE dt > 0 AND raw > 15 / 3.6e0 AND raw <= 40 / 3.6e0),
       c AS (SELECT *, sum(dt) OVER (PARTITION BY match_id, player_id ORDER BY s) AS run, sum(dt) OVER (PARTITION BY match_id, player_id) AS whole FROM q)""",
       "(SELECT match_id, player_id, min(s) * 3.6e0 AS psv99_frame_kmh FROM c WHERE run >= whole * 0.99e0 - 1e-9 GROUP BY 1, 2)")
def frame_speed_percentile(spark, sf_dir):
    return E.frame_percentile(kinematics(spark, sf_dir), CONFIG, ["match_id", "player_id"])


@query("player_match_physical", "match_id player_id sample_count segment_count played_time_source", "observed_seconds bip_seconds tip_seconds otip_seconds total_distance_m total_distance_all_m running_distance_m hsr_distance_m sprint_distance_m high_intensity_distance_m max_speed_kmh total_distance_m_p60_bip distance_tip_m", "track_base track_step tracks", KINEMATICS + """,
       b AS (SELECT *, bip AND TRY_CAST(ball_owning_team_id AS DOUBLE) = TRY_CAST(team_id AS DOUBLE) AS tip, bip AND TRY_CAST(ball_owning_team_id AS DOUBLE) <> TRY_CAST(team_id AS DOUBLE) AS otip, speed * 3.6e0 AS kmh FROM k)""",
       """(SELECT match_id, player_id, count(*) AS sample_count, count(DISTINCT segment_id) AS segment_count, 'observed_tracking' AS played_time_source, coalesce(sum(dt), 0) AS observed_seconds,
       coalesce(sum(dt) FILTER (valid AND bip), 0) AS bip_seconds, coalesce(sum(dt) FILTER (tip), 0) AS tip_seconds, coalesce(sum(dt) FILTER (otip), 0) AS otip_seconds,
       coalesce(sum(step) FILTER (valid AND bip), 0) AS total_distance_m, coalesce(sum(step) FILTER (valid), 0) AS total_distance_all_m,
       coalesce(sum(step) FILTER (valid AND bip AND kmh >= 14.99 AND kmh < 19.999), 0) AS running_distance_m, coalesce(sum(step) FILTER (valid AND bip AND kmh >= 19.999 AND kmh <= 25.001), 0) AS hsr_distance_m,
       coalesce(sum(step) FILTER (valid AND bip AND kmh > 25.001), 0) AS sprint_distance_m, coalesce(sum(step) FILTER (valid AND bip AND kmh > 20), 0) AS high_intensity_distance_m, max(kmh) AS max_speed_kmh,
       coalesce(sum(step) FILTER (valid AND bip), 0) * 3600 / nullif(coalesce(sum(dt) FILTER (valid AND bip), 0), 0) AS total_distance_m_p60_bip, coalesce(sum(step) FILTER (valid AND tip), 0) AS distance_tip_m FROM b GROUP BY 1, 2)""")  # fmt: skip
def player_match_physical(spark, sf_dir):
    return Y.player_matches(kinematics(spark, sf_dir), CONFIG)


@query("player_match_counts", "match_id player_id running_count hsr_count sprint_count high_intensity_count high_acceleration_count high_deceleration_count gap_count", "psv99_kmh psv99_frame_kmh coverage_ratio")
def player_match_counts(spark, sf_dir):
    return Y.player_matches(kinematics(spark, sf_dir), CONFIG)


@query("explosive_efforts", "match_id player_id family target bip_attributed", "seconds onset_timestamp target_timestamp bip_share")
def explosive_efforts(spark, sf_dir):
    config = replace(CONFIG, estimator="savgol")
    return X.explosive_efforts(kinematics(spark, sf_dir, config), config)


#: Rows of segments by their place i (from 1) of n.
PLACED = SEGMENTS + """,
r AS (SELECT match_id, player_id, segment_id, frame_id, x, y, row_number() OVER (PARTITION BY match_id, player_id, segment_id ORDER BY timestamp) AS i,
count(*) OVER (PARTITION BY match_id, player_id, segment_id) AS n FROM g)"""
SAME = "r.match_id = q.match_id AND r.player_id = q.player_id AND r.segment_id = q.segment_id"
KEYS = "match_id, player_id, segment_id"


def slope(c: str) -> str:
    """SQL of the derivative of the parabola through the m = 2h + 1 values l (places -h to h) at place j; centred differences below three."""
    k = "list_sum(list_transform(l{c}, lambda v, i: {f} * v))"
    s1, s0, s2 = (k.format(c=c, f=f) for f in ("(i - 1 - h)", "1", "(i - 1 - h) ** 2"))
    curve = f"(m * {s2} - q2 * {s0}) / (m * q4 - q2 * q2)"
    return f"CASE WHEN m < 3 THEN d{c} ELSE ({s1} / q2 + 2 * j * {curve}) / 0.1e0 END AS v{c}"


@query("track_velocity_savgol", "match_id player_id frame_id", "vx vy", "track_base track_step tracks", PLACED + f""",
       z AS (SELECT {KEYS}, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM r GROUP BY ALL),
       w AS (SELECT r.*, least(7, n - 1 + n % 2) AS m FROM r),
       o AS (SELECT *, m // 2 AS h, least(greatest(i - 1 - m // 2, 0), n - m) AS first FROM w),
       fit AS (SELECT o.*, i - 1 - first - h AS j, list_slice(xs, first + 1, first + m) AS lx, list_slice(ys, first + 1, first + m) AS ly,
             h * (h + 1) * (2 * h + 1) / 3e0 AS q2, h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15e0 AS q4,
             CASE WHEN n > 1 THEN (list_extract(xs, least(i + 1, n)) - list_extract(xs, greatest(i - 1, 1))) / (0.1e0 * (least(i + 1, n) - greatest(i - 1, 1))) END AS dx,
             CASE WHEN n > 1 THEN (list_extract(ys, least(i + 1, n)) - list_extract(ys, greatest(i - 1, 1))) / (0.1e0 * (least(i + 1, n) - greatest(i - 1, 1))) END AS dy
             FROM o JOIN z USING ({KEYS}))""",
       f"(SELECT match_id, player_id, frame_id, {slope('x')}, {slope('y')} FROM fit)")
def track_velocity_savgol(spark, sf_dir):
    return kinematics(spark, sf_dir, replace(CONFIG, estimator="savgol"))


def filtered(c: str, u: str) -> str:
    """SQL of one step of the second-order low-pass with memory (z1, z2) on input u."""
    y = f"(b0 * {u} + q.{c}1)"
    return f"{y} AS {c}, b1 * {u} - a1 * {y} + q.{c}2 AS {c}1, b2 * {u} - a2 * {y} AS {c}2"


def begun(c: str, u: str) -> str:
    """The same at the first input: the filter rests at it."""
    return f"{u} AS {c}, (b1 - a1 + b2 - a2) * {u} AS {c}1, (b2 - a2) * {u} AS {c}2"


@query("track_velocity_butter", "match_id player_id frame_id", "vx vy", "track_base track_step tracks", PLACED + f""",
       k AS (SELECT tan(pi() * 1.0e0 / 10) AS k), c AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * k * k / (1 + sqrt(2) * k + k * k) AS b1, k * k / (1 + sqrt(2) * k + k * k) AS b2,
             2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM k),
       z AS (SELECT {KEYS}, max(n) AS n, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM r WHERE n > 9 GROUP BY {KEYS}),
       j AS (SELECT *, unnest(range(0, n + 18)) AS j FROM z),
       e AS MATERIALIZED (SELECT {KEYS}, n, j,
             CASE WHEN j < 9 THEN 2 * xs[1] - xs[10 - j] WHEN j < n + 9 THEN xs[j - 8] ELSE 2 * xs[n] - xs[2 * n + 8 - j] END AS x,
             CASE WHEN j < 9 THEN 2 * ys[1] - ys[10 - j] WHEN j < n + 9 THEN ys[j - 8] ELSE 2 * ys[n] - ys[2 * n + 8 - j] END AS y FROM j),
       f AS (SELECT {KEYS}, n, j, {begun('fx', 'x')}, {begun('fy', 'y')} FROM e, c WHERE j = 0
             UNION ALL SELECT r.match_id, r.player_id, r.segment_id, r.n, r.j, {filtered('fx', 'r.x')}, {filtered('fy', 'r.y')} FROM f q JOIN e r ON {SAME} AND r.j = q.j + 1, c),
       fm AS MATERIALIZED (SELECT * FROM f),
       b AS (SELECT {KEYS}, n, j, {begun('bx', 'fx')}, {begun('by', 'fy')} FROM fm, c WHERE j = n + 17
             UNION ALL SELECT r.match_id, r.player_id, r.segment_id, r.n, r.j, {filtered('bx', 'r.fx')}, {filtered('by', 'r.fy')} FROM b q JOIN fm r ON {SAME} AND r.j = q.j - 1, c),
       s AS (SELECT r.*, coalesce(b.bx, r.x) AS sx, coalesce(b.by, r.y) AS sy FROM r LEFT JOIN b ON r.match_id = b.match_id AND r.player_id = b.player_id AND r.segment_id = b.segment_id AND b.j = r.i + 8),
       v AS (SELECT *, 0.1e0 * (least(i + 1, n) - greatest(i - 1, 1)) AS t, coalesce(lead(sx) OVER w, sx) - coalesce(lag(sx) OVER w, sx) AS ex, coalesce(lead(sy) OVER w, sy) - coalesce(lag(sy) OVER w, sy) AS ey
             FROM s WINDOW w AS (PARTITION BY {KEYS} ORDER BY i))""",
       "(SELECT match_id, player_id, frame_id, CASE WHEN n > 1 THEN ex / t END AS vx, CASE WHEN n > 1 THEN ey / t END AS vy FROM v)", recursive=True)
def track_velocity_butter(spark, sf_dir):
    return kinematics(spark, sf_dir, replace(CONFIG, estimator="butter"))


def corrected(c: str) -> str:
    return f"q.p{c} + 0.1e0 * q.v{c} + g0 * (r.{c} - q.p{c} - 0.1e0 * q.v{c}) AS p{c}, q.v{c} + g1 * (r.{c} - q.p{c} - 0.1e0 * q.v{c}) AS v{c}"


def smoothed(c: str) -> str:
    p, v = f"(q.s{c} - r.p{c} - 0.1e0 * r.v{c})", f"(q.w{c} - r.v{c})"
    return f"r.p{c} + r00 * {p} + r01 * {v} AS s{c}, r.v{c} + r10 * {p} + r11 * {v} AS w{c}"


@query("track_velocity_kalman", "match_id player_id frame_id", "vx vy", "track_base track_step tracks", PLACED + f""",
       p AS (SELECT 0 AS t, 1e0 AS p00, 0e0 AS p01, 1e0 AS p11, 0e0 AS g0, 0e0 AS g1
             UNION ALL SELECT t + 1, a00 - h0 * a00, a01 - h0 * a01, a11 - h1 * a01, h0, h1 FROM (SELECT *, a00 / (a00 + 0.15e0 ** 2) AS h0, a01 / (a00 + 0.15e0 ** 2) AS h1
             FROM (SELECT t, p00 + 0.2e0 * p01 + 0.01e0 * p11 + 9e0 * 0.0001e0 / 4 AS a00, p01 + 0.1e0 * p11 + 9e0 * 0.001e0 / 2 AS a01, p11 + 9e0 * 0.01e0 AS a11 FROM p WHERE t < 400))),
       o AS (SELECT *, p00 + 0.2e0 * p01 + 0.01e0 * p11 + 9e0 * 0.0001e0 / 4 AS a00, p01 + 0.1e0 * p11 + 9e0 * 0.001e0 / 2 AS a01, p11 + 9e0 * 0.01e0 AS a11 FROM p WHERE t = 400),
       c AS (SELECT g0, g1, ((p00 + 0.1e0 * p01) * a11 - p01 * a01) / (a00 * a11 - a01 * a01) AS r00, (-(p00 + 0.1e0 * p01) * a01 + p01 * a00) / (a00 * a11 - a01 * a01) AS r01,
             ((p01 + 0.1e0 * p11) * a11 - p11 * a01) / (a00 * a11 - a01 * a01) AS r10, (-(p01 + 0.1e0 * p11) * a01 + p11 * a00) / (a00 * a11 - a01 * a01) AS r11 FROM o),
       f AS (SELECT {KEYS}, frame_id, i, n, x AS px, 0e0 AS vx, y AS py, 0e0 AS vy FROM r WHERE i = 1
             UNION ALL SELECT r.match_id, r.player_id, r.segment_id, r.frame_id, r.i, r.n, {corrected('x')}, {corrected('y')} FROM f q JOIN r ON {SAME} AND r.i = q.i + 1, c),
       fm AS MATERIALIZED (SELECT * FROM f),
       b AS (SELECT {KEYS}, frame_id, i, n, px AS sx, vx AS wx, py AS sy, vy AS wy FROM fm WHERE i = n
             UNION ALL SELECT r.match_id, r.player_id, r.segment_id, r.frame_id, r.i, r.n, {smoothed('x')}, {smoothed('y')} FROM b q JOIN fm r ON {SAME} AND r.i = q.i - 1, c)""",
       "(SELECT match_id, player_id, frame_id, CASE WHEN n > 1 THEN wx END AS vx, CASE WHEN n > 1 THEN wy END AS vy FROM b)", recursive=True)
def track_velocity_kalman(spark, sf_dir):
    return kinematics(spark, sf_dir, replace(CONFIG, estimator="kalman"))


@query("archive_frames", "match_id frames players rejects", "sum_x", "track_base track_step tracks", "",
       "(SELECT match_id, count(DISTINCT frame_id) AS frames, count(*) AS players, 0::BIGINT AS rejects, sum(x) AS sum_x FROM tracks WHERE match_id <> 'm1' GROUP BY 1)")
def archive_frames(spark, sf_dir):
    """Tracking written as one file a match below the shared folder, read back by the archive source without one match."""
    root = fresh_path(spark, "archive")
    player = F.struct("player_id", "x", "y", "is_detected")
    frames = tracks(spark, sf_dir).groupBy("match_id", "frame_id").agg(F.collect_list(player).alias("player_data"))
    line = F.to_json(F.struct(F.col("frame_id").alias("frame"), F.lit(1).alias("period"), "player_data"))
    archive.written(frames.withColumn("line", line), root, "tracking.jsonl", order="frame_id").agg(F.sum("bytes")).collect()
    own = archive.typed_frames(archive.archive(spark, root).filter("kind = 'tracking' and match_id <> 'm1'"))
    own = own.select("match_id", "frame", "rejects", F.explode("player_data").alias("p"))
    return own.groupBy("match_id").agg(F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("players"), F.sum("rejects").alias("rejects"), F.sum("p.x").alias("sum_x"))


@query("estimator_sensitivity", "estimator n", "mean_speed mean_absolute_acceleration")
def estimator_sensitivity(spark, sf_dir):
    out = None
    for name in ("trailing_mean", "central", "savgol", "butter", "kalman"):
        own = kinematics(spark, sf_dir, replace(CONFIG, estimator=name)).agg(F.count("speed_mps").alias("n"), F.avg("speed_mps").alias("mean_speed"), F.avg(F.abs("acceleration_mps2")).alias("mean_absolute_acceleration"))
        own = own.withColumn("estimator", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query("match_coverage", "match_id frames player_rows", "bip_frame_weighted_pct bip_player_weighted_pct detected_share", "track_base track_step tracks",
       "b AS (SELECT *, player_id LIKE '%7' AS ball FROM tracks)",
       """(SELECT match_id, count(*) FILTER (ball) AS frames, count(*) FILTER (NOT ball) AS player_rows, count(*) FILTER (ball AND ball_state = 'alive') / nullif(count(*) FILTER (ball), 0) * 100 AS bip_frame_weighted_pct,
       count(*) FILTER (NOT ball AND ball_state = 'alive') / nullif(count(*) FILTER (NOT ball), 0) * 100 AS bip_player_weighted_pct, count(*) FILTER (NOT ball AND is_detected) / nullif(count(*) FILTER (NOT ball), 0) AS detected_share FROM b GROUP BY 1)""")  # fmt: skip
def match_coverage(spark, sf_dir):
    return Y.coverage(tracks(spark, sf_dir).withColumn("ball", F.col("player_id").endswith("7")))


# --- populations, profiles, league ------------------------------------------------------------------------------------
@query("qualified_outfield", "match_id player_id n", "played_minutes", "performances",
       "g AS (SELECT * FROM performances WHERE played_minutes >= 60 AND position_group <> 'Goalkeeper')",
       "(SELECT match_id, player_id, count(*) AS n, sum(played_minutes) AS played_minutes FROM g WHERE player_id IN (SELECT player_id FROM g GROUP BY 1 HAVING count(DISTINCT match_id) >= 2) GROUP BY 1, 2)")
def qualified_outfield(spark, sf_dir):
    return Y.qualified_outfield(performances(spark, sf_dir)).groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("played_minutes").alias("played_minutes"))


PROFILES = """m AS (SELECT player_id, position_group FROM performances WHERE position_group IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, position_group) = 1),
z AS (SELECT player_id, min(player_name) AS player_name, count(DISTINCT match_id) AS matches, sum(played_minutes) AS played_minutes, sum(total_distance_m) * 60 / nullif(sum(bip_minutes), 0) AS total_distance_m_p60_bip,
sum(sprint_count) * 60 / nullif(sum(bip_minutes), 0) AS sprint_count_p60_bip, sum(distance_tip_m) * 30 / nullif(sum(tip_minutes), 0) AS distance_tip_m_p30_tip, max(psv99_kmh) AS psv99_kmh, max(max_speed_kmh) AS max_speed_kmh FROM performances GROUP BY 1),
w AS (SELECT z.*, m.position_group FROM z LEFT JOIN m USING (player_id))"""


@query("season_profiles", "player_id player_name position_group matches", "played_minutes total_distance_m_p60_bip sprint_count_p60_bip distance_tip_m_p30_tip psv99_kmh max_speed_kmh", "performances", PROFILES, "w")
def season_profiles(spark, sf_dir):
    return Y.profiles(performances(spark, sf_dir))


@query("group_percentiles", "player_id", "psv99_kmh_pct", "performances", PROFILES,
       """(SELECT player_id, CASE WHEN psv99_kmh IS NOT NULL THEN (rank() OVER (PARTITION BY position_group ORDER BY psv99_kmh) + (count(*) OVER (PARTITION BY position_group, psv99_kmh) - 1) / 2e0) / count(psv99_kmh) OVER (PARTITION BY position_group) * 100 END AS psv99_kmh_pct FROM w)""")  # fmt: skip
def group_percentiles(spark, sf_dir):
    return Y.group_percentiles(Y.profiles(performances(spark, sf_dir)), ["psv99_kmh"])


@query("p60_rates", "match_id player_id n", "total_distance_m_p60_bip", "performances", "",
       """(SELECT match_id, player_id, count(*) AS n, sum(total_distance_m * 60 / bip_minutes) AS total_distance_m_p60_bip FROM performances WHERE bip_minutes > 0 AND bip_minutes <= played_minutes + 1 GROUP BY 1, 2)""")  # fmt: skip
def p60_rates(spark, sf_dir):
    own = Y.p60_rates(performances(spark, sf_dir), ["total_distance_m"])
    return own.groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_distance_m_p60_bip").alias("total_distance_m_p60_bip"))


LEAGUE = """e AS (SELECT * FROM performances WHERE played_minutes >= 60), o AS (SELECT * FROM e WHERE position_group <> 'Goalkeeper'),
a AS (SELECT 'all' AS population, * FROM e UNION ALL SELECT 'outfield', * FROM o), pm AS (SELECT population, season_name, player_id, avg(hsr_distance_m) AS m FROM a GROUP BY 1, 2, 3),
lg AS (SELECT population, 'performance_weighted' AS weighting, season_name, count(DISTINCT player_id) AS n_players, count(*) AS n_performances, avg(hsr_distance_m) AS hsr_distance_m FROM a GROUP BY 1, 3
UNION ALL SELECT c.population, 'player_weighted', c.season_name, c.n_players, c.n_performances, p.m FROM
(SELECT population, season_name, count(DISTINCT player_id) AS n_players, count(*) AS n_performances FROM a GROUP BY 1, 2) c JOIN (SELECT population, season_name, avg(m) AS m FROM pm GROUP BY 1, 2) p USING (population, season_name))"""


@query("league_variants", "population weighting season_name n_players n_performances", "hsr_distance_m", "performances", LEAGUE, "lg")
def league_variants(spark, sf_dir):
    return Y.league_variants(performances(spark, sf_dir), ["hsr_distance_m"], ["season_name"])


@query("league_dispersion", "season_name n_players n_performances", "psv99_kmh psv99_kmh_sd psv99_kmh_se", "performances", "o AS (SELECT * FROM performances WHERE played_minutes >= 60 AND position_group <> 'Goalkeeper')",
       """(SELECT season_name, count(DISTINCT player_id) AS n_players, count(*) AS n_performances, avg(psv99_kmh) AS psv99_kmh, stddev_samp(psv99_kmh) AS psv99_kmh_sd, stddev_samp(psv99_kmh) / sqrt(count(*)) AS psv99_kmh_se FROM o GROUP BY 1)""")  # fmt: skip
def league_dispersion(spark, sf_dir):
    return Y.league(performances(spark, sf_dir), ["psv99_kmh"], ["season_name"], dispersion=True)


@query("league_benchmark", "season_name metric", "ours published difference relative", "performances", "o AS (SELECT season_name, avg(psv99_kmh) AS ours FROM performances WHERE played_minutes >= 60 AND position_group <> 'Goalkeeper' GROUP BY 1)",
       "(SELECT season_name, 'psv99_kmh' AS metric, ours, CASE season_name WHEN 's0' THEN 20 END AS published, ours - CASE season_name WHEN 's0' THEN 20 END AS difference, (ours - CASE season_name WHEN 's0' THEN 20 END) / 20 AS relative FROM o)")
def league_benchmark(spark, sf_dir):
    ours = Y.league(performances(spark, sf_dir), ["psv99_kmh"], ["season_name"])
    return Y.benchmark(ours, ["psv99_kmh"], ["season_name"], spark.createDataFrame([("s0", "psv99_kmh", 20.0)], "season_name string, metric string, value double"))


@query("position_groups", "label position_group resolved n", "", "",
       "p AS (SELECT CASE n_nationkey % 9 WHEN 0 THEN 'Goal Keeper' WHEN 1 THEN 'LCB' WHEN 2 THEN 'Left Wing Back' WHEN 3 THEN 'Right_Winger' WHEN 4 THEN ' defensive midfield' WHEN 5 THEN 'CF' WHEN 6 THEN 'sub' WHEN 7 THEN 'Libero' ELSE 'full-back' END AS label FROM nation)",
       """(SELECT label, CASE trim(label) WHEN 'Goal Keeper' THEN 'Goalkeeper' WHEN 'LCB' THEN 'Central Defender' WHEN 'Left Wing Back' THEN 'Full Back' WHEN 'Right_Winger' THEN 'Winger' WHEN 'defensive midfield' THEN 'Midfield' WHEN 'CF' THEN 'Forward' WHEN 'sub' THEN NULL WHEN 'Libero' THEN 'Libero' ELSE 'Full Back' END AS position_group,
       CASE trim(label) WHEN 'Goal Keeper' THEN 'Goalkeeper' WHEN 'LCB' THEN 'Central Defender' WHEN 'Left Wing Back' THEN 'Full Back' WHEN 'Right_Winger' THEN 'Winger' WHEN 'defensive midfield' THEN 'Midfield' WHEN 'CF' THEN 'Forward' WHEN 'sub' THEN 'Midfield' WHEN 'Libero' THEN 'Libero' ELSE 'Full Back' END AS resolved, count(*) AS n FROM p GROUP BY 1)""")  # fmt: skip
def position_groups(spark, sf_dir):
    names = ["Goal Keeper", "LCB", "Left Wing Back", "Right_Winger", " defensive midfield", "CF", "sub", "Libero", "full-back"]
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 9 + 1).cast("int")).alias("label"))
    out = own.withColumns({"position_group": Y.position_group(F.col("label")), "resolved": Y.resolved_group(F.col("label"), F.lit("CM"))})
    return out.groupBy("label", "position_group", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query("played_time_sources", "player_id played_time_source", "played_seconds", "performances",
       "b AS (SELECT player_id, CASE WHEN o % 3 = 0 THEN o * 1e0 WHEN o % 3 = 1 THEN -1 END AS ms, CASE WHEN o % 2 = 0 THEN 5e0 END AS a, 9e0 AS z FROM (SELECT player_id, substr(player_id, 2)::BIGINT AS o FROM performances GROUP BY 1))",
       "(SELECT player_id, CASE WHEN ms > 0 THEN 'provider_playing_time' WHEN z > a THEN 'appearance_interval' ELSE 'observed_tracking' END AS played_time_source, CASE WHEN ms > 0 THEN ms / 1000 WHEN z > a THEN z - a ELSE 11 END AS played_seconds FROM b)")
def played_time_sources(spark, sf_dir):
    own = performances(spark, sf_dir).select("player_id").distinct().withColumn("o", F.expr("bigint(substr(player_id, 2))"))
    own = own.selectExpr("player_id", "CASE WHEN o % 3 = 0 THEN double(o) WHEN o % 3 = 1 THEN -1D END AS provider_playing_time_ms", "CASE WHEN o % 2 = 0 THEN 5D END AS appearance_start_seconds", "9D AS appearance_end_seconds",
                         "11D AS observed_seconds", "1D AS valid_seconds", "1D AS bip_seconds", "1D AS tip_seconds", "1D AS otip_seconds", "2 AS segment_count", "1 AS period_count")
    return Y.with_played_time(own)


@query("label_picks", "player_id", "distance", "performances", PROFILES + """,
       q AS (SELECT quantile_cont(psv99_kmh, 0.5) AS mx, stddev_samp(psv99_kmh) AS sx, quantile_cont(played_minutes, 0.5) AS my, stddev_samp(played_minutes) AS sy FROM w)""",
       "(SELECT player_id, round(sqrt(((psv99_kmh - mx) / sx) ** 2 + ((played_minutes - my) / sy) ** 2), 9) AS distance FROM w, q ORDER BY distance DESC, player_id LIMIT 8)")
def label_picks(spark, sf_dir):
    return R.farthest_from_middle(Y.profiles(performances(spark, sf_dir)), "psv99_kmh", "played_minutes", 8, ["player_id"])


# --- playback -----------------------------------------------------------------------------------------------------------
@query("sync_shifts", "original_event_id", "delta_start delta_end delta_max", "actions", """s AS (SELECT event_id AS original_event_id, sqrt((start_x - end_x) ** 2 + (start_y - end_y) ** 2) AS delta_start, CASE WHEN event_id % 5 <> 0 THEN abs(end_y - start_y) END AS delta_end FROM actions)""",
       "(SELECT *, greatest(delta_start, delta_end) AS delta_max FROM s ORDER BY delta_max DESC NULLS LAST, delta_end DESC NULLS LAST, delta_start DESC NULLS LAST, original_event_id LIMIT 20)")
def sync_shifts(spark, sf_dir):
    own = actions(spark, sf_dir).select(
        F.col("event_id").alias("original_event_id"), "start_x", "start_y", F.col("end_x").alias("start_x_synced"), F.col("end_y").alias("start_y_synced"),
        F.lit(0.0).alias("end_x"), "end_y", F.when(F.expr("event_id % 5 <> 0"), 0.0).alias("end_x_synced"), F.col("start_y").alias("end_y_synced"),
    )
    return N.ranked_shifts(own)


@query("frame_window", "frame_id", "p0_x p0_y p1_x ball_x", "track_base track_step tracks", "",
       """(SELECT frame_id, round(min(x) FILTER (player_id = 'p0') + 52.5, 2) AS p0_x, round(min(y) FILTER (player_id = 'p0') + 34, 2) AS p0_y, round(min(x) FILTER (player_id = 'p1') + 52.5, 2) AS p1_x,
       round(min(x) FILTER (player_id = 'p7') + 52.5, 2) AS ball_x FROM tracks WHERE match_id = 'm0' AND frame_id BETWEEN 5 AND 20 GROUP BY 1)""")  # fmt: skip
def frame_window(spark, sf_dir):
    own = tracks(spark, sf_dir).filter("match_id = 'm0'").withColumns({"ball": F.col("player_id") == "p7", "period": F.lit("1"), "object_id": F.col("player_id")})
    return N.frame_window(own, "1", 5, 20, ["p0", "p1"])


@query("every_third_frame", "player_id frame_id", "", "track_base track_step tracks", "", "(SELECT player_id, frame_id FROM tracks WHERE (frame_id - 1) % 3 = 0)")
def every_third_frame(spark, sf_dir):
    return N.every_kth(tracks(spark, sf_dir), 3, ["player_id"], ["frame_id"])


@query("objects_in_play", "player_id first last", "", "track_base track_step tracks", "k AS (SELECT * REPLACE (CASE WHEN frame_id % 6 > 2 THEN x END AS x) FROM tracks)",
       "(SELECT player_id, min(frame_id) AS first, max(frame_id) AS last FROM k WHERE x IS NOT NULL GROUP BY 1)")
def objects_in_play(spark, sf_dir):
    return N.in_play(tracks(spark, sf_dir).withColumn("x", F.when(F.col("frame_id") % 6 > 2, F.col("x"))), ["player_id"])


@query("turn_candidates", "match_id player_id at", "angle")
def turn_candidates(spark, sf_dir):
    config = replace(CONFIG, estimator="central")
    own = tracks(spark, sf_dir).withColumn("y", F.when(F.col("frame_id") % 20 < 10, F.col("frame_id") % 20 * 0.5).otherwise((20 - F.col("frame_id") % 20) * 0.5))
    own = T.with_kinematics(T.with_segments(T.with_live(own), config.max_gap_seconds), config)
    return X.turns(own, X.ExplosiveConfig(), config.dt)


@query("rate_sensitivity", "match_id player_id rate sample_count", "total_distance_m max_speed_kmh", "track_base track_step tracks", KINEMATICS + """,
       z AS (SELECT match_id, player_id, count(*) AS sample_count, coalesce(sum(step) FILTER (valid AND bip), 0) AS total_distance_m, max(speed) * 3.6e0 AS max_speed_kmh FROM k GROUP BY 1, 2)""",
       "(SELECT *, 'common' AS rate FROM z UNION ALL SELECT *, 'native' FROM z)")
def rate_sensitivity(spark, sf_dir):
    return W.rate_sensitivity(tracks(spark, sf_dir))


@query("band_composition", "position_group", "running_distance_m_p60_bip hsr_distance_m_p60_bip sprint_distance_m_p60_bip", "performances", "",
       "(SELECT position_group, avg(total_distance_m) AS running_distance_m_p60_bip, avg(hsr_distance_m) AS hsr_distance_m_p60_bip, avg(sprint_count) AS sprint_distance_m_p60_bip FROM performances GROUP BY 1)")
def band_composition(spark, sf_dir):
    own = performances(spark, sf_dir).withColumnsRenamed({"total_distance_m": "running_distance_m_p60_bip", "hsr_distance_m": "hsr_distance_m_p60_bip", "sprint_count": "sprint_distance_m_p60_bip"})
    return R.band_composition(own)


@query("lineup_enriched", "match_id player_id position_group position_group_lineup uniform_number n", "", "performances",
       "l AS (SELECT match_id, player_id, min(o_orderkey) AS uniform_number FROM (SELECT 'm' || (o_orderkey % 64) AS match_id, 'p' || o_custkey AS player_id, o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1, 2)",
       """(SELECT p.match_id, p.player_id, p.position_group, CASE WHEN l.player_id IS NOT NULL THEN 'bench' END AS position_group_lineup, l.uniform_number, count(*) AS n FROM performances p LEFT JOIN l ON p.match_id = l.match_id AND p.player_id = l.player_id GROUP BY ALL)""")  # fmt: skip
def lineup_enriched(spark, sf_dir):
    lineup = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 2 = 0").selectExpr("'m' || (o_orderkey % 64) AS match_id", "'p' || o_custkey AS player_id", "o_orderkey")
    lineup = lineup.groupBy("match_id", "player_id").agg(F.min("o_orderkey").alias("uniform_number"), F.lit("bench").alias("position_group"))
    out = W.enriched(performances(spark, sf_dir), lineup)
    return out.groupBy("match_id", "player_id", "position_group", "position_group_lineup", "uniform_number").agg(F.count(F.lit(1)).alias("n"))


@query("player_frame_labels", "player_id passes", "", "performances", """
       z AS (SELECT player_id, season_name, count(*) AS passes, min(position_group) AS g FROM performances GROUP BY 1, 2), f AS (SELECT * FROM z WHERE season_name = 's1' AND passes >= 2),
       t AS (FROM f ORDER BY passes DESC, player_id LIMIT 6), u AS (FROM f ORDER BY player_id LIMIT 6)""",
       "(SELECT player_id, passes FROM t UNION SELECT player_id, passes FROM u)")
def player_frame_labels(spark, sf_dir):
    own = performances(spark, sf_dir).groupBy("player_id", "season_name").agg(F.count(F.lit(1)).alias("passes"), F.min("position_group").alias("player_position"))
    own = R.player_frame(own, "s1", 2)
    return R.labelled_once(own.orderBy(F.desc("passes"), "player_id").limit(6), own.orderBy("player_id").limit(6), ["player_id"])


@query("seeded_sample", "event_id")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(actions(spark, sf_dir), "event_id", 50)
