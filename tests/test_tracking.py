"""Trajectories with known answers."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import efforts as E
from pitchframe.operators import explosive as X
from pitchframe.operators import physical as Y
from pitchframe.operators import tracking as T

CONFIG = T.TrackingConfig()
ROW = "match_id string, period_id int, frame_id long, timestamp double, player_id string, x double, y double, ball_state string, ball_owning_team_id string, team_id string"


def line(spark, speed, seconds=10.0, hz=10.0, times=None, state=lambda t: "alive", period=1, player="a", start=0.0, owner="1", team="1"):
    times = [i / hz for i in range(round(seconds * hz) + 1)] if times is None else times
    rows = [("m", period, i, float(t), player, start + speed * t, 0.0, state(t), owner, team) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, ROW)


def blocks(spark, parts, dt=0.1):
    """Kinematics given as (km/h, samples) blocks; each number of a part's third item opens a new segment."""
    rows, n, segment = [], 0, 1
    for part in parts:
        speed, count = part[:2]
        segment += len(part) > 2
        for _ in range(count):
            rows.append(("m", "a", 1, segment, n * dt, speed / 3.6, True))
            n += 1
    return spark.createDataFrame(rows, "match_id string, player_id string, period_id int, segment_id long, timestamp double, speed_mps double, is_bip boolean")


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("speed,distance,running", [(0.0, 0.0, 0.0), (5.0, 50.0, 50.0)])
def test_constant_speed(spark, speed, distance, running):
    r = one(Y.player_matches(T.prepared(line(spark, speed))))
    assert r["total_distance_m"] == pytest.approx(distance) and r["running_distance_m"] == pytest.approx(running)


def test_ball_rows_go_and_aliases_are_resolved(spark):
    rows = [("m", 1, t, o, x, 0.0, o == "ball") for t, x in ((0.0, 0.0), (0.1, 0.5), (0.2, 1.0)) for o in ("ball", "7")]
    df = spark.createDataFrame(rows, "game_id string, period int, time_seconds double, object_id string, x double, y double, is_ball boolean")
    out = T.prepared(df.withColumn("ball_state", F.lit("In_Play ")))
    r = one(Y.player_matches(out))
    assert r["player_id"] == "7" and r["total_distance_m"] == pytest.approx(1.0)
    assert one(out.select("bip_source"))[0] == "ball_state"


def test_resampled_to_the_common_rate(spark):
    out = T.prepared(line(spark, 5.0, 3.0, hz=30.0))
    steps = [r["dt"] for r in out.filter("dt is not null").collect()]
    assert steps and all(s == pytest.approx(0.1) for s in steps)
    assert one(Y.player_matches(out))["total_distance_m"] == pytest.approx(15.0)
    assert one(out.select("effective_sample_hz"))[0] == 10.0


def test_an_uneven_native_grid_is_refused(spark):
    with pytest.raises(ValueError, match="uniform"):
        T.prepared(line(spark, 5.0, times=[0, 0.07, 0.20, 0.31, 0.50]), replace(CONFIG, target_hz=None))


def test_long_gaps_split_segments(spark):
    r = one(Y.player_matches(T.prepared(line(spark, 5.0, times=[0, 0.1, 0.2, 1.0, 1.1]))))
    assert r["total_distance_m"] == pytest.approx(1.5) and r["segment_count"] == 2 and r["gap_count"] == 1


def test_periods_split_segments(spark):
    both = line(spark, 7.0, 1.0).unionByName(line(spark, 7.0, 1.0, period=2, start=1000.0))
    r = one(Y.player_matches(T.prepared(both)))
    assert r["total_distance_m"] == pytest.approx(14.0) and r["sprint_count"] == 2 and r["segment_count"] == 2 and r["gap_count"] == 0


def test_rows_outside_the_appearance_go(spark):
    lineup = spark.createDataFrame([("m", "a", 2.0, 8.0)], "match_id string, player_id string, appearance_start_seconds double, appearance_end_seconds double")
    r = one(Y.player_matches(T.prepared(line(spark, 5.0), lineup=lineup)))
    assert r["total_distance_m"] == pytest.approx(30.0) and r["played_seconds"] == pytest.approx(6.0) and r["played_time_source"] == "appearance_interval"
    with pytest.raises(ValueError):
        T.prepared(line(spark, 5.0), lineup=lineup.unionByName(lineup))


@pytest.mark.parametrize("ms,minutes", [(3_600_000.0, 60.0), (-1.0, 10 / 60)])
def test_provider_time_counts_if_it_is_positive(spark, ms, minutes):
    lineup = spark.createDataFrame([("m", "a", ms)], "match_id string, player_id string, provider_playing_time_ms double")
    assert one(Y.player_matches(T.prepared(line(spark, 5.0), lineup=lineup)))["played_minutes"] == pytest.approx(minutes)


def test_dead_play_is_left_out(spark):
    r = one(Y.player_matches(T.prepared(line(spark, 5.0, state=lambda t: "dead" if t > 5.0 + 1e-9 else "alive"))))
    assert r["total_distance_m"] == pytest.approx(25.0) and r["bip_seconds"] == pytest.approx(5.0)
    assert r["total_distance_m_p60_bip"] == pytest.approx(18000.0) and r["total_distance_all_m"] == pytest.approx(50.0)


def test_phases_need_numeric_owners(spark):
    r = one(Y.player_matches(T.prepared(line(spark, 5.0, owner="2"))))
    assert (r["tip_seconds"], r["otip_seconds"]) == (0.0, pytest.approx(10.0))
    r = one(Y.player_matches(T.prepared(line(spark, 5.0, owner="home"))))
    assert (r["tip_seconds"], r["otip_seconds"]) == (0.0, 0.0)


def n_efforts(df, kmh=20.0, least=0.7, dip=0.0, rule="samples"):
    return E.efforts(df, F.col("speed_mps") > kmh * T.KMH, 0.1, least, dip, rule).count()


def test_short_runs_are_no_efforts(spark):
    assert n_efforts(blocks(spark, [(10, 5), (26, 6), (10, 5), (22, 7), (10, 5), (26, 7), (10, 3)])) == 2


@pytest.mark.parametrize("parts,dip,found", [
    ([(22, 5), (10, 2), (22, 5)], 0.0, 0), ([(22, 5), (10, 2), (22, 5)], 0.2, 1), ([(22, 5), (10, 4), (22, 5)], 0.2, 0),
    ([(22, 4), (10, 1), (22, 2)], 0.1, 0), ([(22, 4), (10, 1), (22, 3)], 0.1, 1),
    ([(22, 8), (22, 8, "new")], 0.0, 2), ([(22, 4), (22, 4, "new")], 0.0, 0),
])
def test_dips_and_segments(spark, parts, dip, found):
    assert n_efforts(blocks(spark, parts), dip=dip) == found


def test_duration_rules(spark):
    seven, eight = blocks(spark, [(10, 2), (22, 7), (10, 2)]), blocks(spark, [(10, 2), (22, 8), (10, 2)])
    assert [n_efforts(seven, rule="samples"), n_efforts(seven, rule="span"), n_efforts(eight, rule="span")] == [1, 0, 1]


def test_live_share_covers_the_whole_effort(spark):
    df = blocks(spark, [(22, 10)]).withColumn("is_bip", F.col("timestamp") < 0.15)
    shares = one(E.efforts(df, F.col("speed_mps") > 20 * T.KMH, 0.1, 0.7, shares={"live": F.col("is_bip")}))
    assert shares["live_share"] == pytest.approx(0.2)
    assert E.counted(df, F.col("speed_mps") > 20 * T.KMH, CONFIG, {"": F.col("is_bip")}, "n").first()["n"] == 0


@pytest.mark.parametrize("kmh,band", [(15.0, "running"), (20.0, "hsr"), (25.0, "hsr"), (25.01, "sprint"), (14.9, "low")])
def test_band_edges(spark, kmh, band):
    flags = Y.speed_bands(F.lit(kmh / 3.6), CONFIG)
    r = one(spark.range(1).select(*[v.alias(k) for k, v in flags.items()]))
    assert r[band] and sum(r[k] for k in ("low", "running", "hsr", "sprint")) == 1


def test_peaks_and_their_percentile(spark):
    def peaks(*kmh):
        return blocks(spark, [x for v in kmh for x in ((v, 1), (10, 1))])

    found = E.peak_percentile(peaks(18, 22, 30), CONFIG, "speed_mps")
    assert one(found)["psv99_kmh"] == pytest.approx(29.84)
    assert one(E.peak_percentile(peaks(39, 41), CONFIG, "speed_mps"))["psv99_kmh"] == pytest.approx(39.0)
    assert E.peak_percentile(peaks(14.4), CONFIG, "speed_mps").count() == 0
    assert sorted(round(r["peak"] * 3.6, 6) for r in E.peaks(blocks(spark, [(18, 1), (21.6, 1), (0, 1), (25.2, 1), (28.8, 1)]), CONFIG, "speed_mps").collect()) == [21.6, 28.8]


def test_implausible_speeds_are_null_never_cut(spark):
    rows = [("m", "a", 1, 1, i * 0.1, x, 0.0, True) for i, x in enumerate([0.0, 0.5, 1.0, 1.5, 1.5 + 50 / 36])]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period_id int, segment_id long, timestamp double, x double, y double, is_bip boolean")
    out = T.with_kinematics(df, replace(CONFIG, estimator="central", max_speed_kmh=37.0)).orderBy("timestamp").collect()
    assert out[-1]["capped_speed"] and out[-1]["speed_mps"] is None and not out[0]["capped_speed"]


@pytest.mark.parametrize("estimator", ["trailing_mean", "central", "savgol", "butter", "kalman"])
def test_estimators_find_a_constant_speed(spark, estimator):
    out = T.prepared(line(spark, 5.0, 12.0), replace(CONFIG, estimator=estimator))
    middle = [r["speed_mps"] for r in out.filter("timestamp between 3 and 9").collect()]
    assert len(middle) > 50 and np.allclose(middle, 5.0, atol=1e-2)


def test_polynomial_derivative_is_exact_for_its_degree(spark):
    rows = [("m", "a", 1, 1, float(i) / 10, 3 * (i / 10) ** 2 - i / 10, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period_id int, segment_id long, timestamp double, x double, y double")
    found = [r["v"] for r in df.withColumn("v", T.savgol_velocity("x", 7, 2, 0.1)).orderBy("timestamp").collect()]
    assert np.allclose(found, 6 * np.arange(20) * 0.1 - 1)
    b, a = T.low_pass(2, 1.0, 10.0)
    assert b.sum() / a.sum() == pytest.approx(1.0)


def test_explosive_effort_from_walking_to_high_speed(spark):
    v = np.concatenate([np.full(20, 1.0), np.linspace(1.0, 7.5, 18), np.full(20, 7.5)])
    x = np.concatenate([[0.0], np.cumsum(v[1:]) * 0.1])
    rows = [("m", "a", 1, i * 0.1, float(p), 0.0, "alive") for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period_id int, timestamp double, x double, y double, ball_state string")
    config = replace(CONFIG, estimator="central")
    found = {r["target"]: r for r in X.explosive_efforts(T.prepared(df, config), config).filter("family = 'time_to_speed'").collect()}
    assert set(found) == {"hsr", "sprint"} and 0 < found["hsr"]["seconds"] < found["sprint"]["seconds"] < 5
    assert found["hsr"]["bip_share"] == 1.0


def test_league_counts_qualified_outfield_rows(spark):
    rows = [(f"m{i}", "p1", "Midfield", 60.0, 8000.0) for i in range(5)] + [(f"m{i}", "p2", "Forward", 60.0, 8000.0) for i in range(4)]
    rows += [("m9", "p3", "Forward", 59.0, 1.0), ("m9", "p4", "Goalkeeper", 90.0, 1.0), ("m9", "p5", None, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, position_group string, played_minutes double, v double").withColumn("season_name", F.lit("s"))
    r = one(Y.league(df, ["v"], ["season_name"]))
    assert (r["n_players"], r["n_performances"], r["v"]) == (2, 9, 8000.0)
    assert Y.league_variants(df, ["v"], ["season_name"]).count() == 4


def test_rates_refuse_peaks_and_drop_bad_exposure(spark):
    df = spark.createDataFrame([("m", "a", 60.0, 30.0, 100.0), ("m", "b", 60.0, 0.0, 1.0), ("m", "c", 60.0, 90.0, 1.0)], "match_id string, player_id string, played_minutes double, bip_minutes double, d double")
    assert [r["d_p60_bip"] for r in Y.p60_rates(df, ["d"]).collect()] == [200.0]
    with pytest.raises(ValueError):
        Y.p60_rates(df, ["psv99_kmh"])
    with pytest.raises(ValueError):
        Y.p60_rates(df, ["d"], on_invalid="raise")


def test_settings_are_checked():
    for bad in ({"estimator": "none"}, {"sample_hz": 0.0}, {"max_speed_kmh": 20.0}, {"psv_percentile": 0.0}, {"butter_cutoff_hz": 9.0}):
        with pytest.raises(ValueError):
            replace(CONFIG, **bad)


def brute_explosive(rows, config, dt):
    """(family, target, onset, end) of one track by plain loops; rows: (time, segment, speed, acceleration, heading, valid)."""
    walk, out, n = config.walk_kmh / 3.6, [], max(2, round(config.heading_seconds / dt))

    def crossing(i, limit):
        (t0, _, v0, *_), (t, _, v, *_) = rows[i - 1], rows[i]
        return t0 + (limit - v0) / max(v - v0, 1e-12) * (t - t0) if i and v0 is not None and v is not None and v0 < limit <= v else None

    def following(at, limit):
        return next(((i, crossing(i, limit)) for i in range(at + 1, len(rows)) if crossing(i, limit) is not None), None)

    starts = []
    on = [bool(r[5] and r[3] is not None and r[3] > config.acceleration_mps2) for r in rows]
    for i, r in enumerate(rows):
        if on[i] and not (i and on[i - 1] and rows[i - 1][1] == r[1]):
            end = next((j for j in range(i, len(rows)) if not on[j] or rows[j][1] != r[1]), len(rows))
            slow = [j for j in range(i + 1) if rows[j][1] == r[1] and rows[j][0] >= r[0] - config.lookback_seconds - 1e-7 and rows[j][2] is not None and rows[j][2] < walk]
            if (end - i) * dt >= config.acceleration_seconds - 1e-9 and slow and (onset := following(slow[-1], walk)):
                starts.append(("time_to_speed", *onset, rows[onset[0]][1]))
    mean = lambda part: np.arctan2(np.mean([np.sin(r[4]) for r in part]), np.mean([np.cos(r[4]) for r in part]))
    sharp = []
    for i in range(n, len(rows) - n):
        pre, post = rows[i - n : i], rows[i + 1 : i + n + 1]
        if all(r[5] and r[2] >= walk for r in pre + post) and pre[0][1] == post[-1][1]:
            d = mean(pre) - mean(post)
            angle = np.degrees(abs(np.arctan2(np.sin(d), np.cos(d))))
            if angle >= config.turn_degrees:
                new = not sharp or i - sharp[-1][-1][0] >= max(1, round(config.cooldown_seconds / dt))
                sharp = [*sharp, []] if new else sharp
                sharp[-1].append((i, angle))
    for cluster in sharp:
        at = max(cluster, key=lambda c: (c[1], -c[0]))[0]
        fast = next((j for j in range(at, len(rows)) if rows[j][1] == rows[at][1] and rows[j][2] is not None and rows[j][2] >= walk), None)
        if fast is not None:
            starts.append(("post_cod_time_to_speed", fast, rows[fast][0], rows[at][1]))
    for family, at, onset, segment in starts:
        for target, kmh in (("hsr", config.hsr_kmh), ("sprint", config.sprint_kmh)):
            hit = following(at, kmh / 3.6)
            if hit and rows[hit[0]][1] == segment and hit[1] - onset <= config.most_seconds + 1e-9:
                out.append((family, target, round(onset, 6), round(hit[1], 6)))
    return sorted(out)


def test_explosive_efforts_against_plain_loops(spark):
    rng, rows = np.random.default_rng(5), []
    for player in ("a", "b", "c"):
        speed = np.abs(np.cumsum(rng.normal(0, 0.45, 900)))
        speed = np.where(speed > 9, 18 - speed, speed).clip(0, 9)
        heading = np.cumsum(rng.normal(0, 0.25, 900) + (rng.random(900) < 0.03) * rng.uniform(-2.5, 2.5, 900))
        x, y = np.cumsum(speed * np.cos(heading) * 0.1), np.cumsum(speed * np.sin(heading) * 0.1)
        rows += [("m", player, 1, round(i * 0.1 + 5 * (i > 500), 3), float(x[i]), float(y[i]), "alive") for i in range(900)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period_id int, timestamp double, x double, y double, ball_state string")
    physical, config = replace(CONFIG, estimator="central"), X.ExplosiveConfig(acceleration_mps2=1.0, acceleration_seconds=0.3)
    frame = T.prepared(df, physical)
    found, wanted = X.explosive_efforts(frame, physical, config).collect(), []
    for player in ("a", "b", "c"):
        track = frame.filter(F.col("player_id") == player).orderBy("timestamp").select("timestamp", "segment_id", "speed_mps", "acceleration_mps2", F.atan2("vy", "vx"), "valid_interval")
        wanted += brute_explosive([tuple(r) for r in track.collect()], config, physical.dt)
    assert sorted((r["family"], r["target"], round(r["onset_timestamp"], 6), round(r["target_timestamp"], 6)) for r in found) == sorted(wanted)
    assert len({w[:2] for w in wanted}) == 4 and all(0 <= r["bip_share"] <= 1 for r in found)
