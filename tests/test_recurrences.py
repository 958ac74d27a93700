"""Velocity estimators and linear recurrences against loops over samples."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import tracking as T
from pitchframe.operators.recurrences import modes, scanned

RNG = np.random.default_rng(8)
LENGTHS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 30, 700]


def loop(matrix, inputs):
    state, out = np.zeros(len(matrix)), []
    for b in inputs:
        state = matrix @ state + b
        out.append(state)
    return np.array(out)


@pytest.mark.parametrize("matrix", [[[0.9, 0.3], [-0.2, 0.8]], [[0.5, 0.0], [0.2, 0.97]], [[0.995]], [[-0.3]]])
def test_recurrences_equal_a_loop_over_many_blocks(spark, matrix):
    matrix, n, d = np.array(matrix), 2 * modes(matrix).block + 40, len(matrix)
    values = {k: RNG.normal(size=(n, d)) for k in "ab"}
    rows = [(k, i, *values[k][i].tolist()) for k in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, " + ", ".join(f"b{j} double" for j in range(d)))
    found = scanned(df, matrix, {"s": [F.col(f"b{j}") for j in range(d)]}, ["k"], "i")
    assert found.columns == [*df.columns, *[f"s_{j}" for j in range(d)]]
    for k in "ab":
        own = np.array([[r[f"s_{j}"] for j in range(d)] for r in found.filter(F.col("k") == k).orderBy("i").collect()])
        assert np.allclose(own, loop(matrix, values[k]), atol=1e-10, rtol=1e-10)


@pytest.mark.parametrize("matrix", [[[1.0]], [[0.0]], [[0.99999999]]])
def test_recurrences_that_do_not_fade_are_refused(matrix):
    with pytest.raises(ValueError):
        modes(np.array(matrix))


def polynomial(values, window, order, dt):
    n = len(values)
    window = min(window, n if n % 2 else n - 1)
    if n < 2:
        return [None] * n
    if window <= order:
        return np.gradient(values, dt)
    half, out = window // 2, []
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        fit = np.polynomial.polynomial.polyfit(np.arange(window) - (i - start), values[start : start + window], order)
        out.append(fit[1] / dt)
    return out


def one_pass(b, a, x):
    matrix, added, steady = T.direct_form(b, a)
    z, out = steady * x[0], np.empty_like(x)
    for i, v in enumerate(x):
        out[i] = b[0] * v + z[0]
        z = matrix @ z + added * v
    return out


def low_passed(values, dt, b, a):
    pad, n = 3 * len(a), len(values)
    if n > pad:
        wide = np.concatenate([2 * values[0] - values[pad:0:-1], values, 2 * values[-1] - values[-2 : -pad - 2 : -1]])
        values = one_pass(b, a, one_pass(b, a, wide)[::-1])[::-1][pad:-pad]
    return np.gradient(values, dt) if n > 1 else [None]


def smoothed(values, dt, gain, back):
    if len(values) < 2:
        return [None] * len(values)
    move, states = np.array([[1.0, dt], [0.0, 1.0]]), np.zeros((len(values), 2))
    states[0, 0] = values[0]
    for i in range(1, len(values)):
        ahead = move @ states[i - 1]
        states[i] = ahead + gain * (values[i] - ahead[0])
    for i in range(len(values) - 2, -1, -1):
        states[i] += back @ (states[i + 1] - move @ states[i])
    return states[:, 1]


CONFIGS = [
    T.TrackingConfig(estimator="savgol"), T.TrackingConfig(estimator="savgol", savgol_window_seconds=1.1, savgol_polyorder=3), T.TrackingConfig(estimator="butter"),
    T.TrackingConfig(estimator="butter", butter_order=3, butter_cutoff_hz=0.6), T.TrackingConfig(estimator="kalman"), T.TrackingConfig(estimator="kalman", kalman_accel_sigma_mps2=0.8),
    T.TrackingConfig(estimator="central"),
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.estimator}-{c.savgol_polyorder}-{c.butter_order}-{c.kalman_accel_sigma_mps2}")
def test_estimators_equal_loops_on_segments_of_all_lengths(spark, config):
    tracks = {s: np.cumsum(RNG.normal(size=(n, 2)), axis=0) for s, n in enumerate(LENGTHS)}
    rows = [("m", "a", 1, s, 100.0 * s + i / 10, *map(float, xy), f"kept {i}") for s, own in tracks.items() for i, xy in enumerate(own)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period_id int, segment_id long, timestamp double, x double, y double, note string").repartition(3)
    found = T._velocities(df, config)
    assert found.columns == [*df.columns, "vx", "vy"]
    dt = config.dt
    b, a = T.low_pass(config.butter_order, config.butter_cutoff_hz, config.sample_hz)
    gains = T.steady_gains(dt, config.kalman_position_sigma_m, config.kalman_accel_sigma_mps2)
    plain = {
        "savgol": lambda v: polynomial(v, config.samples(config.savgol_window_seconds), config.savgol_polyorder, dt),
        "butter": lambda v: low_passed(v, dt, b, a), "kalman": lambda v: smoothed(v, dt, *gains), "central": lambda v: np.gradient(v, dt) if len(v) > 1 else [None],
    }[config.estimator]
    got = found.orderBy("timestamp").collect()
    assert [(r["x"], r["note"]) for r in got] == [(r[5], r[7]) for r in sorted(rows, key=lambda r: r[4])]
    for s, own in tracks.items():
        for axis, c in enumerate(("vx", "vy")):
            values, want = [r[c] for r in got if r["segment_id"] == s], plain(own[:, axis])
            assert [v is None for v in values] == [v is None for v in want]
            assert all(v is None or abs(v - w) < 1e-9 for v, w in zip(values, want))


def test_no_estimator_visits_rows_in_python(spark):
    df = spark.createDataFrame([("m", "a", 1, 1, 0.0, 0.0, 0.0)], "match_id string, player_id string, period_id int, segment_id long, timestamp double, x double, y double")
    for kind in ("savgol", "butter", "kalman"):
        plan = T._velocities(df, replace(CONFIGS[0], estimator=kind))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1
