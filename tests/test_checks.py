"""Frame checks on literal series: every reason, rule order and boundary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episode_audit.operators.checks import kinematics as K
from episode_audit.operators.checks import motion as MO
from episode_audit.operators.checks import simulation as SI
from episode_audit.operators.checks import spectrum as SP
from episode_audit.operators.checks import timing as T
from episode_audit.operators.checks.series import clamped_samples, frame_series, speed_points
from episode_audit.operators.row_series import in_parts, with_previous

ORDER = ["frame_index"]


def series_of(frames):
    """Parts of two frames, so that every rule crosses borders."""
    return frame_series(frames, ORDER, rows=2)


def frames_of(spark, cases):
    rows = [
        (e, i, float(t), [float(x) for x in s], None if a is None else [float(x) for x in a[i]])
        for e, (ts, state, a) in cases.items()
        for i, (t, s) in enumerate(zip(ts, state))
    ]
    schema = "episode bigint, frame_index bigint, ts double, state array<double>, action array<double>"
    return spark.createDataFrame(rows, schema)


def test_timing_reasons(spark):
    even = [i / 10 for i in range(200)]
    cases = {
        1: (even, 10.0, 20000.0, "pass", "", None),
        2: (even, 0.0, 20000.0, "inconclusive", "rate_hz not positive", None),
        3: ([], 10.0, 0.0, "fail", "no frames", 0),
        4: (even[:50] + [even[49]] + even[51:], 10.0, 20000.0, "fail", "timestamp not strictly increasing", 50),
        5: (even[:100] + [t + 0.6 for t in even[100:]], 10.0, 20000.0, "fail", "gap exceeds max_gap", 100),
        6: ([t + (0.04 if i % 2 else 0) for i, t in enumerate(even)], 10.0, 20000.0, "fail", "too many frames outside period tolerance", 1),
        7: (even, 10.0, 20300.0, "fail", "frame count out of tolerance", 0),
        8: (even, 10.0, 20200.0, "pass", "", None),
        9: ([0.0], 10.0, 100.0, "pass", "", None),
        10: (even[:20] + [float("nan")] + even[21:], 10.0, 20000.0, "fail", "timestamp not strictly increasing", 20),
        # both a gap and a later step back: order is tested first over the whole series
        11: ([0.0, 1.0, 0.5], 10.0, 300.0, "fail", "timestamp not strictly increasing", 2),
    }
    frames = frames_of(spark, {e: (c[0], [[0.0]] * len(c[0]), None) for e, c in cases.items()})
    episodes = spark.createDataFrame([(e, c[1], c[2]) for e, c in cases.items()], "episode bigint, rate_hz double, duration_ms double")
    got = {r.episode: (r.result, r.reason, r.offending_frame) for r in T.timing_check(series_of(frames), episodes).collect()}
    assert got == {e: tuple(c[3:]) for e, c in cases.items()}


def test_kinematics_reasons(spark):
    limits, caps = [[-1.0, 1.0], [-1.0, 1.0]], [2.0, 2.0]
    still = [[0.0, 0.0]] * 6
    ramp = [[0.0, 0.0], [0.0, 0.1], [0.0, 0.2], [0.0, 0.5], [0.0, 0.8], [0.0, 0.8]]
    jerk = [[0.0, 0.0], [0.0, 0.0], [0.15, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    over = [[0.0, 0.0], [0.0, 0.4], [0.0, 0.8], [0.0, 1.2], [0.0, 1.2], [0.0, 1.2]]
    nan = [[0.0, 0.0], [float("nan"), 0.0], *still[:4]]
    just = [[1.0 + 0.9 * K.TOLERANCE, 0.0]] * 6
    cases = {
        1: (still, None, limits, caps, ("pass", "", None, None)),
        2: (still, None, None, None, ("inconclusive", "no limits for embodiment", None, None)),
        3: ([[0.0]] * 6, None, limits, caps, ("inconclusive", "joint count mismatch", None, None)),
        4: (ramp, None, limits, caps, ("fail", "observation.state velocity exceeds maxVel", 3, 1)),
        5: (jerk, None, limits, [9.0, 9.0], ("pass", "", None, None)),
        6: (over, None, limits, caps, ("fail", "observation.state joint out of range", 3, 1)),
        7: (still, over, limits, caps, ("fail", "action joint out of range", 3, 1)),
        8: (nan, None, limits, caps, ("pass", "", None, None)),
        9: (just, None, limits, caps, ("pass", "", None, None)),
        10: ([], None, limits, caps, ("fail", "no frames", 0, None)),
        11: (ramp, over, limits, caps, ("fail", "observation.state velocity exceeds maxVel", 3, 1)),
    }
    frames = frames_of(spark, {e: ([i / 10 for i in range(len(c[0]))], c[0], c[1]) for e, c in cases.items()})
    schema = "episode bigint, rate_hz double, joint_limits array<array<double>>, max_vel array<double>"
    episodes = spark.createDataFrame([(e, 10.0, c[2], c[3]) for e, c in cases.items()], schema)
    got = {
        r.episode: (r.result, r.reason, r.offending_frame, r.offending_joint)
        for r in K.kinematics_check(series_of(frames), episodes).collect()
    }
    assert got == {e: c[4] for e, c in cases.items()}
    sharp = K.kinematics_check(series_of(frames.filter("episode = 5")), episodes.filter("episode = 5"), max_accel=20.0).first()
    # up by 0.15 then down by 0.15 within two steps of 0.1 s: 30 rad/s^2 at frame 3
    assert (sharp.reason, sharp.offending_frame, sharp.offending_joint, round(sharp.value, 6)) == ("observation.state acceleration spike", 3, 0, -30.0)


def test_known_limits_come_from_the_table(spark):
    rows = {r.embodiment: r for r in K.embodiment_limits(spark).collect()}
    assert len(rows) == 58 and sum(r.joint_limits is not None for r in rows.values()) == 5
    assert all(len(r.joint_limits) == len(r.max_vel) == r.dof for r in rows.values() if r.joint_limits)


def interp(points, t):
    return float(np.interp(t, [p[0] for p in points], [p[1] for p in points]))


def test_clamped_samples_match_interpolation(spark):
    rng = np.random.default_rng(2)
    points = {e: sorted((float(t), float(v)) for t, v in zip(rng.random(n) * 4, rng.random(n))) for e, n in ((1, 1), (2, 2), (3, 40))}
    rows = spark.createDataFrame([(e, t, v) for e, ps in points.items() for t, v in ps], "episode bigint, t double, speed double")
    grid = spark.createDataFrame([(e, 0.0, 25) for e in points], "episode bigint, t0 double, samples bigint")
    linked = with_previous(in_parts(rows, ["episode"], ["t"], rows=3), ["episode"], ["t", "speed"])
    got = {(r.episode, r.k): r.value for r in clamped_samples(linked, grid, 5).collect()}
    assert len(got) == 75
    for (e, k), v in got.items():
        assert v == pytest.approx(interp(points[e], k / 5), abs=1e-9)


def test_motion_correlation(spark):
    ts = [i / 30 for i in range(151)]
    moving = [[np.sin(3 * t * t)] for t in ts]
    speeds = [abs(6 * t * np.cos(3 * t * t)) for t in np.arange(25) / 5]
    rng = np.random.default_rng(1)
    energy = {1: speeds, 2: list(rng.random(25)), 3: [1.0] * 25, 4: [1.0], 6: [-s for s in speeds]}
    frames = frames_of(spark, {e: (ts, moving, None) for e in (1, 2, 3, 4, 5, 6)})
    motion = spark.createDataFrame([(e, k, float(v)) for e, vs in energy.items() for k, v in enumerate(vs)], "episode bigint, k bigint, energy double")
    episodes = spark.createDataFrame([(e,) for e in range(1, 8)], "episode bigint")
    series = series_of(frames)
    rho = MO.motion_correlation(series, speed_points(series), motion)
    got = {r.episode: (r.result, r.reason, r.downgraded_from) for r in MO.sensor_check(episodes, rho, motion, series).collect()}
    assert got[1] == ("pass", "", "")
    assert got[3] == ("inconclusive", "degenerate variance", "")
    assert got[4] == ("inconclusive", "insufficient motion samples", "")
    assert got[5] == ("inconclusive", "no video", "")
    assert got[6] == ("inconclusive", "", "fail")


def test_simulation_scores(spark):
    rng = np.random.default_rng(4)
    even = [i / 30 for i in range(300)]
    real_ts = list(np.cumsum(1 / 30 + rng.normal(0, 1e-3, 300)))
    real = (real_ts, [list(rng.normal(0, 0.01, 6) + np.sin(t)) for t in real_ts], None)
    synthetic = (even, [[float(i // 30)] * 6 for i in range(300)], None)
    frames = frames_of(spark, {1: real, 2: synthetic, 3: synthetic})
    motion = spark.createDataFrame([(e, k, float(e == 1)) for e in (1, 2, 3) for k in range(50)], "episode bigint, k bigint, energy double")
    episodes = spark.createDataFrame([(1, "teleop_real"), (2, "mixed"), (3, "teleop_sim"), (4, "mixed")], "episode bigint, source string")
    series = series_of(frames)
    features = SI.repeat_and_jitter(series)
    share = SI.spectral_share(series, speed_points(series))
    got = {r.episode: (r.result, r.reason, r.downgraded_from, r.score) for r in SI.simulation_check(episodes, features, share, motion).collect()}
    assert got == {1: ("pass", "", "", 0), 2: ("inconclusive", "", "fail", 3), 3: ("pass", "declared sim", "", None), 4: ("inconclusive", "no frames", "", None)}


def test_long_signals_in_parts_equal_the_direct_transform(spark):
    rng = np.random.default_rng(9)
    signals = {1: rng.random(301), 2: rng.random(256), 3: np.sin(np.arange(97)), 4: np.ones(10), 5: rng.random(50)}
    rows = spark.createDataFrame([(e, k, float(v)) for e, vs in signals.items() for k, v in enumerate(vs)], "episode bigint, k bigint, value double")
    lengths = rows.groupBy("episode").agg(F.count("*").alias("samples"))
    got = {r.episode: r.share for r in SP.shares(rows, lengths, "bigint", long_signal=60).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for e, vs in signals.items():
        assert got[e] == pytest.approx(SP.power_share(vs), abs=1e-9)


DATA = "/root/testdata/sf0.001"


def test_all_checks_in_one_run_equal_each_alone(spark, monkeypatch):
    """Five checks, one series: the events are scanned for it once to be counted and once to be sorted."""
    from episode_audit import fixed_values as fixed
    from episode_audit.operators import row_series
    from episode_audit.operators.checks import neardup as N
    from episode_audit.plans import frame_checks as P
    from episode_audit.plans import load_all

    made = []
    in_parts_ = row_series.in_parts
    monkeypatch.setattr("episode_audit.operators.checks.series.in_parts", lambda *a, **k: made.append(a[0]) or in_parts_(*a, **k))
    queries = load_all().QUERIES
    rows = queries["run_all_checks"](spark, DATA).collect()
    assert len(made) == 1  # one series serves all checks
    got = {(r.episode, r.check_name): (r.result, r.reason) for r in rows}
    episodes = {r.episode for r in rows}
    assert set(got) == {(e, c) for e in episodes for c in fixed.CHECK_SETTINGS}
    four = {(r.episode, r.check_name): (r.result, r.reason) for r in queries["run_checks"](spark, DATA).collect()}
    assert {k: v for k, v in got.items() if k[1] != "dedup.v1"} == four
    series = frame_series(P.state_frames(spark, DATA).drop("action"), P.ORDER, rows=7)
    info = P.limited_episodes(spark, DATA).select("episode", F.col("episode").alias("idx"), F.lit("arm").alias("embodiment"), "joint_limits")
    alone = {r.episode: (r.result, r.reason) for r in N.neardup_check(series, info).collect()}
    for e in episodes:
        assert got[e, "dedup.v1"] == (("inconclusive", "unreadable") if e % 9 == 4 else alone[e])


def test_no_part_of_a_hot_episode_is_large(spark):
    """One episode holds a third of all frames, at one time; windows and joins see parts of a fixed number of rows."""
    frames = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).cast("bigint").alias("episode"), F.lit(1.0).alias("ts"),
        F.col("id").alias("frame_index"), F.array(F.col("id").cast("double")).alias("state"),
    )
    series = frame_series(frames, ORDER, rows=20)
    sizes = [r["count"] for r in series.groupBy("_part", "episode").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 900
    hot = series.filter("episode = -1").orderBy("frame").collect()
    assert [r.frame for r in hot] == list(range(300)) and all(r.prev2_state == hot[i - 2].state for i, r in enumerate(hot) if i > 1)
