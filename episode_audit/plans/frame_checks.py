"""Frame checks over the event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.checks import kinematics, motion, simulation, timing
from ..operators.checks.series import KEY, episode_bounds, frame_series, resample, speed_points
from ..operators.row_series import in_parts, with_previous
from . import proxies as P
from .registry import query

ORDER = list(P.FRAME_ORDER)


def state_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frames(spark, sf_dir).select(
        "episode", "ts", "event_id", "event_type", F.array("v0", "v1").alias("state"), F.array("v1", "v0").alias("action")
    )


def joint_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame series of times and joint states."""
    return frame_series(state_frames(spark, sf_dir).drop("action"), ORDER)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode facts: rate and duration follow from the series itself."""
    span = F.col("t1") - F.col("t0")
    rate = F.when(span > 0, (F.col("frames") - 1) / span).otherwise(0.0)
    return episode_bounds(P.frames(spark, sf_dir)).select("episode", "t0", "t1", "frames", rate.alias("rate_hz"), (span * 1000).alias("duration_ms"))


EPISODES_SQL = P.FRAMES_SQL + """,
eps AS (
  SELECT episode, min(ts) AS t0, max(ts) AS t1, count(*) AS n,
         CASE WHEN max(ts) > min(ts) THEN (count(*) - 1) / (max(ts) - min(ts)) ELSE 0 END AS rate,
         (max(ts) - min(ts)) * 1000 AS duration
  FROM frames GROUP BY episode),
series AS (
  SELECT f.*, row_number() OVER w - 1 AS frame, lag(ts) OVER w AS pts, lag(v0) OVER w AS p0, lag(v1) OVER w AS p1
  FROM frames f WINDOW w AS (PARTITION BY episode ORDER BY ts, event_id))"""


@query(
    "frame_scan",
    "SELECT user_id AS episode, event_id, value FROM events WHERE user_id BETWEEN 10 AND 19",
)
def frame_scan(spark, sf_dir):
    """Two columns of some episodes: projection and filter reach the scan."""
    return (
        P.table(spark, sf_dir, "events")
        .filter(F.col("user_id").between(10, 19))
        .select(F.col("user_id").alias("episode"), "event_id", "value")
    )


@query(
    "episode_success",
    "SELECT user_id AS episode, bool_or(event_type = 'purchase') AS success, CAST(NULL AS BOOLEAN) AS other FROM events GROUP BY user_id",
)
def episode_success(spark, sf_dir):
    """Any-true per episode; a column that does not exist gives null."""
    from ..sources.episodes import any_true

    rows = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), (F.col("event_type") == "purchase").alias("success"))
    return rows.groupBy("episode").agg(any_true(rows, ["success"]).alias("success"), any_true(rows, ["next.success"]).alias("other"))


@query(
    "frame_deltas",
    "WITH " + EPISODES_SQL + """,
second AS (SELECT *, lag(v0 - p0) OVER (PARTITION BY episode ORDER BY frame) AS pv FROM series)
SELECT episode, frame, round(ts - pts, 9) AS dt, round(v0 - p0, 6) AS step, round((v0 - p0) - pv, 6) AS second_step FROM second""",
)
def frame_deltas(spark, sf_dir):
    parts = in_parts(P.frames(spark, sf_dir).select("episode", "ts", "event_id", "v0"), KEY, ORDER)
    rows = with_previous(parts, KEY, ["ts", "v0"], depth=2, position="frame")
    step, before = F.col("v0") - F.col("prev_v0"), F.col("prev_v0") - F.col("prev2_v0")
    return rows.select(
        "episode", "frame", F.round(F.col("ts") - F.col("prev_ts"), 9).alias("dt"), F.round(step, 6).alias("step"),
        F.round(step - before, 6).alias("second_step"),
    )


TIMING_SQL = EPISODES_SQL + """,
stats AS (
  SELECT s.episode, any_value(rate) AS rate, any_value(duration) AS duration, count(*) AS n,
    min(frame) FILTER (frame > 0 AND NOT ts > pts) AS unordered,
    min(frame) FILTER (frame > 0 AND rate > 0 AND ts - pts > 5 / rate) AS gap,
    count(*) FILTER (frame > 0 AND rate > 0 AND abs(ts - pts - 1 / rate) <= 0.25 / rate) AS near,
    min(frame) FILTER (frame > 0 AND rate > 0 AND NOT abs(ts - pts - 1 / rate) <= 0.25 / rate) AS outside
  FROM series s JOIN eps e ON s.episode = e.episode GROUP BY s.episode),
judged AS (
  SELECT *, CASE WHEN rate <= 0 THEN 'rate_hz not positive' WHEN unordered IS NOT NULL THEN 'timestamp not strictly increasing'
    WHEN gap IS NOT NULL THEN 'gap exceeds max_gap' WHEN n > 1 AND near / (n - 1) < 0.99 THEN 'too many frames outside period tolerance'
    WHEN abs(n - duration * rate / 1000) > 2 THEN 'frame count out of tolerance' ELSE '' END AS reason FROM stats),
timing AS (
  SELECT episode, CASE reason WHEN '' THEN 'pass' WHEN 'rate_hz not positive' THEN 'inconclusive' ELSE 'fail' END AS result, reason,
    CASE reason WHEN 'timestamp not strictly increasing' THEN unordered WHEN 'gap exceeds max_gap' THEN gap
      WHEN 'too many frames outside period tolerance' THEN outside WHEN 'frame count out of tolerance' THEN 0 END AS offending_frame FROM judged)"""


@query("timing_check", "WITH " + TIMING_SQL + " SELECT * FROM timing")
def timing_check(spark, sf_dir):
    return timing.timing_check(frame_series(P.frames(spark, sf_dir), ORDER), episodes(spark, sf_dir))


def limited_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint limits by user: none, wrong joint count, narrow, wide with slow or fast caps."""
    e = F.col("episode")
    pair = lambda a, b: F.array(F.lit(float(a)), F.lit(float(b)))
    wide = F.array(pair(-10, 900), pair(-10, 900))
    limits = (
        F.when(e % 10 == 0, F.lit(None))
        .when(e % 10 == 5, F.array(pair(0, 1), pair(0, 1), pair(0, 1)))
        .when(e % 3 == 0, F.array(pair(0, 250), pair(0, 97)))
        .otherwise(wide)
    )
    caps = F.when(e % 10 == 5, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).when(e % 3 == 1, pair(700, 190)).otherwise(pair(1e6, 1e6))
    return episodes(spark, sf_dir).withColumn("joint_limits", limits).withColumn("max_vel", F.when(e % 10 != 0, caps))


ACCEL = 1500.0
KINEMATICS_SQL = EPISODES_SQL + f""",
lim AS (
  SELECT episode, rate, CASE WHEN episode % 3 = 0 THEN 0 ELSE -10 END AS lo, CASE WHEN episode % 3 = 0 THEN 250 ELSE 900 END AS hi0,
    CASE WHEN episode % 3 = 0 THEN 97 ELSE 900 END AS hi1, CASE WHEN episode % 3 = 1 THEN 700 ELSE 1e6 END AS cap0,
    CASE WHEN episode % 3 = 1 THEN 190 ELSE 1e6 END AS cap1 FROM eps),
sides AS (
  SELECT episode, frame, 0 AS side, v0 AS a, v1 AS b, p0 AS pa, p1 AS pb FROM series
  UNION ALL SELECT episode, frame, 1, v1, v0, p1, p0 FROM series),
joints AS (
  SELECT episode, frame, side, 0 AS joint, a AS v, pa AS pv FROM sides UNION ALL SELECT episode, frame, side, 1, b, pb FROM sides),
moving AS (SELECT j.*, rate, lo, CASE joint WHEN 0 THEN hi0 ELSE hi1 END AS hi, CASE joint WHEN 0 THEN cap0 ELSE cap1 END AS cap,
    (v - pv) * rate AS vel FROM joints j JOIN lim l ON j.episode = l.episode),
accel AS (SELECT *, (vel - lag(vel) OVER (PARTITION BY episode, side, joint ORDER BY frame)) * rate AS acc FROM moving),
hits AS (
  SELECT episode, side, 0 AS rule, frame, joint, v AS value FROM accel WHERE v < lo - {kinematics.TOLERANCE!r} OR v > hi + {kinematics.TOLERANCE!r}
  UNION ALL SELECT episode, side, 1, frame, joint, vel FROM accel WHERE abs(vel) > cap
  UNION ALL SELECT episode, side, 2, frame, joint, acc FROM accel WHERE abs(acc) > {ACCEL}),
firsts AS (SELECT * FROM hits WHERE episode % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY episode ORDER BY side, rule, frame, joint) = 1),
kin AS (
  SELECT e.episode, CASE WHEN e.episode % 5 = 0 OR rate <= 0 THEN 'inconclusive' WHEN f.episode IS NULL THEN 'pass' ELSE 'fail' END AS result,
    CASE WHEN e.episode % 10 = 0 THEN 'no limits for embodiment' WHEN rate <= 0 THEN 'rate_hz not positive'
      WHEN e.episode % 10 = 5 THEN 'joint count mismatch' WHEN f.episode IS NULL THEN ''
      ELSE ['observation.state', 'action'][side + 1] || [' joint out of range', ' velocity exceeds maxVel', ' acceleration spike'][rule + 1] END AS reason,
    CASE WHEN rate > 0 THEN frame END AS offending_frame, CASE WHEN rate > 0 THEN CAST(joint AS BIGINT) END AS offending_joint,
    CASE WHEN rate > 0 THEN round(value, 4) END AS value
  FROM eps e LEFT JOIN firsts f ON e.episode = f.episode)"""


@query("kinematics_check", "WITH " + KINEMATICS_SQL + " SELECT * FROM kin")
def kinematics_check(spark, sf_dir):
    out = kinematics.kinematics_check(frame_series(state_frames(spark, sf_dir), ORDER), limited_episodes(spark, sf_dir), ACCEL)
    return out.withColumn("value", F.round("value", 4))


# ----------------------------------------------------------- aggregates


@query(
    "grouped_corr",
    """WITH f AS (SELECT user_id AS episode, event_type, value AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b FROM events)
SELECT episode, event_type, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho
FROM f GROUP BY 1, 2""",
)
def grouped_corr(spark, sf_dir):
    return (
        P.frames(spark, sf_dir)
        .groupBy("episode", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(motion.pearson("v0", "v1"), 6).alias("rho"))
    )


FEATURES_SQL = EPISODES_SQL + """,
features AS (
  SELECT episode, coalesce(sum(CASE WHEN frame > 0 THEN (v0 = p0)::INT + (v1 = p1)::INT END)::DOUBLE / nullif(sum(CASE WHEN frame > 0 THEN 2 END), 0), 0.0) AS repeat_fraction,
         CASE WHEN count(*) < 3 THEN NULL ELSE var_pop(ts - pts) END AS dt_variance FROM series GROUP BY episode)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.repeat_and_jitter(joint_series(spark, sf_dir))


@query("dt_variance", "WITH " + FEATURES_SQL + " SELECT episode, round(dt_variance, 9) AS dt_variance FROM features")
def dt_variance(spark, sf_dir):
    v = F.col("dt_variance")
    return features(spark, sf_dir).select("episode", F.when(v < float("inf"), F.round(v, 9)).alias("dt_variance"))


@query("repeat_fraction", "WITH " + FEATURES_SQL + " SELECT episode, round(repeat_fraction, 9) AS repeat_fraction FROM features")
def repeat_fraction(spark, sf_dir):
    return features(spark, sf_dir).select("episode", F.round("repeat_fraction", 9).alias("repeat_fraction"))


NORMAL_SQL = EPISODES_SQL + """,
ranges AS (SELECT episode, min(v0) AS lo, max(v0) AS hi FROM frames GROUP BY episode),
normal AS (
  SELECT s.episode, frame, CASE WHEN lo < hi THEN (v0 - lo) / (hi - lo) ELSE 0.5 END AS v
  FROM series s JOIN ranges r ON s.episode = r.episode)"""


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint 0 scaled to its own range; a constant joint lies in the middle."""
    ranges = P.frames(spark, sf_dir).groupBy("episode").agg(F.min("v0").alias("lo"), F.max("v0").alias("hi"))
    flat = ~(F.col("lo") < F.col("hi"))
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    scaled = lambda v: F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    parts = in_parts(P.frames(spark, sf_dir).select("episode", "ts", "event_id", "v0"), KEY, ORDER)
    rows = with_previous(parts, KEY, ["v0"], position="frame", attributes=ranges)
    return rows.select("episode", "frame", scaled(F.col("v0")).alias("v"), scaled(F.col("prev_v0")).alias("prev_v"))


@query("minmax_normalise", "WITH " + NORMAL_SQL + " SELECT episode, frame, round(v, 6) AS v FROM normal")
def minmax_normalise(spark, sf_dir):
    return normalised(spark, sf_dir).select("episode", "frame", F.round("v", 6).alias("v"))


@query(
    "velocity_histogram",
    "WITH " + NORMAL_SQL + f""",
d AS (SELECT episode, v - lag(v) OVER (PARTITION BY episode ORDER BY frame) AS d FROM normal),
b AS (SELECT episode, CAST(least(greatest(floor((d + 1.0) / 0.0625), 0), {fixed.HISTOGRAM_BINS - 1}) AS BIGINT) AS bin FROM d WHERE d IS NOT NULL)
SELECT episode, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY episode), 6) AS share FROM b GROUP BY episode, bin""",
)
def velocity_histogram(spark, sf_dir):
    steps = normalised(spark, sf_dir)
    width = 2.0 / fixed.HISTOGRAM_BINS
    bins = (
        steps.filter(F.col("frame") > 0)
        .select("episode", F.least(F.greatest(F.floor((F.col("v") - F.col("prev_v") + 1.0) / width), F.lit(0)), F.lit(fixed.HISTOGRAM_BINS - 1)).cast("bigint").alias("bin"))
        .groupBy("episode", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = bins.groupBy("episode").agg(F.sum("n").alias("total"))
    return bins.join(totals, "episode").select("episode", "bin", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(
    "resample_linear",
    "WITH " + EPISODES_SQL + f""",
grid AS (SELECT episode, k, t0 + k * 0.1 AS t FROM eps, range(0, 400) g(k) WHERE k <= floor((t1 - t0) / 0.1)),
spans AS (SELECT episode, frame, pts, ts, p0, v0, p1, v1 FROM series WHERE frame > 0),
pick AS (SELECT g.episode, g.k, g.t, s.* EXCLUDE (episode) FROM grid g ASOF JOIN spans s ON g.episode = s.episode AND g.t <= s.ts)
SELECT episode, k, round(p0 + (v0 - p0) * (t - pts) / (ts - pts), 4) AS v0, round(p1 + (v1 - p1) * (t - pts) / (ts - pts), 4) AS v1 FROM pick""",
)
def resample_linear(spark, sf_dir):
    frames = joint_series(spark, sf_dir)
    out = resample(frames, fixed.RESAMPLE_HZ, episode_bounds(frames).filter(F.col("frames") > 1))
    return out.select("episode", "k", F.round(F.get("state", F.lit(0)), 4).alias("v0"), F.round(F.get("state", F.lit(1)), 4).alias("v1"))


# ------------------------------------------------- motion and simulation


def motion_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion energy on a 5 Hz grid: how many events fall into each cell."""
    frames = P.frames(spark, sf_dir).select("episode", "ts")
    bounds = episode_bounds(frames).filter(F.col("episode") % 13 != 0)
    last = F.floor((F.col("t1") - F.col("t0")) * fixed.MOTION_HZ).cast("bigint")
    grid = bounds.select("episode", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    cells = (
        frames.join(bounds.select("episode", "t0"), "episode")
        .groupBy("episode", F.floor((F.col("ts") - F.col("t0")) * fixed.MOTION_HZ).cast("bigint").alias("k"))
        .agg(F.count(F.lit(1)).cast("double").alias("energy"))
    )
    return grid.join(cells, ["episode", "k"], "left").select("episode", "k", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def _samples_sql(hz: int, name: str, grid: str) -> str:
    return f"""
{name}_near AS (
  SELECT g.episode, g.k, g.t, s.t AS pt, s.speed AS ps, b.t AS nt, b.speed AS ns FROM {grid} g
  ASOF LEFT JOIN points s ON g.episode = s.episode AND g.t >= s.t
  ASOF LEFT JOIN points b ON g.episode = b.episode AND g.t <= b.t),
{name} AS (
  SELECT episode, k, CASE WHEN pt IS NULL THEN ns WHEN nt IS NULL THEN ps WHEN nt > pt THEN ps + (ns - ps) * (t - pt) / (nt - pt) ELSE ps END AS value
  FROM {name}_near WHERE pt IS NOT NULL OR nt IS NOT NULL)"""


MOTION_SQL = """
points AS (SELECT episode, (ts + pts) / 2 AS t, sqrt((v0 - p0) * (v0 - p0) + (v1 - p1) * (v1 - p1)) / (ts - pts) AS speed FROM series WHERE frame > 0 AND ts > pts),
cells AS (SELECT f.episode, floor((ts - t0) * 5)::BIGINT AS k, count(*) AS energy FROM frames f JOIN eps e ON f.episode = e.episode GROUP BY 1, 2),
mgrid AS (SELECT episode, k, t0 + k / 5.0::DOUBLE AS t FROM eps, range(0, 400) g(k) WHERE k <= floor((t1 - t0) * 5) AND episode % 13 <> 0),
motion AS (SELECT g.episode, g.k, coalesce(energy, 0)::DOUBLE AS energy FROM mgrid g LEFT JOIN cells c ON g.episode = c.episode AND g.k = c.k),
""" + _samples_sql(5, "speeds", "mgrid") + """,
correl AS (
  SELECT episode, count(*) AS samples, CASE WHEN count(*) >= 2 AND stddev_pop(value) > 0 AND stddev_pop(energy) > 0 THEN corr(value, energy) END AS rho
  FROM motion JOIN speeds USING (episode, k) GROUP BY episode)"""


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = joint_series(spark, sf_dir)
    return motion.motion_correlation(frames, speed_points(frames), motion_series(spark, sf_dir))


@query(
    "motion_correlation",
    "WITH " + EPISODES_SQL + ", " + MOTION_SQL + " SELECT episode, samples, round(rho, 6) AS rho FROM (SELECT DISTINCT episode FROM eps) LEFT JOIN correl USING (episode)",
)
def motion_correlation(spark, sf_dir):
    """A row for every episode; null where it has no motion series or too few samples."""
    every = P.frames(spark, sf_dir).select("episode").distinct()
    return every.join(correlation(spark, sf_dir), "episode", "left").select("episode", "samples", F.round("rho", 6).alias("rho"))


SHARE_SQL = """
sgrid AS (SELECT episode, k, t0 + k / 20.0::DOUBLE AS t FROM eps, range(0, 1200) g(k) WHERE k <= floor((t1 - t0) / 0.05) AND floor((t1 - t0) / 0.05) >= 3),
""" + _samples_sql(20, "signal", "sgrid") + """,
enough AS (SELECT episode FROM points GROUP BY episode HAVING count(*) >= 2),
centred AS (SELECT episode, k, count(*) OVER (PARTITION BY episode) AS n, value - avg(value) OVER (PARTITION BY episode) AS c FROM signal WHERE episode IN (SELECT episode FROM enough)),
freqs AS (SELECT DISTINCT c.episode, n, f FROM centred c, range(0, 700) r(f) WHERE k = 0 AND f <= n // 2),
power AS (
  SELECT c.episode, f, any_value(c.n) AS n, pow(sum(c.c * cos(-2 * pi() * f * k / c.n)), 2) + pow(sum(c.c * sin(-2 * pi() * f * k / c.n)), 2) AS p
  FROM centred c JOIN freqs q ON c.episode = q.episode GROUP BY c.episode, f),
share AS (SELECT episode, CASE WHEN sum(p) > 0 THEN coalesce(sum(p) FILTER (f * 20.0 / n > 5), 0) / sum(p) ELSE 0 END AS share FROM power GROUP BY episode)"""


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = joint_series(spark, sf_dir)
    return simulation.spectral_share(frames, speed_points(frames))


@query(
    "spectral_share",
    "WITH " + EPISODES_SQL + ", " + MOTION_SQL + ", " + SHARE_SQL + " SELECT episode, round(share, 6) AS share FROM share",
)
def spectral_share(spark, sf_dir):
    return share(spark, sf_dir).select("episode", F.round("share", 6).alias("share"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array(*(F.lit(s) for s in fixed.SOURCES))
    return episodes(spark, sf_dir).withColumn("source", F.get(sources, (F.col("episode") % 5).cast("int")))


SIM_SQL = FEATURES_SQL + ", " + MOTION_SQL + ", " + SHARE_SQL + """,
zeros AS (SELECT episode, avg((energy = 0)::INT) AS zero FROM motion GROUP BY episode),
scored AS (
  SELECT e.episode, e.episode % 5 <= 1 AS simulated, (repeat_fraction > 0.05)::BIGINT + coalesce(dt_variance < 1e-12, false)::BIGINT
    + coalesce(share < 1e-6, false)::BIGINT + coalesce(zero >= 0.2, false)::BIGINT AS score
  FROM eps e LEFT JOIN features f ON e.episode = f.episode LEFT JOIN share s ON e.episode = s.episode LEFT JOIN zeros z ON e.episode = z.episode),
sim AS (
  SELECT episode, CASE WHEN simulated THEN 'pass' WHEN score >= 2 THEN 'inconclusive' ELSE 'pass' END AS result,
    CASE WHEN simulated THEN 'declared sim' ELSE '' END AS reason, CASE WHEN NOT simulated AND score >= 3 THEN 'fail' ELSE '' END AS downgraded_from,
    CASE WHEN NOT simulated THEN score END AS score FROM scored)"""


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = joint_series(spark, sf_dir)
    features, share = simulation.repeat_and_jitter(frames), simulation.spectral_share(frames, speed_points(frames))
    return simulation.simulation_check(declared(spark, sf_dir), features, share, motion_series(spark, sf_dir))


@query("sim_signature", "WITH " + SIM_SQL + " SELECT * FROM sim")
def sim_signature(spark, sf_dir):
    return simulated(spark, sf_dir).select("episode", "result", "reason", "downgraded_from", "score")


SENSOR_SQL = """
sensor AS (
  SELECT e.episode, CASE WHEN rho >= 0.4 THEN 'pass' ELSE 'inconclusive' END AS result,
    CASE WHEN e.episode % 13 = 0 THEN 'no video' WHEN m < 2 THEN 'insufficient motion samples' WHEN samples IS NULL THEN 'no valid speed samples'
         WHEN rho IS NULL THEN 'degenerate variance' ELSE '' END AS reason
  FROM eps e LEFT JOIN correl c ON e.episode = c.episode LEFT JOIN (SELECT episode, count(*) AS m FROM motion GROUP BY episode) x ON e.episode = x.episode)"""


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.sensor_check(episodes(spark, sf_dir), correlation(spark, sf_dir), motion_series(spark, sf_dir), P.frames(spark, sf_dir))


@query(
    "sensor_consistency",
    "WITH " + EPISODES_SQL + ", " + MOTION_SQL + ", " + SENSOR_SQL + " SELECT * FROM sensor",
)
def sensor_consistency(spark, sf_dir):
    return sensor(spark, sf_dir).select("episode", "result", "reason")
