"""Frame series: previous values, speeds, and samples on an even grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import row_series
from ..row_series import ID, PART, in_parts, stored, with_previous

KEY = ("episode",)
LAGGED = ("ts", "state", "action")


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences over the joints of `a`."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def frame_series(frames: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """The series that all frame checks read: stored once, in parts of at most `rows` frames.

    Adds `frame` (from 0 in its episode) and, of the frames one and two before, the columns
    ts, state and action that `frames` has.
    """
    take = [c for c in LAGGED if c in frames.columns]
    kept = list(dict.fromkeys(["episode", *take, *order]))
    parts = in_parts(frames.select(*kept), KEY, order, rows or row_series.ROWS)
    return stored(with_previous(parts, KEY, take, depth=2, position="frame"), "series")


def speed_points(series: DataFrame) -> DataFrame:
    """Stored: (episode, t, speed, pos, prev_t, prev_speed) between consecutive frames with time going forward.

    t is the middle of the gap; points keep the order of the frames.
    """
    gap = F.col("ts") - F.col("prev_ts")
    points = series.filter((F.col("frame") > 0) & (gap > 0)).select(
        "episode", PART, ID,
        ((F.col("ts") + F.col("prev_ts")) / 2).alias("t"),
        (F.sqrt(squared_distance(F.col("state"), F.col("prev_state"))) / gap).alias("speed"),
    )
    return stored(with_previous(points, KEY, ["t", "speed"]), "points")


def _fill(first: Column, last: Column) -> Column:
    """Grid numbers first..last, none when empty."""
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))


def clamped_samples(points: DataFrame, grid: DataFrame, hz: int, count: str = "samples") -> DataFrame:
    """Linear interpolation of (t, speed) at t0 + k/hz for k below the episode's sample count.

    Every gap between two points makes the samples that fall inside it, so no
    join against the grid and no window over an episode is needed. Before the
    first and after the last point the end values hold. `points` are those of
    `speed_points`; `grid` has one row per episode with t0 and the number of samples.
    """
    grid = grid.select("episode", "t0", F.col(count).cast("bigint").alias("_m"))
    series = row_series.attach(points, KEY, grid)
    at = lambda t: F.floor((F.col(t) - F.col("t0")) * hz).cast("bigint")
    limit = F.col("_m") - 1
    first = F.when(F.col("pos") == 0, F.lit(0).cast("bigint")).otherwise(at("prev_t") + 1)
    k = series.select("*", _fill(F.greatest(first, F.lit(0).cast("bigint")), F.least(at("t"), limit)).alias("k"))
    t = F.col("t0") + F.col("k") / hz
    share = F.when(F.col("t") > F.col("prev_t"), (t - F.col("prev_t")) / (F.col("t") - F.col("prev_t"))).otherwise(0.0)
    inside = k.select(
        "episode",
        "k",
        F.when(F.col("pos") == 0, F.col("speed"))
        .otherwise(F.col("prev_speed") + (F.col("speed") - F.col("prev_speed")) * share)
        .alias("value"),
    )
    ends = points.groupBy("episode").agg(F.max_by(F.struct("t", "speed"), "t").alias("e")).select("episode", "e.*")
    ends = ends.join(grid, "episode")
    after = ends.select("episode", F.col("speed").alias("value"), _fill(F.greatest(at("t") + 1, F.lit(0).cast("bigint")), limit).alias("k"))
    return inside.unionByName(after.select("episode", "k", "value"))


def resample(series: DataFrame, hz: int, bounds: DataFrame, scale=lambda state: state, extra: Sequence[str] = ()) -> DataFrame:
    """(episode, k, state) at ts0 + k/hz from the first to the last frame.

    `bounds` has t0 and the columns `extra` of the episodes wanted; `scale` is applied to
    both frames around a sample before they are interpolated.
    """
    framed = row_series.attach(series, KEY, bounds.select("episode", "t0", *extra))
    step = 1.0 / hz
    at = lambda t: F.floor((F.col(t) - F.col("t0")) / step).cast("bigint")
    first = F.when(F.col("frame") == 0, F.lit(0).cast("bigint")).otherwise(at("prev_ts") + 1)
    pair = framed.select("*", scale(F.col("state")).alias("_to"), scale(F.col("prev_state")).alias("_from"))
    k = pair.select("*", _fill(first, at("ts")).alias("k"))
    t = F.col("t0") + F.col("k") * step
    share = F.when(F.col("ts") > F.col("prev_ts"), (t - F.col("prev_ts")) / (F.col("ts") - F.col("prev_ts"))).otherwise(0.0)
    state = F.when(F.col("frame") == 0, F.col("_to")).otherwise(F.zip_with("_from", "_to", lambda a, b: a + (b - a) * F.col("share")))
    return k.withColumn("share", share).select("episode", "k", state.alias("state"))


def episode_bounds(frames: DataFrame) -> DataFrame:
    """First and last time and frame count per episode."""
    return frames.groupBy("episode").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("frames")
    )
