"""Trajectory descriptors, buckets and near-duplicate search over the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import draws
from ..functions import hashing as H
from ..operators.checks import neardup as N
from ..operators.checks.series import frame_series
from ..operators.scale import positions
from . import proxies as P
from .record_rows import _be
from .registry import query

FRAMES, JOINTS = 16, 4


@query(
    "dct_coefficients",
    f"""WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, k AS term, round(sum(v * cos(pi() / n * (i + 0.5) * k)) / any_value(n), 6) AS coefficient
FROM x, range({fixed.DCT_TERMS}) t(k) GROUP BY vec_id, k""",
)
def dct_coefficients(spark, sf_dir):
    """First cosine terms of every series, in the row: no shuffle at all."""
    n = F.size("embedding")
    term = lambda k: F.aggregate(
        F.transform("embedding", lambda v, i: v.cast("double") * F.cos(F.lit(math.pi) / n * (i + 0.5) * k)), F.lit(0.0), lambda a, x: a + x
    ) / n
    terms = F.transform(F.expr(f"sequence(0L, {fixed.DCT_TERMS - 1}L)"), lambda k: F.struct(k.alias("term"), F.round(term(k), 6).alias("coefficient")))
    return P.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(terms).alias("t")).select("vec_id", "t.*")


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            numbers = N.sign_buckets(np.stack([np.asarray(v, dtype=float) for v in pdf["embedding"]]))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "buckets": list(numbers)})


def vector_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    numbered = rows.mapInPandas(_buckets, "vec_id bigint, label int, buckets array<bigint>")
    return numbered.select("vec_id", "label", F.posexplode("buckets").alias("table_no", "bucket")).withColumn("table_no", F.col("table_no").cast("bigint"))


def _planes_sql(dim: int = 64, name: str = "planes") -> str:
    rows = N.planes(dim)
    values = ", ".join(f"({i // fixed.LSH_PLANES}, {i % fixed.LSH_PLANES}, [{', '.join(map(repr, map(float, r)))}])" for i, r in enumerate(rows))
    return f"{name}(table_no, p, normal) AS (VALUES {values})"


def search_sql(dof: int) -> str:
    """CTEs from trajectories to `nearest(idx, nearest, d)`, after WITH RECURSIVE.

    Reads traj(idx, kind, n, f): f is a list of n frames of `dof` scaled joints. Buckets come from
    the descriptor, the distance from its table row by row: a cell is the sum of costs along
    its row since the best cell of the row before from which that run can start.
    """
    bins, terms, width = fixed.HISTOGRAM_BINS, fixed.DCT_TERMS, 2.0 / fixed.HISTOGRAM_BINS
    joint = f"""list_transform(range(0, {bins}), lambda b: len(list_filter(range(1, n), lambda i:
      greatest(least(floor((f[i + 1][j + 1] - f[i][j + 1] + 1.0) / {width!r}), {bins - 1}), 0) = b)) / greatest(n - 1, 1)::DOUBLE)
      || list_transform(range(0, {terms}), lambda k: list_sum(list_transform(range(0, n), lambda i: f[i + 1][j + 1] * cos(pi() / n * (i + 0.5) * k))) / n)"""
    return _planes_sql(dof * (bins + terms), "normals") + f""",
distinct_ones AS MATERIALIZED (SELECT *, min(idx) OVER (PARTITION BY kind, n, f) AS first FROM traj),
described AS MATERIALIZED (
  SELECT idx, kind, n, f, flatten(list_transform(range(0, {dof}), lambda j: {joint})) AS vec FROM distinct_ones WHERE idx = first),
signs AS MATERIALIZED (
  SELECT idx, kind, table_no, sum(CASE WHEN list_dot_product(vec, normal::DOUBLE[]) >= 0 THEN 1::BIGINT << p ELSE 0 END) AS bucket
  FROM described, normals GROUP BY idx, kind, table_no),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.idx AS probe, b.idx AS candidate FROM signs a JOIN signs b
  ON a.kind = b.kind AND a.table_no = b.table_no AND a.bucket = b.bucket AND b.idx < a.idx),
matched AS MATERIALIZED (
  SELECT probe, candidate, a.n AS n, b.n AS m, a.f AS f, list_transform(b.f, lambda r: list_transform(r, lambda v: v::FLOAT::DOUBLE)) AS g,
    greatest(1, ceil({fixed.WARP_BAND} * greatest(a.n, b.n))::BIGINT, abs(a.n - b.n)) AS band
  FROM pairs JOIN described a ON a.idx = probe JOIN described b ON b.idx = candidate),
warp AS (
  SELECT probe, candidate, 0::BIGINT AS i, [0::DOUBLE] || list_transform(range(0, m), lambda j: 'Infinity'::DOUBLE) AS row FROM matched
  UNION ALL
  SELECT probe, candidate, i + 1, list_transform(range(0, m + 1), lambda j: CASE WHEN j - 1 < lo OR j - 1 > hi THEN 'Infinity'::DOUBLE
      ELSE total[j - lo] + list_min(slack[1:j - lo]) END)
  FROM (SELECT *, list_transform(range(1, hi - lo + 2), lambda q: reach[q] - (total[q] - cost[q])) AS slack FROM (
    SELECT *, list_transform(range(1, hi - lo + 2), lambda q: list_sum(cost[1:q])) AS total FROM (
      SELECT w.probe, w.candidate, w.i, m, greatest(0, w.i - band) AS lo, least(m - 1, w.i + band) AS hi,
        list_transform(range(greatest(0, w.i - band), least(m - 1, w.i + band) + 1), lambda j:
          sqrt(list_sum(list_transform(range(1, {dof + 1}), lambda x: (f[w.i + 1][x] - g[j + 1][x]) * (f[w.i + 1][x] - g[j + 1][x]))))) AS cost,
        list_transform(range(greatest(0, w.i - band), least(m - 1, w.i + band) + 1), lambda j: least(w.row[j + 1], w.row[j + 2])) AS reach
      FROM warp w JOIN matched s ON w.probe = s.probe AND w.candidate = s.candidate WHERE w.i < s.n)))),
measured AS (SELECT w.probe, w.candidate, w.row[s.m + 1] / (s.n + s.m) AS d FROM warp w JOIN matched s ON w.probe = s.probe AND w.candidate = s.candidate WHERE w.i = s.n),
nearest AS (
  SELECT probe AS idx, arg_min(candidate, (round(d, 12), candidate)) AS nearest, min(d) AS d FROM measured GROUP BY probe
  UNION ALL SELECT idx, first, 0.0 FROM distinct_ones WHERE idx > first)"""


def verdict_sql(d: str = "d") -> dict[str, str]:
    """Columns of the verdict of a comparable episode."""
    return {
        "result": f"CASE WHEN {d} < {fixed.NEAR_DISTANCE} THEN 'inconclusive' ELSE 'pass' END",
        "downgraded_from": f"CASE WHEN {d} < {fixed.EXACT_DISTANCE} THEN 'fail' ELSE '' END",
    }


VECTOR_TRAJECTORIES_SQL = f"""
cells AS (SELECT vec_id AS idx, label AS kind, i // {JOINTS} AS k, i % {JOINTS} AS j, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, {FRAMES * JOINTS}) t(i)),
scaled AS (
  SELECT idx, kind, k, j, CASE WHEN lo < hi THEN (v - lo) / (hi - lo) ELSE 0.5 END AS v
  FROM (SELECT *, min(v) OVER (PARTITION BY idx, j) AS lo, max(v) OVER (PARTITION BY idx, j) AS hi FROM cells)),
rows_of AS (SELECT idx, kind, k, list(v ORDER BY j) AS r FROM scaled GROUP BY idx, kind, k),
traj AS MATERIALIZED (SELECT idx, kind, count(*) AS n, list(r ORDER BY k) AS f FROM rows_of GROUP BY idx, kind)"""


BUCKETS_SQL = _planes_sql() + """,
buckets AS (
  SELECT vec_id, label, table_no::BIGINT AS table_no,
    CAST(sum(CASE WHEN list_dot_product(embedding::DOUBLE[], normal::DOUBLE[]) >= 0 THEN 1 << p ELSE 0 END) AS BIGINT) AS bucket
  FROM embeddings, planes GROUP BY vec_id, label, table_no)"""


@query("lsh_buckets", "WITH " + BUCKETS_SQL + " SELECT vec_id, table_no, bucket FROM buckets")
def lsh_buckets(spark, sf_dir):
    return vector_buckets(spark, sf_dir).select("vec_id", "table_no", "bucket")


@query(
    "lsh_candidates",
    "WITH " + BUCKETS_SQL + """
SELECT vec_id, table_no, row_number() OVER (PARTITION BY label, table_no, bucket ORDER BY vec_id) - 1 AS earlier FROM buckets""",
)
def lsh_candidates(spark, sf_dir):
    """How many earlier rows of the same kind share each bucket, without building pairs."""
    return positions(
        vector_buckets(spark, sf_dir), ["label", "table_no", "bucket"], ["vec_id"], P.index_chunk("vec_id"), name="earlier"
    ).select("vec_id", "table_no", "earlier")


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as short recordings: 16 frames of 4 joints at 10 Hz, row by row."""
    rows = P.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(FRAMES - 1)),
        lambda i: F.struct(i.cast("bigint").alias("frame_index"), (i / 10.0).alias("ts"), F.slice("embedding", i * JOINTS + 1, JOINTS).cast("array<double>").alias("state")),
    )
    return rows.select(F.col("vec_id").alias("episode"), F.explode(cut).alias("x")).select("episode", "x.*")


def vector_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("episode"), F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("embodiment"),
        F.lit(None).cast("array<array<double>>").alias("joint_limits"),
    )


NEAREST_SQL = "WITH RECURSIVE " + VECTOR_TRAJECTORIES_SQL + ", " + search_sql(JOINTS)


@query(
    "near_duplicates",
    NEAREST_SQL + f"""
SELECT t.idx AS episode, {verdict_sql()['result']} AS result, '' AS reason, {verdict_sql()['downgraded_from']} AS downgraded_from,
  nearest, round(d, 6) AS d, row_number() OVER (ORDER BY t.idx) - 1 AS index_snapshot
FROM traj t LEFT JOIN nearest x ON t.idx = x.idx""",
)
def near_duplicates(spark, sf_dir):
    """Verdict of the near-duplicate check for every recording."""
    out = N.neardup_check(frame_series(vector_frames(spark, sf_dir), ["frame_index"]), vector_episodes(spark, sf_dir))
    return out.drop("compared").withColumn("d", F.round("d", 6))


@query("nearest_neighbour", NEAREST_SQL + " SELECT idx AS episode, nearest, round(d, 6) AS d FROM nearest")
def nearest_neighbour(spark, sf_dir):
    """Nearest earlier candidate by warping distance, for recordings that have one."""
    return near_duplicates(spark, sf_dir).filter(F.col("nearest").isNotNull()).select("episode", "nearest", "d")


# ---------------------------------------------------------------- variants


def noise(identity, seed, index):
    """Standard normal from two hash draws, the same in every engine."""
    first = F.greatest(draws.unit(identity, seed, index * 2), F.lit(1e-12))
    second = draws.unit(identity, seed, index * 2 + 1)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2 * math.pi) * second)


def _unit_sql(index: str) -> str:
    return (
        f"((CAST(('0x' || substr(sha256(unhex(sha256(encode('jitter'))) || unhex({_be('event_id', 8)}) || unhex({_be(index, 4)})), 1, 14)) AS BIGINT) >> 3)"
        " / 9007199254740992.0::DOUBLE)"
    )


@query(
    "jitter_variants",
    "WITH " + P.FRAMES_SQL + f"""
SELECT episode, event_id, round(ts * 1.1, 6) AS slower, round(ts * 0.9, 6) AS faster,
  round(v0 + 0.5 * sqrt(-2.0 * ln(greatest({_unit_sql('0')}, 1e-12))) * cos(2 * pi() * {_unit_sql('1')}), 6) AS v0,
  round(v1 + 0.5 * sqrt(-2.0 * ln(greatest({_unit_sql('2')}, 1e-12))) * cos(2 * pi() * {_unit_sql('3')}), 6) AS v1 FROM frames""",
)
def jitter_variants(spark, sf_dir):
    """Test variants of a series: noise on every joint, a slower and a faster clock."""
    identity = H.digest(H.utf8(F.lit("jitter")))
    wobble = lambda c, joint: F.round(F.col(c) + 0.5 * noise(identity, F.col("event_id"), F.lit(joint)), 6).alias(c)
    return P.frames(spark, sf_dir).select(
        "episode", "event_id", F.round(F.col("ts") * 1.1, 6).alias("slower"), F.round(F.col("ts") * 0.9, 6).alias("faster"), wobble("v0", 0), wobble("v1", 1)
    )


@query("detection_rates")
def detection_rates(spark, sf_dir):
    """How many exact, noisy and time-warped variants of all recordings are found."""
    frames, episodes = vector_frames(spark, sf_dir), vector_episodes(spark, sf_dir)
    shift = 1 << 40  # variants are logged after every original
    identity = H.digest(H.utf8(F.lit("detect")))

    def variant(number: int, ts, sigma: float) -> tuple[DataFrame, DataFrame]:
        moved = lambda c: (F.col(c) + number * shift).alias(c)
        state = F.transform(
            "state", lambda v, j: v + sigma * noise(identity, F.col("episode") * FRAMES + F.col("frame_index"), j)
        ) if sigma else F.col("state")
        return frames.select(moved("episode"), "frame_index", ts.alias("ts"), state.alias("state")), episodes.select(moved("episode"), moved("idx"), "embodiment", "joint_limits")

    ts = F.col("ts")
    kinds = {1: ("exact", variant(1, ts, 0.0)), 2: ("noisy", variant(2, ts, 0.001)), 3: ("slower", variant(3, ts * 1.1, 0.0)), 4: ("faster", variant(4, ts * 0.9, 0.0))}
    for _, (f, e) in kinds.values():
        frames, episodes = frames.unionByName(f), episodes.unionByName(e)
    out = N.neardup_check(frame_series(frames, ["frame_index"]), episodes)
    names = F.create_map(F.lit(0), F.lit("distinct"), *(F.lit(x) for n, (name, _) in kinds.items() for x in (n, name)))
    kind = F.try_element_at(names, F.floor(F.col("episode") / shift).cast("int")).alias("kind")
    return out.groupBy(kind).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(F.coalesce(F.col("d") < fixed.EXACT_DISTANCE, F.lit(False))).alias("exact"),
        F.count_if(F.coalesce(F.col("d") < fixed.NEAR_DISTANCE, F.lit(False))).alias("near"),
    )
