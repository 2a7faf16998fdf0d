"""The given tables read in the roles the jobs expect.

Each role has a Spark view and the same view as SQL text, so a query and its
SQL start from one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS = tuple(f"check_{i}" for i in range(1, 8))
# enabled except check_7; check_1 and check_2 block; check_1..3 may emit a fail
CONFIG = {
    c: {"enabled": i != 7, "blocking": i in (1, 2), "emit_fail": i <= 3}
    for i, c in enumerate(CHECKS, start=1)
}
ANCHOR_EVERY = 500
CHUNK_BITS = 12  # 4096 consecutive log indices per chunk
DAY_S = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Unix seconds of a timestamp without zone."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def index_chunk(column: str = "idx") -> Column:
    return F.shiftright(F.col(column), CHUNK_BITS)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per issued claim; `order_*` break ties in log order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("subject"),
        F.concat(F.lit("check_"), F.col("l_linenumber").cast("string")).alias("check"),
        F.when(F.col("l_returnflag") == "R", "fail")
        .when(F.col("l_returnflag") == "A", "pass")
        .otherwise("inconclusive")
        .alias("result"),
        seconds("l_shipdate").alias("issued_at"),
        F.col("l_suppkey").alias("verifier"),
        F.col("l_partkey").alias("order_part"),
        F.col("l_suppkey").alias("order_supp"),
        F.col("l_extendedprice").alias("order_price"),
        F.col("l_quantity").alias("order_quantity"),
        F.col("l_discount").alias("order_discount"),
        F.col("l_tax").alias("order_tax"),
    )


CLAIM_ORDER = ("order_part", "order_supp", "order_price", "order_quantity", "order_discount", "order_tax")
CLAIMS_SQL = """
claims AS (
  SELECT l_orderkey AS subject, 'check_' || l_linenumber AS "check",
         CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'pass' ELSE 'inconclusive' END AS result,
         CAST(epoch(l_shipdate) AS BIGINT) AS issued_at, l_suppkey AS verifier,
         l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
  FROM lineitem)"""
CLAIM_ORDER_SQL = "l_partkey {d}, l_suppkey {d}, l_extendedprice {d}, l_quantity {d}, l_discount {d}, l_tax {d}, result {d}"
LATEST_SQL = (
    CLAIMS_SQL
    + """,
latest AS (
  SELECT subject, "check", result, issued_at, verifier FROM (
    SELECT *, row_number() OVER (PARTITION BY subject, "check" ORDER BY issued_at DESC, """
    + CLAIM_ORDER_SQL.format(d="ASC")
    + """) AS rn
    FROM claims) WHERE rn = 1)"""
)
CONFIG_SQL = (
    'config("check", enabled, blocking, emit_fail) AS (VALUES '
    + ", ".join(f"('{c}', {v['enabled']}, {v['blocking']}, {v['emit_fail']})" for c, v in CONFIG.items())
    + ")"
)


def episode_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the badge rules need to know about each logged episode."""
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("subject"),
        (F.col("o_orderstatus") != "P").alias("anchored"),
        (F.col("o_custkey") % 3 != 0).alias("signed"),
        (F.col("o_custkey") % 5 != 0).alias("key_valid"),
        F.when(priority.isin("1", "2"), 2).otherwise(0).alias("attestation_level"),
        F.when(priority == "1", "teleop_real")
        .when(priority == "2", "autonomous_real")
        .when(priority == "3", "sim")
        .when(priority == "4", "teleop_sim")
        .otherwise("mixed")
        .alias("source"),
        F.when(F.col("o_custkey") % 3 == 1, "robot_controller").otherwise("signer_device").alias("attested_subject"),
        (F.col("o_orderstatus") == "F").alias("has_video"),
        F.concat(F.lit("org-"), F.col("o_custkey").cast("string")).alias("org"),
        F.concat(F.lit("maker-"), (F.col("o_custkey") % 7).cast("string")).alias("manufacturer"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 11).cast("string")).alias("model"),
    )


FACTS_SQL = """
facts AS (
  SELECT o_orderkey AS subject, o_orderstatus <> 'P' AS anchored, o_custkey % 3 <> 0 AS signed,
         o_custkey % 5 <> 0 AS key_valid,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 2 ELSE 0 END AS attestation_level,
         CASE o_orderpriority[1] WHEN '1' THEN 'teleop_real' WHEN '2' THEN 'autonomous_real'
              WHEN '3' THEN 'sim' WHEN '4' THEN 'teleop_sim' ELSE 'mixed' END AS source,
         CASE WHEN o_custkey % 3 = 1 THEN 'robot_controller' ELSE 'signer_device' END AS attested_subject,
         o_orderstatus = 'F' AS has_video, 'org-' || o_custkey AS org,
         'maker-' || (o_custkey % 7) AS manufacturer, 'model-' || (o_custkey % 11) AS model
  FROM orders)"""


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log leaves: idx is dense from 0, the leaf hashes a short record text."""
    from ..functions.hashing import leaf_hash, utf8

    record = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", cents("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        leaf_hash(utf8(record)).alias("leaf"),
        seconds("o_orderdate").alias("received_at"),
        F.col("o_custkey").alias("org"),
    )


LEAVES_SQL = """
leaves AS (
  SELECT o_orderkey AS idx,
         unhex(sha256('\\x00'::BLOB || encode(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' ||
               CAST(round(o_totalprice * 100) AS BIGINT)))) AS leaf,
         CAST(epoch(o_orderdate) AS BIGINT) AS received_at, o_custkey AS org
  FROM orders)"""


def document_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.hashing import leaf_hash, utf8

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), leaf_hash(utf8(F.col("text"))).alias("leaf")
    )


DOC_LEAVES_SQL = """
leaves AS (
  SELECT doc_id AS idx, unhex(sha256('\\x00'::BLOB || encode(text))) AS leaf FROM documents)"""


def anchor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published heads: after every 500th record, and one at the end."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    every = orders.filter((F.col("idx") + 1) % ANCHOR_EVERY == 0).select((F.col("idx") + 1).alias("size"))
    last = orders.agg((F.max("idx") + 1).alias("size"))
    return every.union(last).distinct().withColumn(
        "anchor_idx", (F.ceil(F.col("size") / ANCHOR_EVERY) - 1).cast("bigint")
    )


ANCHORS_SQL = f"""
anchors AS (
  SELECT DISTINCT size, CAST(ceil(size / {ANCHOR_EVERY}.0) AS BIGINT) - 1 AS anchor_idx FROM (
    SELECT o_orderkey + 1 AS size FROM orders WHERE (o_orderkey + 1) % {ANCHOR_EVERY} = 0
    UNION ALL SELECT max(o_orderkey) + 1 FROM orders))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame series: one episode per user; a day of the table is one second."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"),
        (micros("ts") / F.lit(DAY_S * 1e6)).alias("ts"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("value").alias("v0"),
        F.get_json_object("props", "$.k").cast("double").alias("v1"),
    )


FRAMES_SQL = f"""
frames AS (
  SELECT user_id AS episode, epoch_us(ts) / {DAY_S * 1e6} AS ts, event_id, event_type, value AS v0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v1
  FROM events)"""
FRAME_KEY = ("episode",)
FRAME_ORDER = ("ts", "event_id")


def frame_chunk() -> Column:
    """Eight proxy seconds per chunk keep a window well below an episode."""
    return F.floor(F.col("ts") / 8).cast("bigint")
