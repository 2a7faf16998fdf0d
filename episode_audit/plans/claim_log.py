"""Claims with detail, record, leaf and index, appended to a growing log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import hashing as H
from ..operators.checks import claim_log as L
from ..operators.growing_tree import GrowingTree
from ..session import checkpoint_folder
from . import proxies as P
from .digests import LEVELS, tree_sql
from .record_rows import _be
from .registry import query

NAMES = tuple(fixed.CHECK_THRESHOLDS)
CUT = 915148800  # claims issued before this second are in the log already
VERIFIER = "check runner"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check outcome for each of the first five lines of an order."""
    names = F.array(*map(F.lit, NAMES))
    return P.table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") <= len(NAMES)).select(
        F.col("l_orderkey").alias("episode"),
        F.get(names, F.col("l_linenumber") - 1).alias("check"),
        F.concat(F.get(names, F.col("l_linenumber") - 1), F.lit(".0")).alias("check_version"),
        F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "pass").otherwise("inconclusive").alias("result"),
        F.when(F.col("l_returnflag") == "R", "too much").otherwise("").alias("reason"),
        F.lit("").alias("downgraded_from"),
        F.create_map(F.lit("score"), F.col("l_quantity")).alias("findings"),
        P.seconds("l_shipdate").alias("at"),
    )


def _thresholds_sql() -> str:
    def text(name: str) -> str:
        known = fixed.CHECK_THRESHOLDS[name]
        return ",".join(f'"{k}":{float(known[k])!r}' for k in sorted(known))

    return "[" + ", ".join("'{" + text(n) + "}'" for n in NAMES) + "]"


CHECKS_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
IDS_SQL = "[" + ", ".join(str(fixed.CHECK_IDS[n]) for n in NAMES) + "]"
MAY_FAIL_SQL = "[" + ", ".join(str(fixed.CHECK_SETTINGS[n]["emit_fail"]).lower() for n in NAMES) + "]"
CLAIM_ROWS_SQL = f"""
outcome AS (
  SELECT l_orderkey AS episode, {CHECKS_SQL}[l_linenumber] AS name, l_linenumber AS nth, l_returnflag AS flag,
    l_returnflag = 'R' AND NOT {MAY_FAIL_SQL}[l_linenumber] AS held, l_quantity AS quantity, CAST(epoch(l_shipdate) AS BIGINT) AS issued_at
  FROM lineitem WHERE l_linenumber <= {len(NAMES)}),
claim AS (
  SELECT unhex(sha256(encode('episode-' || episode))) AS subject, name, nth, issued_at,
    CASE WHEN flag = 'A' THEN 'pass' WHEN flag = 'R' AND NOT held THEN 'fail' ELSE 'inconclusive' END AS result,
    '{{"check_version":"' || name || '.0",' || CASE WHEN held THEN '"downgraded_from":"fail",' ELSE '' END || '"findings":{{"score":' || quantity::VARCHAR || '}},'
      || CASE WHEN flag = 'R' THEN '"reason":"too much",' ELSE '' END || '"thresholds":' || {_thresholds_sql()}[nth] || '}}' AS detail
  FROM outcome),
logged AS (SELECT DISTINCT subject, name, result, detail FROM claim WHERE issued_at < {CUT}),
fresh AS (SELECT subject, name, any_value(nth) AS nth, result, detail, min(issued_at) AS issued_at FROM claim WHERE issued_at >= {CUT} GROUP BY subject, name, result, detail),
news AS (SELECT * FROM fresh ANTI JOIN logged USING (subject, name, result, detail)),
placed AS (SELECT *, row_number() OVER (ORDER BY subject, name, result, sha256(encode(detail))) - 1 AS idx FROM news),
record AS (
  SELECT *, '\\x04'::BLOB || subject || unhex(sha256(encode('{VERIFIER}'))) || unhex(sha256(encode(detail))) || unhex(sha256(encode('signed by ' || hex(subject))))
    || unhex({_be(IDS_SQL + '[nth]', 2)}) || unhex({_be("CASE result WHEN 'fail' THEN 0 WHEN 'pass' THEN 1 ELSE 2 END", 1)}) || '\\x03'::BLOB || unhex({_be('issued_at', 8)}) AS record
  FROM placed),
leaves AS (SELECT idx, unhex(sha256('\\x00'::BLOB || record)) AS leaf FROM record)"""


def logged(spark: SparkSession, sf_dir: str):
    """New claims with record, leaf and idx, and the head of the log that holds them."""
    rows = outcomes(spark, sf_dir)
    subjects = rows.select("episode").distinct().withColumn("subject", H.digest(H.utf8(F.concat(F.lit("episode-"), F.col("episode").cast("string")))))
    claims = L.claims_of(rows, subjects, VERIFIER, F.col("at"), fixed.CHECK_SETTINGS)
    tree = GrowingTree(spark, f"{checkpoint_folder(spark)}/claims-{uuid.uuid4().hex}")
    signature = F.concat(F.lit("signed by "), F.hex("subject"))
    return L.log_claims(claims.filter(F.col("issued_at") >= CUT), claims.filter(F.col("issued_at") < CUT), tree, "run", signature)


@query(
    "logged_claims",
    "WITH " + CLAIM_ROWS_SQL + """
SELECT idx, lower(hex(subject)) AS subject, name AS check_name, result, detail, sha256(encode(detail)) AS detail_hash, issued_at,
  octet_length(record)::BIGINT AS record_bytes, lower(hex(leaf)) AS leaf FROM record JOIN leaves USING (idx)""",
)
def logged_claims(spark, sf_dir):
    """Every new claim with its thresholds, findings, detail hash, leaf and place in the log."""
    rows, _ = logged(spark, sf_dir)
    return rows.select(
        "idx", H.hex_text(F.col("subject")).alias("subject"), F.col("check").alias("check_name"), "result", "detail",
        H.hex_text(F.col("detail_hash")).alias("detail_hash"), "issued_at", F.length("record").cast("bigint").alias("record_bytes"),
        H.hex_text(F.col("leaf")).alias("leaf"),
    )


@query(
    "claim_log_head",
    "WITH " + CLAIM_ROWS_SQL + ", " + tree_sql() + f" SELECT (SELECT count(*) FROM leaves) AS size, lower(hex(h)) AS root FROM t{LEVELS}",
)
def claim_log_head(spark, sf_dir):
    """Size and root of the log after the new claims were appended."""
    rows, head = logged(spark, sf_dir)
    count = rows.agg(F.count(F.lit(1)).alias("size"))
    return count.select("size", F.lit(head.root.hex()).alias("root"))
