"""Claims, badges and wording over the claim and record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import badges as B
from ..operators.row_series import numbered
from . import proxies as P
from .registry import query


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = B.latest_claims(P.claims(spark, sf_dir), P.CLAIM_ORDER)
    return B.fold_badges(P.episode_facts(spark, sf_dir), latest, P.CONFIG)


FOLD_SQL = (
    P.LATEST_SQL + ", " + P.CONFIG_SQL + ", " + P.FACTS_SQL + """,
per_subject AS (
  SELECT subject,
         count(*) FILTER (c.enabled AND c.blocking AND result = 'pass') AS blocking_passed,
         count(*) FILTER (c.enabled AND result = 'fail') AS enabled_failed,
         string_agg(l."check", ', ' ORDER BY l."check") FILTER (result = 'fail' AND coalesce(c.enabled, true)) AS failed,
         string_agg(l."check", ', ' ORDER BY l."check") FILTER (result = 'pass' AND c.enabled) AS passed,
         count(*) FILTER (result = 'pass' AND c.enabled) AS n_passed
  FROM latest l LEFT JOIN config c ON l."check" = c."check" GROUP BY subject),
folded AS (
  SELECT f.*, NOT anchored AS pending,
         anchored AND signed AND key_valid AS l1,
         anchored AND signed AND key_valid AND attestation_level = 2 AS l2,
         anchored AND coalesce(enabled_failed, 0) = 0 AND coalesce(blocking_passed, 0) =
           (SELECT count(*) FROM config WHERE enabled AND blocking) AS l3,
         CASE WHEN anchored THEN coalesce(failed, '') ELSE '' END AS failed,
         CASE WHEN anchored THEN coalesce(passed, '') ELSE '' END AS passed,
         CASE WHEN anchored THEN coalesce(n_passed, 0) ELSE 0 END AS n_passed
  FROM facts f LEFT JOIN per_subject p USING (subject)),
badged AS (
  SELECT *, concat_ws(' + ', CASE WHEN anchored THEN 'L0' END, CASE WHEN l1 THEN 'L1' END,
                      CASE WHEN l2 THEN 'L2' END, CASE WHEN l3 THEN 'L3' END) AS badges
  FROM folded)"""
)


@query(
    "latest_claim",
    "WITH " + P.LATEST_SQL + ' SELECT subject, "check" AS check_name, result, issued_at FROM latest',
)
def latest_claim(spark, sf_dir):
    latest = B.latest_claims(P.claims(spark, sf_dir), P.CLAIM_ORDER)
    return latest.select("subject", F.col("check").alias("check_name"), "result", "issued_at")


@query("badge_fold", "WITH " + FOLD_SQL + " SELECT subject, badges, pending, failed, passed FROM badged")
def badge_fold(spark, sf_dir):
    return folded(spark, sf_dir).select(
        "subject",
        F.array_join("badges", " + ").alias("badges"),
        "pending",
        F.array_join("failed", ", ").alias("failed"),
        F.array_join("passed", ", ").alias("passed"),
    )


@query(
    "badge_histogram",
    "WITH " + FOLD_SQL + """
SELECT CASE WHEN badges = '' THEN 'none' ELSE badges END AS badge_set, count(*) AS episodes
FROM badged GROUP BY 1""",
)
def badge_histogram(spark, sf_dir):
    return B.badge_histogram(folded(spark, sf_dir))


def _sql_text(template: str, *parts: str) -> str:
    pieces = template.split("%s")
    out = []
    for i, piece in enumerate(pieces):
        out.append("'" + piece.replace("'", "''") + "'")
        if i < len(parts):
            out.append(parts[i])
    return " || ".join(out)


@query(
    "badge_wording",
    "WITH " + FOLD_SQL + f"""
SELECT subject, CASE WHEN pending THEN '{fixed.PENDING_TEXT}' ELSE concat_ws(chr(10),
    {_sql_text(fixed.COMMITTED_TEXT, "subject", "'ledger-1'",
               "CASE WHEN subject % 7 = 0 THEN 'revoked at block ' || (subject + 1) ELSE 'live' END",
               "(subject // 500 + 1) * 500")},
    CASE WHEN l1 THEN {_sql_text(fixed.SIGNED_TEXT, "org")} END,
    CASE WHEN l2 THEN {_sql_text(fixed.ATTESTED_TEXT, "manufacturer", "model")} END,
    CASE WHEN failed <> '' THEN array_to_string(list_transform(string_split(failed, ', '),
         lambda c: {_sql_text(fixed.CHECK_FAILED_TEXT, "c", f"'{fixed.NO_SUMMARY_TEXT}'")}), chr(10)) END,
    CASE WHEN l3 THEN {_sql_text(fixed.CHECKED_TEXT, "'verifier'", "n_passed", "passed")} END) END AS wording
FROM badged""",
)
def badge_wording(spark, sf_dir):
    rows = folded(spark, sf_dir).select(
        "*",
        F.col("subject").alias("block"),
        F.lit("ledger-1").alias("ledger"),
        F.when(F.col("subject") % 7 == 0, F.col("subject") + 1).alias("revoked_block"),
        ((F.floor(F.col("subject") / 500) + 1) * 500).alias("size"),
    )
    return rows.select("subject", F.array_join(B.wording_lines(), "\n").alias("wording"))


LATEST_LAST_SQL = (
    P.CLAIMS_SQL
    + """,
latest_last AS (
  SELECT subject, "check", result FROM (
    SELECT *, row_number() OVER (PARTITION BY subject, "check" ORDER BY issued_at DESC, """
    + P.CLAIM_ORDER_SQL.format(d="DESC").replace("result DESC", "CASE result WHEN 'fail' THEN 0 WHEN 'pass' THEN 2 ELSE 1 END DESC")
    + """) AS rn FROM claims) WHERE rn = 1)"""
)
ATTESTED_SQL = (
    LATEST_LAST_SQL + ", " + P.FACTS_SQL + """,
attested AS (
  SELECT f.*, source IN ('teleop_real', 'autonomous_real') AND attestation_level = 2
         AND attested_subject = 'robot_controller' AND coalesce(s.result = 'pass', false)
         AND (NOT has_video OR coalesce(v.result = 'pass', false)) AS attested
  FROM facts f
  LEFT JOIN latest_last s ON s.subject = f.subject AND s."check" = 'check_5'
  LEFT JOIN latest_last v ON v.subject = f.subject AND v."check" = 'check_4')"""
)


def attested(spark, sf_dir):
    latest = B.latest_claims(P.claims(spark, sf_dir), P.CLAIM_ORDER, ties="last")
    return B.attested_physical(P.episode_facts(spark, sf_dir), latest, "check_5", "check_4")


@query(
    "attested_rule",
    "WITH " + ATTESTED_SQL + f"""
SELECT subject, source, attested, CASE WHEN attested THEN {_sql_text(fixed.ATTESTED_SOURCE_TEXT, "manufacturer", "model")}
  ELSE {_sql_text(fixed.DECLARED_SOURCE_TEXT, "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SOURCE_TEXT.items()) + " END")} END AS line
FROM attested""",
)
def attested_rule(spark, sf_dir):
    return attested(spark, sf_dir).select("subject", "source", "attested", B.source_line().alias("line"))


MEMBERS_SQL = """
members AS (SELECT DISTINCT l_suppkey AS corpus, l_orderkey AS idx FROM lineitem)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections and their member records, duplicates removed."""
    return (
        P.table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("corpus"), F.col("l_orderkey").alias("idx"))
        .dropDuplicates()
    )


@query(
    "source_summary",
    "WITH " + ATTESTED_SQL + ", " + MEMBERS_SQL + f"""
SELECT corpus, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*) AS episodes,
       count(*) FILTER (source IN ('teleop_real', 'autonomous_real')) AS physical,
       count(*) FILTER (attested) AS attested,
       {_sql_text(fixed.SOURCES_SUMMARY_TEXT, "string_agg(DISTINCT source, ', ' ORDER BY source)",
                  "count(*) FILTER (source IN ('teleop_real', 'autonomous_real'))", "count(*)",
                  "count(*) FILTER (attested)")} AS summary
FROM members m JOIN attested a ON m.idx = a.subject GROUP BY corpus""",
)
def source_summary(spark, sf_dir):
    episodes = members(spark, sf_dir).join(attested(spark, sf_dir), F.col("idx") == F.col("subject"))
    return B.source_summary(episodes, ["corpus"])


@query(
    "corpus_sources",
    "WITH " + P.FACTS_SQL + ", " + MEMBERS_SQL + """
SELECT corpus, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM members m JOIN facts f ON m.idx = f.subject GROUP BY corpus""",
)
def corpus_sources(spark, sf_dir):
    facts = P.episode_facts(spark, sf_dir).select("subject", "source")
    return (
        members(spark, sf_dir)
        .join(facts, F.col("idx") == F.col("subject"))
        .groupBy("corpus")
        .agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    )


@query(
    "checks_run",
    "WITH " + P.CLAIMS_SQL + """
SELECT "check" AS check_name, "check" || '.' || l_quantity::BIGINT % 3 AS check_version,
       max_by(round(l_discount, 4), (issued_at, subject, l_partkey, l_suppkey, l_extendedprice, l_tax, l_discount)) AS threshold,
       count(*) AS claims
FROM claims GROUP BY 1, 2""",
)
def checks_run(spark, sf_dir):
    """Checks and versions seen, with the thresholds of the newest claim."""
    rank = F.struct("issued_at", "subject", "order_part", "order_supp", "order_price", "order_tax", "order_discount")
    return (
        P.claims(spark, sf_dir)
        .withColumn("version", F.concat("check", F.lit("."), (F.col("order_quantity").cast("bigint") % 3).cast("string")))
        .groupBy(F.col("check").alias("check_name"), F.col("version").alias("check_version"))
        .agg(F.max_by(F.round("order_discount", 4), rank).alias("threshold"), F.count(F.lit(1)).alias("claims"))
    )


@query(
    "metric_counts",
    "WITH " + P.CLAIMS_SQL + """
SELECT coalesce("check", 'all') AS check_name, coalesce(result, 'all') AS result, count(*) AS claims
FROM claims GROUP BY CUBE ("check", result)""",
)
def metric_counts(spark, sf_dir):
    """Claim counters by check and result, with totals."""
    return (
        P.claims(spark, sf_dir)
        .cube("check", "result")
        .agg(F.count(F.lit(1)).alias("claims"))
        .select(
            F.coalesce("check", F.lit("all")).alias("check_name"), F.coalesce("result", F.lit("all")).alias("result"), "claims"
        )
    )


@query(
    "claim_codes",
    "WITH " + P.CLAIMS_SQL + """
SELECT CAST(substr("check", 7) AS BIGINT) AS check_id,
       CAST(CASE result WHEN 'fail' THEN 0 WHEN 'pass' THEN 1 ELSE 2 END AS BIGINT) AS result_code,
       count(*) AS claims, count(DISTINCT subject) AS subjects
FROM claims GROUP BY 1, 2""",
)
def claim_codes(spark, sf_dir):
    """Names to wire codes. Distinct subjects are counted on pre-combined rows."""
    ids = F.create_map(*(F.lit(x) for i, c in enumerate(P.CHECKS, 1) for x in (c, i)))
    codes = F.create_map(*(F.lit(x) for pair in fixed.RESULT_CODES.items() for x in pair))
    per_subject = (
        P.claims(spark, sf_dir)
        .select(
            F.try_element_at(ids, F.col("check")).cast("bigint").alias("check_id"),
            F.try_element_at(codes, F.col("result")).cast("bigint").alias("result_code"),
            "subject",
        )
        .groupBy("check_id", "result_code", "subject")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_subject.groupBy("check_id", "result_code").agg(
        F.sum("n").alias("claims"), F.count(F.lit(1)).alias("subjects")
    )


@query(
    "claims_by_subject",
    "WITH " + P.CLAIMS_SQL + """
SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY issued_at, """
    + P.CLAIM_ORDER_SQL.format(d="ASC").replace("result ASC", "result")
    + """) - 1 AS position, "check" AS check_name, result, issued_at
FROM claims JOIN orders ON subject = o_orderkey""",
)
def claims_by_subject(spark, sf_dir):
    """Claims of each record in issue order, one row each (no unbounded list)."""
    records = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"))
    rows = P.claims(spark, sf_dir).join(records, "subject")
    return numbered(rows, ["subject"], ["issued_at", *P.CLAIM_ORDER, "result"], "position").select(
        "subject", "position", F.col("check").alias("check_name"), "result", "issued_at"
    )


@query(
    "eligible_members",
    "WITH " + FOLD_SQL + ", " + MEMBERS_SQL + """
SELECT corpus, idx, badges FROM members JOIN badged ON idx = subject
WHERE anchored AND l1 AND failed = ''""",
)
def eligible_members(spark, sf_dir):
    """Members holding the wanted badges and without a failed check."""
    wanted = F.array(F.lit("L0"), F.lit("L1"))
    eligible = folded(spark, sf_dir).filter(
        (F.size(F.array_except(wanted, "badges")) == 0) & (F.size("failed") == 0)
    )
    return (
        members(spark, sf_dir)
        .join(eligible, F.col("idx") == F.col("subject"))
        .select("corpus", "idx", F.array_join("badges", " + ").alias("badges"))
    )


@query(
    "issue_claims",
    "WITH " + P.CLAIMS_SQL + ", " + P.CONFIG_SQL + """,
outcomes AS (
  SELECT subject, c."check" AS check_name, verifier,
         CASE WHEN result = 'fail' AND NOT emit_fail THEN 'inconclusive' ELSE result END AS result,
         CASE WHEN result = 'fail' AND NOT emit_fail THEN 'fail' ELSE '' END AS downgraded_from,
         issued_at, CAST(round(l_discount * 100) AS BIGINT) AS detail
  FROM claims c JOIN config k ON c."check" = k."check"),
old AS (SELECT subject, check_name, verifier, result, downgraded_from, detail, min(issued_at) AS issued_at
        FROM outcomes WHERE issued_at < 915148800 GROUP BY ALL),
new AS (SELECT subject, check_name, verifier, result, downgraded_from, detail, min(issued_at) AS issued_at
        FROM outcomes WHERE issued_at >= 915148800 GROUP BY ALL)
SELECT new.* FROM new LEFT JOIN old USING (subject, check_name, verifier, result, downgraded_from, detail)
WHERE old.subject IS NULL""",
)
def issue_claims_query(spark, sf_dir):
    """New claims only: downgrade, drop repeats, leave out those already logged."""
    from ..operators.checks.issue import downgrade, unissued

    outcomes = downgrade(
        P.claims(spark, sf_dir).filter(F.col("check").isin(*P.CONFIG)).select(
            "subject", F.col("check"), "verifier", "result", "issued_at",
            F.round(F.col("order_discount") * 100).cast("bigint").alias("detail"),
        ),
        P.CONFIG,
    )
    cut = 915148800
    logged = outcomes.filter(F.col("issued_at") < cut)
    fresh = outcomes.filter(F.col("issued_at") >= cut)
    return unissued(fresh, logged).withColumnRenamed("check", "check_name")
