"""From check outcomes to claims in the log: detail, downgrade, record, leaf, index, append."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ... import fixed_values as fixed
from ...functions import hashing as H
from ...functions.records import encode
from ..growing_tree import GrowingTree, Head
from ..row_series import numbered, stored
from .issue import downgrade

IDENTITY = ("subject", "check", "verifier", "result", "detail_hash")
LEVEL = 3  # what an automatic check asserts


def thresholds_of(check: Column, overrides: Mapping[str, Mapping[str, float]] | None = None) -> Column:
    """map<string,double> of the thresholds a check works with; null for an unknown check."""
    out = F.lit(None).cast("map<string,double>")
    for name, known in fixed.CHECK_THRESHOLDS.items():
        values = known | dict((overrides or {}).get(name, {}))
        pairs = [F.lit(x) for k in sorted(values) for x in (k, float(values[k]))]
        out = F.when(check == name, F.create_map(*pairs)).otherwise(out)
    return out


def detail_text(outcome_columns: list[str], overrides: Mapping[str, Mapping[str, float]] | None = None) -> Column:
    """Detail as JSON with sorted keys: version, thresholds, findings and, where they say something, reason and downgrade."""
    findings = F.col("findings") if "findings" in outcome_columns else F.lit(None).cast("map<string,double>")
    in_order = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.to_json(
        F.struct(
            F.col("check_version"),
            F.when(F.col("downgraded_from") != "", F.col("downgraded_from")).alias("downgraded_from"),
            F.when(F.size(findings) > 0, in_order(findings)).alias("findings"),
            F.when(F.col("reason") != "", F.col("reason")).alias("reason"),
            thresholds_of(F.col("check"), overrides).alias("thresholds"),
        )
    )


def claims_of(
    outcomes: DataFrame,
    subjects: DataFrame,
    verifier: str,
    issued_at: Column | int,
    config: Mapping[str, Mapping[str, bool]],
    overrides: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Outcome rows as claims ready to be logged, before repeats are dropped.

    outcomes: episode, check, check_version, result, reason, downgraded_from and (if there) findings.
    subjects: episode, subject (the 32-byte leaf the claim is about). A failure of a
    check that may not fail is held at inconclusive and says so in its detail.
    """
    held = downgrade(outcomes.withColumn("_before", F.col("downgraded_from")), config)
    held = held.withColumn("downgraded_from", F.when(F.col("downgraded_from") != "", F.col("downgraded_from")).otherwise(F.col("_before")))
    held = held.withColumn("detail", detail_text(outcomes.columns, overrides)).join(subjects.select("episode", "subject"), "episode")
    return held.select(
        "subject", "check", F.unhex(F.sha2(F.lit(verifier).cast("binary"), 256)).alias("verifier"), "result", "detail",
        H.digest(H.utf8(F.col("detail"))).alias("detail_hash"),
        (issued_at if isinstance(issued_at, Column) else F.lit(issued_at)).cast("bigint").alias("issued_at"),
    )


def refused(claims: DataFrame) -> DataFrame:
    """(subject, check, problem): claims that must not be logged."""
    problem = (
        F.when(~F.col("check").isin(*fixed.CHECK_IDS), "unknown check")
        .when(F.coalesce(F.get_json_object("detail", "$.check_version"), F.lit("")) == "", "detail missing check_version")
        .when(F.get_json_object("detail", "$.thresholds").isNull(), "detail missing thresholds")
        .when(~(F.col("issued_at") > 0), "issue time zero")
    )
    return claims.select("subject", "check", problem.alias("problem")).filter(F.col("problem").isNotNull())


def record_of(signature: Column) -> Column:
    """The fixed-width record of a claim row; `signature` is the signed text, an input."""
    return encode(
        fixed.CLAIM_LAYOUT,
        {
            "subject_leaf": F.col("subject"),
            "verifier_key_id": F.col("verifier"),
            "detail_hash": F.col("detail_hash"),
            "signature_hash": H.digest(H.utf8(signature)),
            "check_id": F.get(F.map_values(F.map_filter(_ids(), lambda k, _: k == F.col("check"))), 0),
            "result": F.get(F.map_values(F.map_filter(_codes(), lambda k, _: k == F.col("result"))), 0),
            "level_asserted": F.lit(LEVEL),
            "issued_at": F.col("issued_at"),
        },
    )


def _ids() -> Column:
    return F.create_map(*(F.lit(x) for item in fixed.CHECK_IDS.items() for x in item))


def _codes() -> Column:
    return F.create_map(*(F.lit(x) for item in fixed.RESULT_CODES.items() for x in item))


def log_claims(claims: DataFrame, logged: DataFrame, tree: GrowingTree, batch: str, signature: Column | None = None) -> tuple[DataFrame, Head]:
    """Append the claims that are new; returns them with record, leaf and idx, and the head after them.

    `logged` holds earlier claims (columns `IDENTITY`). A claim is new if none there agrees on all
    five; of repeats in the batch the first issued counts. Claims that `refused` names
    are left out. Indices follow the order (subject, check, verifier, result, detail_hash).
    A batch that the tree already holds is not appended again.
    """
    bad = refused(claims).select("subject", "check").distinct()
    fit = claims.join(bad, ["subject", "check"], "left_anti")
    first = fit.groupBy(*IDENTITY).agg(F.min(F.struct("issued_at", "detail")).alias("_first"))
    new = first.join(logged.select(*IDENTITY).distinct(), list(IDENTITY), "left_anti").select(*IDENTITY, "_first.*")
    signed = signature if signature is not None else F.lit("")
    # kept once: numbering counts, samples and sorts its rows, each of which would work the claims out again
    kept = stored(new, "claims")
    done = tree.head(batch)
    size = done.first if done else (tree.head() or Head("", "", 0, 0, b"", [])).size
    # records and leaves follow from the rest of a row: they are neither dealt out nor written with it
    placed = stored(numbered(kept, [], list(IDENTITY), "_pos").withColumn("idx", F.col("_pos") + size).drop("_pos"), "logged")
    records = placed.withColumn("record", record_of(signed)).withColumn("leaf", H.leaf_hash(F.col("record")))
    rows = records.select(*kept.columns, "record", "leaf", "idx")
    return rows, tree.append(rows.select("idx", "leaf"), batch)
