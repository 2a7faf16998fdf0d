"""Heads, licences and balances from append-only event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .lookups import first_failing
from .scale import chunked_series


def fee_split(amount: Column) -> tuple[Column, Column]:
    """Protocol fee (rounded down) and supplier share; they add up exactly.

    For amounts from 0 to 10^38 - 1. The last four digits are split off as text,
    so that no product or quotient needs more than 38 digits.
    """
    whole = amount.cast("decimal(38,0)")
    digits = F.lpad(whole.cast("string"), 38, "0")
    high, low = F.substring(digits, 1, 34).cast("decimal(34,0)"), F.substring(digits, 35, 4).cast("int")
    part = F.floor(low * F.lit(fixed.PROTOCOL_FEE_BPS) / F.lit(10000)).cast("decimal(4,0)")
    fee = ((high * F.lit(fixed.PROTOCOL_FEE_BPS).cast("decimal(4,0)")).cast("decimal(38,0)") + part).cast("decimal(38,0)")
    return fee, (whole - fee).cast("decimal(38,0)")


def balances(credited: DataFrame, withdrawn: DataFrame, key: Sequence[str]) -> DataFrame:
    """Credits minus withdrawals per key, as one aggregate over both event tables."""
    signed = credited.select(*key, "amount").unionByName(withdrawn.select(*key, (-F.col("amount")).alias("amount")))
    return signed.groupBy(*key).agg(F.sum("amount").alias("balance"))


def conservation(licensed: DataFrame, paid: DataFrame, credited: DataFrame) -> DataFrame:
    """Receipts whose amount is not exactly what was paid out plus credited."""
    parts = paid.select("receipt", F.col("amount").alias("out")).unionByName(credited.select("receipt", F.col("amount").alias("out")))
    sums = parts.groupBy("receipt").agg(F.sum("out").alias("out"))
    joined = licensed.select("receipt", "amount").join(sums, "receipt", "full_outer")
    difference = F.coalesce("amount", F.lit(0)) - F.coalesce("out", F.lit(0))
    return joined.withColumn("difference", difference).filter(F.col("difference") != 0)


def head_rules(heads: DataFrame, chunk: Column, key: Sequence[str] = ("ledger",)) -> DataFrame:
    """Violation of each published head against the one before it ('' when none)."""
    series = chunked_series(heads, key, ["anchor_idx"], chunk, position="_n", previous=["root", "size", "revocation_root"])
    first = F.col("_n") == 0
    grew, same = F.col("size") > F.col("prev_size"), F.col("size") == F.col("prev_size")
    rule = first_failing(
        (first & (F.col("size") == 0), "size must grow"),
        (~first & (F.col("size") < F.col("prev_size")), "size must not shrink"),
        (~first & grew & (F.col("root") == F.col("prev_root")), "root must change"),
        (~first & same & (F.col("root") != F.col("prev_root")), "root must match at same size"),
        (~first & same & F.col("revocation_root").eqNullSafe(F.col("prev_revocation_root")), "nothing to anchor"),
    )
    return series.select(*heads.columns, F.coalesce(rule, F.lit("")).alias("violation"))


def change_points(heads: DataFrame, chunk: Column, key: Sequence[str] = ("ledger",)) -> DataFrame:
    """Heads at which the revocation root differs from the head before."""
    series = chunked_series(heads, key, ["anchor_idx"], chunk, position="_n", previous=["revocation_root"])
    changed = (F.col("_n") > 0) & ~F.col("revocation_root").eqNullSafe(F.col("prev_revocation_root"))
    return series.filter(changed).select(*heads.columns)


def divergence(heads: DataFrame) -> DataFrame:
    """Heads whose root differs from the reference ledger's root at the same size.

    The primary ledger is the reference; without one at that size, the first ledger is.
    """
    rank = F.struct(F.when(F.col("role") == "primary", 0).otherwise(1), "ledger", "anchor_idx")
    reference = heads.groupBy("size").agg(F.min_by(F.struct("ledger", "root"), rank).alias("_r"))
    joined = heads.join(reference, "size").filter(F.col("root") != F.col("_r.root"))
    return joined.select(*heads.columns, F.col("_r.ledger").alias("reference_ledger"), F.col("_r.root").alias("reference_root"))


def lag_alarm(heads: DataFrame, now: Column | int) -> DataFrame:
    """Seconds since the last head per ledger and whether that is more than twice its interval."""
    interval = F.when(F.col("role") == "primary", fixed.ANCHOR_INTERVAL_S["primary"]).otherwise(fixed.ANCHOR_INTERVAL_S["mirror"])
    now = now if isinstance(now, Column) else F.lit(now)
    last = heads.groupBy("ledger", "role").agg(F.max("at").alias("last_at"), F.max_by("size", F.struct("at", "anchor_idx")).alias("last_size"))
    return last.select(
        "ledger", "role", "last_size", (now - F.col("last_at")).alias("lag_s"), (interval * 2).cast("bigint").alias("limit_s"),
        (now - F.col("last_at") > interval * 2).alias("alarm"),
    )


def overdue(ledgers: DataFrame, attempts: DataFrame, heads: DataFrame, now: int, size: int, revocation_root: Column) -> DataFrame:
    """One row per ledger: is a new head due, or why not.

    attempts: ledger, at, ok. A failure streak is the failures after the last
    success; the wait after it grows along the fixed back-off list. A mirror
    never runs ahead of the primary.
    """
    succeeded = attempts.groupBy("ledger").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max("at").alias("last_attempt"))
    streak = (
        attempts.join(succeeded.select("ledger", "last_success"), "ledger")
        .filter(~F.col("ok") & (F.col("at") > F.coalesce("last_success", F.lit(-1))))
        .groupBy("ledger")
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    latest = heads.groupBy("ledger").agg(F.max_by(F.struct("size", "revocation_root"), F.struct("at", "anchor_idx")).alias("_h"))
    primary = heads.filter(F.col("role") == "primary").agg(F.max("size").alias("primary_size"))
    joined = (
        ledgers.join(succeeded, "ledger", "left").join(streak, "ledger", "left").join(latest, "ledger", "left")
        # a single row, attached by a constant key
        .withColumn("_one", F.lit(1)).join(F.broadcast(primary.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    )
    waits = F.array(*(F.lit(s) for s in fixed.RETRY_BACKOFF_S))
    failures = F.coalesce("failures", F.lit(0))
    wait = F.get(waits, F.least(failures - 1, F.lit(len(fixed.RETRY_BACKOFF_S) - 1)).cast("int"))
    interval = F.when(F.col("role") == "primary", fixed.ANCHOR_INTERVAL_S["primary"]).otherwise(fixed.ANCHOR_INTERVAL_S["mirror"])
    grew = (F.lit(size) > F.col("_h.size")) | ~revocation_root.eqNullSafe(F.col("_h.revocation_root"))
    reason = first_failing(
        ((failures > 0) & (now - F.col("last_attempt") < wait), "backing off"),
        (F.col("last_success").isNotNull() & (now - F.col("last_success") < interval), "interval not over"),
        (F.col("_h").isNull() & (F.lit(size) == 0), "nothing to publish"),
        (F.col("_h").isNotNull() & ~grew, "nothing to publish"),
        (
            (F.col("role") == "mirror") & (F.col("primary_size").isNull() | (F.lit(size) > F.col("primary_size"))),
            "ahead of primary",
        ),
    )
    return joined.select("ledger", "role", failures.alias("failures"), F.coalesce(reason, F.lit("due")).alias("state"))


def terms_state(events: DataFrame) -> DataFrame:
    """Published, retired and saleable terms from the event table (terms, event, at, seq)."""
    return events.groupBy("terms").agg(
        F.bool_or(F.col("event") == "published").alias("published"), F.bool_or(F.col("event") == "retired").alias("retired")
    ).withColumn("saleable", F.col("published") & ~F.col("retired"))


def admit_licences(attempts: DataFrame, corpora: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds `outcome` to licence attempts (column corpus): licensed, or the first rule that refuses.

    corpora: corpus, terms, open. terms: terms, published, retired.
    """
    offers = corpora.join(terms.select("terms", "published", "retired"), "terms", "left").withColumn("_known", F.lit(True))
    joined = attempts.join(offers, "corpus", "left")
    refused = first_failing(
        (F.col("_known").isNull(), "unknown corpus"),
        (~F.col("open"), "corpus closed"),
        (~F.coalesce("published", F.lit(False)), "unknown terms"),
        (F.coalesce("retired", F.lit(False)), "terms retired"),
    )
    return joined.select(*attempts.columns, F.coalesce(refused, F.lit("licensed")).alias("outcome"))
