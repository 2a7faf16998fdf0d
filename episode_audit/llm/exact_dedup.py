"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. A Misra-Gries summary (Spark's frequent-items sketch: a bounded table of
   counters that are lowered together when it is full) finds digests that may
   be frequent. It combines on the map side and its size is fixed, so neither
   the driver nor a task holds more than `TRACKED` counters.
2. The candidates' rows are counted exactly; the verified winners, at most
   `HEAVY` rows, are broadcast, and rows of heavy digests are settled where
   they are, without a shuffle.
3. What remains has only small groups and takes one ordinary shuffle by digest.

Texts are equal when identical after lower-casing A-Z; equality is decided by
SHA-256 of the lower-cased UTF-8 bytes. A null text counts as empty. Of equal
texts the row with the largest id stays, a null id counting as smallest; of
rows that repeat both id and text one stays. An empty table gives an empty
result. Columns beside id and text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, lower_ascii, quoted

HEAVY = 1000  # broadcast rows at most
TRACKED = 8192  # counters in the summary: every digest above about rows / 1000 is found


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def frequent_digests(rows: DataFrame, digest: str) -> DataFrame:
    """One column `digest`: digests that may be frequent, at most `HEAVY`."""
    summary = rows.agg(F.expr(f"approx_top_k(`{digest}`, {HEAVY}, {TRACKED})").alias("top"))
    return summary.select(F.explode("top.item").alias(digest))


def winners(rows: DataFrame, id_col: str, digest: str, tie: str) -> DataFrame:
    """Exact size and staying row of each heavy digest that really has copies."""
    hits = rows.join(F.broadcast(frequent_digests(rows, digest)), digest, "left_semi")
    best = F.max(F.struct(F.col(id_col).alias("id"), F.col(tie).alias("tie"))).alias("best")
    counted = hits.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), best).where("n > 1")
    return cut_lineage(counted.select(digest, "n", F.col("best.id").alias("best_id"), F.col("best.tie").alias("best_tie")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    facts = cut_lineage(
        docs.select(
            quoted(id_col).alias("id"),
            text_digest(quoted(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    heavy = winners(facts, "id", "digest", "tie")
    settled = facts.join(F.broadcast(heavy), "digest").select(
        "id", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tie") == F.col("best_tie")).alias("kept"), "digest"
    )
    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.desc_nulls_last("id"), F.desc("tie"))
    rest = facts.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "id",
        F.first("id").over(ranked).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "digest",
    )
    both = settled.unionByName(rest)
    return both.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `docs`."""
    digest, tie = fresh(docs, "digest", "tie")
    keyed = docs.withColumn(digest, text_digest(quoted(text_col)))
    facts = keyed.select(quoted(id_col).alias("id"), F.col(digest).alias("digest"), F.lit(0).alias("tie"))
    heavy = winners(facts, "id", "digest", "tie").select(F.col("digest").alias(digest), F.col("best_id").alias(tie))
    settled = (
        keyed.join(F.broadcast(heavy), digest)
        .where(quoted(id_col).eqNullSafe(F.col(tie)))
        .drop(tie)
        .dropDuplicates([digest])
    )
    ranked = Window.partitionBy(digest).orderBy(quoted(id_col).desc_nulls_last())
    rest = (
        keyed.join(F.broadcast(heavy.select(digest)), digest, "left_anti")
        .withColumn(tie, F.row_number().over(ranked))
        .where(F.col(tie) == 1)
    )
    return settled.select(*map(quoted, docs.columns)).unionByName(rest.select(*map(quoted, docs.columns)))
