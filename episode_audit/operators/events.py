"""Keyed event logic in batch form: repeats within a time limit, sessions, rates.

The same aggregates over windows run on streams; see the streaming package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scale import chunked_series, nearest_mark


def _openings(events: DataFrame, key: Sequence[str], ttl: int) -> DataFrame:
    """Events that open a new period: the first, then each first one `ttl` after an opening.

    Every event learns where it would hand over to; the chain from the first
    event is then followed in doubling steps, so a key with very many events
    takes a few joins and never one long scan.
    """
    point = events.select(*key, "at", "id").withColumn("_neg", -F.col("id"))
    target = point.select(*key, F.col("at").alias("_at"), "_neg")
    linked = nearest_mark(
        point.drop("_neg"), target.select(*key, "_at", "_neg"), key, F.col("at") + ttl, F.col("_at"), ["_neg", "_at"], max(ttl, 1), "after"
    )
    jumps = cut_lineage(
        linked.filter(F.col("_neg").isNotNull()).select(*key, "id", (-F.col("_neg")).alias("to"))
    )
    marked = events.groupBy(*key).agg(F.min_by("id", F.struct("at", "id")).alias("id"))
    while True:
        reached = marked.join(jumps, [*key, "id"]).select(*key, F.col("to").alias("id"))
        grown = cut_lineage(marked.unionByName(reached).distinct())
        ahead = jumps.select(*key, F.col("id").alias("to"), F.col("to").alias("_next"))
        jumps = cut_lineage(jumps.join(ahead, [*key, "to"]).select(*key, "id", F.col("_next").alias("to")))
        marked = grown
        if jumps.isEmpty():
            return marked


def classify_repeats(events: DataFrame, key: Sequence[str], body: str, ttl: int) -> DataFrame:
    """Adds `outcome`: new, replay (same body) or conflict (other body) within `ttl` of the opening.

    events: key columns, at (integer time), id (unique), body.
    """
    openings = _openings(events, key, ttl)
    opened = events.join(openings, [*key, "id"], "left_semi").select(
        *key, "at", F.col("id").alias("opening_id"), F.col(body).alias("opening_body")
    )
    # equal times: the opening with the lowest id is the first one
    governed = nearest_mark(
        events, opened.withColumn("_neg", -F.col("opening_id")), key, F.col("at"), F.col("at"), ["_neg", "opening_id", "opening_body"], max(ttl, 1), "before"
    )
    outcome = (
        F.when(F.col("id") == F.col("opening_id"), "new").when(F.col(body).eqNullSafe(F.col("opening_body")), "replay").otherwise("conflict")
    )
    return governed.select(*events.columns, outcome.alias("outcome"))


def sessions(events: DataFrame, key: Sequence[str], gap: int, width: int) -> DataFrame:
    """(key, start, last, events): runs of events closer together than `gap`.

    events: key columns, at (integer time), id. `width` is the chunk length.
    """
    series = chunked_series(events, key, ["at", "id"], F.expr(f"at div {width}"), position="_n", previous=["at"])
    opens = (F.col("_n") == 0) | (F.col("at") - F.col("prev_at") >= gap)
    starts = series.filter(opens).select(*key, F.col("at").alias("start"))
    placed = nearest_mark(events, starts, key, F.col("at"), F.col("start"), ["start"], width, "before")
    return placed.groupBy(*key, "start").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("events"))


def window_rates(events: DataFrame, time: str, label: str, length: str, slide: str | None = None) -> DataFrame:
    """Counts per window and label; works on a batch or on a watermarked stream."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.groupBy(window.alias("w"), label).agg(F.count(F.lit(1)).alias("events"))


def window_start(column: str = "w") -> Column:
    return F.unix_seconds(F.col(f"{column}.start"))
