"""Order-aware building blocks that never put one whole key into one task.

A plain window partitioned by a business key sorts the key's rows in a single
task. The helpers below first cut every key into *chunks*: an integer column
that does not decrease along the order (an index shifted right, a time divided
by a width). Windows run inside (key, chunk); one small row per chunk carries
the count and the last values across chunk borders, and those chunk rows are
themselves processed in groups, so the work per task stays bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_BITS = 10  # chunk rows handled together in one window partition


def _running(chunks: DataFrame, key: Sequence[str], with_tail: bool) -> DataFrame:
    """Add rows-before (`_off`) and last non-null tail before (`_carry`) to chunk rows."""
    grouped = chunks.withColumn("_group", F.expr(f"shiftright(_chunk, {GROUP_BITS})"))
    totals = [F.sum("_n").alias("_n")]
    if with_tail:
        totals.append(F.max_by("_tail", F.when(F.col("_tail").isNotNull(), F.col("_chunk"))).alias("_tail"))
    groups = grouped.groupBy(*key, "_group").agg(*totals)
    # One row per 2^GROUP_BITS chunks: small even for a key that holds a third
    # of the data.
    over_groups = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_group")
    before = over_groups.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_group_off")]
    if with_tail:
        columns.append(F.last("_tail", ignorenulls=True).over(before).alias("_group_carry"))
    groups = groups.select(*key, "_group", *columns)

    inside = Window.partitionBy(*key, "_group").orderBy("_chunk")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in_off")]
    if with_tail:
        columns.append(F.last("_tail", ignorenulls=True).over(before).alias("_in_carry"))
    joined = grouped.select("*", *columns).join(groups, [*key, "_group"])
    out = [*key, "_chunk", (F.col("_group_off") + F.col("_in_off")).alias("_off")]
    if with_tail:
        out.append(F.coalesce("_in_carry", "_group_carry").alias("_carry"))
    return joined.select(*out)


def chunked_series(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    position: str = "pos",
    previous: Sequence[str] = (),
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Number each key's rows from 0 and fetch the previous row's values.

    `previous` columns come back as `prev_<name>`. `attributes` has at most one
    row per key; it is joined to the chunk rows instead of to the data, so a
    key with very many rows costs no extra shuffle and causes no skew.
    """
    key = list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    base = df.withColumn("_chunk", chunk.cast("bigint"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    numbered = base.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *(F.lag(c).over(inside).alias(f"_lag_{c}") for c in previous),
    )
    aggregates = [F.count(F.lit(1)).alias("_n")]
    if previous:
        aggregates.append(
            F.max_by(F.struct(*previous), F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)))).alias("_tail")
        )
    chunks = _running(base.groupBy(*key, "_chunk").agg(*aggregates), key, bool(previous))
    extra: list[str] = []
    if attributes is not None:
        extra = [c for c in attributes.columns if c not in key]
        chunks = chunks.join(attributes, key, "left")
    joined = numbered.join(chunks, [*key, "_chunk"])
    return joined.select(
        *df.columns,
        *extra,
        (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(position),
        *(
            F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in previous
        ),
    )


def nearest_mark(
    rows: DataFrame,
    marks: DataFrame,
    key: Sequence[str],
    at: Column,
    mark_at: Column,
    take: Sequence[str],
    width: int,
    direction: str = "after",
) -> DataFrame:
    """As-of join: the nearest mark at or after (or at or before) each row.

    Positions are integers; `width` of them form a chunk. `take` columns of the
    mark are null where no mark qualifies. Rows and marks are sorted together
    inside a chunk, and the nearest mark outside it arrives with the chunk row.
    Of several marks at one position the one with the greatest `take` values wins.
    """
    key = list(key)
    sign = -1 if direction == "after" else 1
    left = rows.select(
        *key, (at * sign).cast("bigint").alias("_p"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"),
    )
    right = marks.select(
        *key, (mark_at * sign).cast("bigint").alias("_p"), F.lit(0).alias("_kind"), F.struct(*take).alias("_mark"),
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_chunk", F.expr(f"_p div {width} - int(_p % {width} < 0)").cast("bigint"))
    inside = Window.partitionBy(*key, "_chunk").orderBy("_p", "_kind", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_mark", ignorenulls=True).over(inside)).filter(F.col("_kind") == 1)
    chunks = both.groupBy(*key, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("_mark", F.when(F.col("_kind") == 0, F.struct("_p", "_mark"))).alias("_tail"),
    )
    joined = seen.join(_running(chunks, key, True), [*key, "_chunk"])
    mark = F.coalesce("_seen", "_carry")
    return joined.select("_row.*", *(mark.getField(c).alias(c) for c in take))


def positions(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    name: str = "pos",
) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    return chunked_series(df, key, order, chunk, position=name)


def latest_per_key(
    df: DataFrame, key: Sequence[str], rank: Sequence[Column], keep: Sequence[str]
) -> DataFrame:
    """The row with the greatest `rank` per key, as one map-side-combined aggregate."""
    ranked = F.max_by(F.struct(*keep), F.struct(*(r.alias(f"_r{i}") for i, r in enumerate(rank))))
    return df.groupBy(*key).agg(ranked.alias("_row")).select(*key, "_row.*")


HOT_SHARE = 1000  # fewer keys than this can hold more than 1/HOT_SHARE of the rows each
HOT_ROWS = 1_000_000


def join_per_key(
    facts: DataFrame,
    per_key: DataFrame,
    key: Sequence[str],
    spread: Column,
    count: str = "_n",
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a one-row-per-key table whose `count` column gives key sizes.

    Keys above `hot_rows` that hold more than 1/HOT_SHARE of all rows are salted,
    one salt for every `hot_rows` rows. Their number is below HOT_SHARE by
    arithmetic, which bounds the broadcast list; every other key is small
    beside the table.
    """
    key = list(key)
    total = per_key.agg(F.sum(count).alias("_total")).scalar()
    floor = F.greatest(F.lit(hot_rows).cast("double"), total / HOT_SHARE)
    hot = per_key.filter(F.col(count) > floor).select(*key, F.ceil(F.col(count) / hot_rows).cast("int").alias("_salts"))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        per_key.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*key, "_salt"], how).drop("_salt")
