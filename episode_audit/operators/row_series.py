"""Keyed, ordered rows in parts of a fixed number of rows, with values carried over their borders.

A key may hold a third of all rows, and any share of them at one time, so neither
keys nor slices of time or numbers bound the work of a task. Here all rows are
range-partitioned by (key, order), sorted, numbered and stored once; every `rows`
consecutive numbers of a partition are a *part*. Windows run inside (part, key), and
the last rows of a part go on to the next part of the same key through a table that
has one row per part and key: keys that lie inside one part need nothing carried.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut_lineage

ROWS = 250_000  # rows that are handled together
PART, ID = "_part", "_id"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written beside the checkpoints and read again, so that later jobs read only the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_parts(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], rows: int = ROWS) -> DataFrame:
    """Stored: the rows of `df` sorted and numbered (`_id`), with their part (`_part`).

    Numbers leave gaps between partitions, never inside a part.
    """
    partitions = max(1, math.ceil(df.count() / rows))
    ordered = df.repartitionByRange(partitions, *key, *order).sortWithinPartitions(*key, *order)
    numbered = ordered.withColumn(ID, F.monotonically_increasing_id())
    return stored(numbered, "parts").withColumn(PART, F.expr(f"{ID} div {rows}"))


def groups_of(parts: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row per part and key: rows before it in the key (`_before`) and how many parts the key has (`_parts`)."""
    counted = parts.groupBy(PART, *key).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*key).orderBy(PART)
    return cut_lineage(
        counted.select(
            PART, *key,
            F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("_parts"),
        )
    )


def _carried(parts: DataFrame, key: Sequence[str], groups: DataFrame, take: Sequence[str], depth: int) -> DataFrame:
    """(part, key, `_carry`): the last `depth` rows before the part, latest first, for keys of several parts."""
    split = groups.filter(F.col("_parts") > 1).select(PART, *key)
    latest = Window.partitionBy(PART, *key).orderBy(F.desc(ID))
    last = (
        parts.join(split, [PART, *key], "left_semi")
        .select(PART, *key, ID, F.struct(*take).alias("_row"), F.row_number().over(latest).alias("_rank"))
        .filter(F.col("_rank") <= depth)
    )
    tails = last.groupBy(PART, *key).agg(F.sort_array(F.collect_list(F.struct(ID, "_row"))).alias("_tail"))
    # every part has a row at least, so `depth` parts back reach far enough
    along = Window.partitionBy(*key).orderBy(PART).rowsBetween(-depth, -1)
    before = F.slice(F.reverse(F.flatten(F.collect_list("_tail").over(along))), 1, depth)
    return tails.select(PART, *key, F.transform(before, lambda x: x.getField("_row")).alias("_carry"))


def with_previous(
    parts: DataFrame,
    key: Sequence[str],
    take: Sequence[str],
    depth: int = 1,
    position: str = "pos",
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Number each key's rows from 0 and fetch values of the rows before.

    `parts` comes from `in_parts`; rows may have been filtered out since. The values
    of the previous row are `prev_<name>`, those of the one before `prev2_<name>` and so
    on. `attributes` has at most one row per key and is joined to the small table of
    parts and keys.
    """
    key = list(key)
    groups = groups_of(parts, key)
    carried = _carried(parts, key, groups, take, depth)
    extra = [c for c in attributes.columns if c not in key] if attributes is not None else []
    if attributes is not None:
        groups = groups.join(attributes, key, "left")
    groups = groups.join(carried, [PART, *key], "left")
    inside = Window.partitionBy(PART, *key).orderBy(ID)
    numbered = parts.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *(F.lag(F.struct(*take), d).over(inside).alias(f"_lag{d}") for d in range(1, depth + 1)),
    )
    joined = numbered.join(groups, [PART, *key])
    previous = []
    for d in range(1, depth + 1):
        row = F.when(F.col("_rn") > d, F.col(f"_lag{d}")).otherwise(F.get("_carry", (d - F.col("_rn")).cast("int")))
        previous += [row.getField(c).alias(f"prev{'' if d == 1 else d}_{c}") for c in take]
    return joined.select(*parts.columns, *extra, (F.col("_before") + F.col("_rn") - 1).cast("bigint").alias(position), *previous)


def attach(parts: DataFrame, key: Sequence[str], per_key: DataFrame) -> DataFrame:
    """Join one-row-per-key facts to rows in parts (inner); no task gets more than one part of a key."""
    key = list(key)
    groups = parts.select(PART, *key).distinct().join(per_key, key)
    return parts.join(groups, [PART, *key])


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], position: str = "pos", rows: int = ROWS) -> DataFrame:
    """Dense 0-based position of each row within its key, whatever the spread of keys and order values."""
    key = list(key)
    parts = in_parts(df, key, order, rows)
    inside = Window.partitionBy(PART, *key).orderBy(ID)
    ranked = parts.withColumn("_rn", F.row_number().over(inside)).join(groups_of(parts, key).select(PART, *key, "_before"), [PART, *key])
    return ranked.select(*df.columns, (F.col("_before") + F.col("_rn") - 1).cast("bigint").alias(position))


def running_sum(parts: DataFrame, key: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the key's rows up to and including each row."""
    key = list(key)
    valued = parts.withColumn("_value", value)
    along = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = valued.groupBy(PART, *key).agg(F.sum("_value").alias("_sum"))
    before = cut_lineage(sums.select(PART, *key, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before_sum")))
    inside = Window.partitionBy(PART, *key).orderBy(ID).rowsBetween(Window.unboundedPreceding, 0)
    joined = valued.withColumn("_inside", F.sum("_value").over(inside)).join(before, [PART, *key])
    return joined.select(*parts.columns, (F.col("_before_sum") + F.col("_inside")).alias(name))
