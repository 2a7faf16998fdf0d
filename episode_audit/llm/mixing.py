"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Sources, in code-point order with null last, weigh
`weights` in turn and share `share` of all words; a source's target stops at
`most` times its words and the excess goes to the others by weight (water
level: target = min(level * weight, most * size)).

Inside a source, documents stand in the order of a keyed hash. A source is
read through once for every whole multiple of its size in the target, and in
the last pass as far as the rest of the target: a document takes part when its
middle word does. So each source's words miss the target by half a document at
most and no document is taken more than `most` (rounded up) times.

Every source has a weight schedule over training time 0..1, piecewise linear.
Its integral, scaled to the target, is the words demanded up to a time; the
inverse of that demand at an occurrence's middle word is its training position.
Occurrences are range-sorted by position.

Running totals never sort a whole source in one task: the leading digits of
the hash cut a source into bins of about `BIN_ROWS` rows.

Null or empty texts have size 0 and take no words; a null source is a source of
its own. Rows that repeat an id are ordered by size. An empty table gives an
empty result. Other columns are carried along untouched by `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, fresh, quoted

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix"
BIN_ROWS = 2_000
#: Weight over training time for each entry of WEIGHTS: (time, weight) knots.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 2.0)),
)


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add `rank` from 0 by source, null last, without sorting all in one task."""
    ordered = cut_lineage(sources.orderBy(F.asc_nulls_last("source"))).withColumn("part", F.spark_partition_id())
    inside = ordered.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1)
    counts = ordered.groupBy("part").count()  # a row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return inside.join(starts, "part").select("source", "source_size", (F.col("start") + F.col("at")).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank, weight, target."""
    sources = ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # the set of capped sources only grows; a few rounds
        is_capped = F.col("cap") < level * F.col("weight") if capped >= 0 else F.lit(False)
        row = sources.agg(
            F.count_if(is_capped).alias("n"),
            F.coalesce(F.sum(F.when(is_capped, F.col("cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row.n == capped:
            break
        capped, level = row.n, (total - row.caps) / row.open if row.open else 0.0
    target = F.when(F.col("cap") < level * F.col("weight"), F.col("cap")).otherwise(level * F.col("weight"))
    return cut_lineage(sources.select("source", "source_size", "rank", "weight", target.alias("target")))


def time_of(share: Column, knots) -> Column:
    """The time by which a share (0..1) of the schedule's integral has passed."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    wanted, passed, pieces = share * area, 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        rest = F.greatest(wanted - passed, F.lit(0.0))
        root = F.sqrt(F.greatest(a * a + 2.0 * (b - a) / (t1 - t0) * rest, F.lit(0.0)))
        found = F.when(rest <= 0, F.lit(t0)).otherwise(F.least(t0 + 2.0 * rest / (a + root), F.lit(t1)))
        passed += (t1 - t0) * (a + b) / 2
        pieces.append((passed, found))
    out = pieces[-1][1]
    for end, found in reversed(pieces[:-1]):
        out = F.when(wanted < end, found).otherwise(out)
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """A row per document: id, place (its hash), source, size, source_size, target, copies, taken, positions."""
    facts = cut_lineage(
        docs.select(
            quoted(id_col).alias("id"),
            quoted(source_col).alias("source"),
            words(quoted(text_col)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit("null")))).alias("place"),
        )
    )
    targets = source_targets(facts)
    digits = max(1, math.ceil(math.log(max(facts.count(), 1) / BIN_ROWS, 16)))
    binned = facts.withColumn("bin", F.substring("place", 1, digits)).withColumn("of", F.xxhash64("source"))
    totals = binned.groupBy("source", "of", "bin").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("of", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bin", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bin").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = binned.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    bins = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("bin_source"), F.col("b.bin").alias("bin_at"), "start", "source_size", "rank", "weight", "target"
    )
    placed = summed.join(bins, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_at")))
    placed = placed.withColumn("before", F.col("start") + F.col("within"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("full", full)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    placed = placed.withColumn("copies", F.col("full") + F.when((rest > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest), 1).otherwise(0))
    middle = F.col("before") + F.col("size") / 2

    def position(copy: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least((copy * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        out = None
        for k, knots in enumerate(SCHEDULES):
            at = time_of(share, knots)
            out = F.when(F.col("rank") % len(SCHEDULES) == k, at) if out is None else out.when(F.col("rank") % len(SCHEDULES) == k, at)
        return out

    first = F.when(F.col("copies") > 0, position(F.lit(0)))
    every = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)
    return placed.select(
        "id", "place", "source", "size", "source_size", "target",
        F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        first.alias("first_position"),
        F.when(F.col("copies") > 0, every).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, copy_col: str | None = None) -> DataFrame:
    """The mixed corpus: a row of `docs` for each time it is taken, range-sorted by training position.

    `copy_col` names a further column, the number of the copy from 0.
    Rows that repeat an id and a text are taken alike.
    """
    position, key, size, copy = fresh(docs, "position", "key", "size", copy_col or "copy")
    plan = plan_mix(docs, id_col, text_col, source_col, seed).where("copies > 0")
    plan = plan.groupBy("id", "source", "size").agg(F.max_by("positions", "copies").alias("positions"))
    plan = plan.select(F.col("id").alias(key), F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), F.col("positions").alias(position))
    rows = docs.withColumn(size, words(quoted(text_col)))
    joined = rows.join(
        plan,
        quoted(id_col).eqNullSafe(plan[key]) & quoted(source_col).eqNullSafe(plan["plan_source"]) & (rows[size] == plan["plan_size"]),
    )
    taken = joined.select(*[rows["`" + c.replace("`", "``") + "`"] for c in docs.columns], F.posexplode(plan[position]).alias(copy, position))
    return taken.orderBy(F.col(position), quoted(id_col)).drop(position, *([] if copy_col else [copy]))
