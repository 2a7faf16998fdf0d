"""How document filters interact: what each removes, and what it removes again, in every order.

Failing-id relations: every filter stores one table of the rows that fail it.
A split by left-semi and left-anti joins with those tables, one filter after
the other, sends each row into one leaf: the set of filters that it fails. A
prefix of filters leaves the leaves disjoint from it, the next filter removes
those of them that hold it (semi), and what it fails but no longer finds (anti)
was redundant. So ten joins on narrow rows serve all orders: survivors, removals,
redundancies and label losses of every prefix are sums over leaves, of which a
part has at most 2^filters.

Rows are numbered once, in a stored table that is read for everything after,
since ids may be null or repeat. Every row counts, repeated ones too. A null text
counts as empty, a null part as the empty string. A row repeats an earlier text
if a smaller id has the same text; a null id is neither smaller nor larger than
another. Where labels repeat an id, one that says so is enough. An empty table
gives no rows. Columns beside id, text and part are never looked at. Texts are
compared by SHA-256; digests of more than a thousandth of all rows, fewer than a
thousand by arithmetic, are settled by broadcast, others by an ordinary join.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut_lineage
from .common import quoted

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
LEAST_WORDS = 200
HEAVY_SHARE = 1000  # fewer digests than this can hold more than 1/HEAVY_SHARE of the rows each
REPEATED = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of filters A to D, which look at a text alone."""
    words = F.array_remove(F.split(text, WHITE), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def facts_of(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Stored: a number, id, part, text digest, labels and one flag a filter for every row; the only scan of the texts."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(
        quoted(id_col).alias("id"),
        F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *(F.coalesce(fails, F.lit(False)).alias(f"fails_{name}") for name, fails in filters.items()),
    )
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = rows.join(label, "id", "left").fillna(0, ["good", "toxic"])
    return cut_lineage(known.withColumn("row", F.monotonically_increasing_id()))


def repeated(facts: DataFrame) -> DataFrame:
    """Rows whose text a smaller id has as well."""
    copies = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    copies = cut_lineage(copies.where("first is not null"))
    limit = facts.count() / HEAVY_SHARE
    heavy, light = copies.where(F.col("n") > limit), copies.where(F.col("n") <= limit)
    later = facts.select("row", "id", "digest")
    in_heavy = later.join(F.broadcast(heavy), "digest")
    in_light = later.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest")
    return in_heavy.unionByName(in_light).where("id > first").select("row", "id")


def failing_ids(facts: DataFrame, names: list[str], folder: str) -> dict[str, DataFrame]:
    """One stored table of failing rows for every filter."""
    spark, out = facts.sparkSession, {}
    for name in [*names, REPEATED]:
        failing = repeated(facts) if name == REPEATED else facts.where(f"fails_{name}").select("row", "id")
        failing.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def leaves(facts: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and labels by part and set of failed filters (`failed`: a bit for each, in the order of `failing`)."""
    rows = facts.select("row", "part", "good", "toxic", F.lit(0).alias("failed"))
    for k, ids in enumerate(failing.values()):
        ids = ids.select("row")
        removed = rows.join(ids, "row", "left_semi").withColumn("failed", F.col("failed") + (1 << k))
        rows = cut_lineage(removed.unionByName(rows.join(ids, "row", "left_anti")))
    return rows.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def prefixes(names: list[str]) -> list[tuple[int, int, int]]:
    """(prefix, filter, number of orders in which this prefix stands before this filter)."""
    size, out = len(names), []
    for k in range(size):
        others = [i for i in range(size) if i != k]
        for many in range(size):
            for before in combinations(others, many):
                out.append((sum(1 << i for i in before), k, factorial(many) * factorial(size - 1 - many)))
    return out


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """A row per part, filter order and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. The filter of repeated texts (E) comes on top of `filters`."""
    spark = docs.sparkSession
    filters = text_filters(F.coalesce(quoted(text_col), F.lit(""))) if filters is None else filters
    names = [*filters, REPEATED]
    facts = facts_of(docs, labels, filters, id_col, text_col, part_col)
    failing = failing_ids(facts, list(filters), f"{checkpoint_folder(spark)}/failing-{uuid.uuid4().hex}")
    found = cut_lineage(leaves(facts, failing))

    # Fixed small relations: 80 pairs of prefix and filter, and the 600 steps of 120 orders for five filters.
    pairs = spark.createDataFrame(prefixes(names), "prefix int, nth int, orders int")
    orders = [
        ("".join(names[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(len(names)))
        for step in range(len(names))
    ]
    orders = spark.createDataFrame(orders, "filter_order string, step int, prefix int, nth int")

    bit = F.expr("shiftleft(1, nth)")
    before, fails = F.col("failed").bitwiseAND(F.col("prefix")) != 0, F.col("failed").bitwiseAND(bit) != 0
    removed = fails & ~before
    count = lambda rule, n="n": F.sum(F.when(rule, F.col(n)).otherwise(0)).cast("long")
    # every leaf takes part in every prefix: the pairs ride on the leaf rows, at most 2^filters of a part
    listed = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(k).alias("nth")) for p, k, _ in prefixes(names)))
    counted = cut_lineage(
        found.select("*", F.explode(listed).alias("at")).select("part", "failed", "n", "good", "toxic", "at.*")
        .groupBy("part", "prefix", "nth")
        .agg(
            count(~before & ~fails).alias("kept"),
            count(removed).alias("removed"),
            count(fails & before).alias("redundant"),
            count(F.col("failed") == bit).alias("unique_fails"),
            count(removed, "good").alias("good_lost"),
            count(removed, "toxic").alias("toxic_lost"),
        )
    )
    worth = counted.join(F.broadcast(pairs), ["prefix", "nth"]).groupBy("part", "nth").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = counted.join(F.broadcast(orders), ["prefix", "nth"]).join(worth, ["part", "nth"])
    letter = F.element_at(F.array(*map(F.lit, names)), F.col("nth") + 1)
    return steps.select(
        "part", "filter_order", "step", letter.alias("filter"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
