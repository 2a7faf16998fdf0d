"""Shards of near equal bytes by Karmarkar-Karp differencing; equal texts stay together.

The items are groups of equal texts, which no shard may divide. A group of at
least 1/`BUNDLES` of all bytes is an item of its own (there are at most `BUNDLES`
of them, by arithmetic); smaller groups share an item with the groups whose digest
falls into the same of `BUNDLES` bundles. So at most 2 * `BUNDLES` items exist at
any size of the table, and below a few thousand groups nearly each has its own.

Every item starts as a partial partition: its bytes in one shard, nothing in the
others. The two partial partitions with the largest spread are combined again and
again, the fullest shard of one with the emptiest of the other, until one is left.
That single task sees item sizes only. The shard of an item goes back to the rows
by two broadcasts of at most `BUNDLES` rows; texts are never shuffled.

Slots number the rows of a shard from 0, in an order that depends on ids and texts
alone, and are counted in blocks, so that no task sorts a whole shard.

A null text counts as empty, so it is in one group with empty texts. Ids may be null
or repeat; rows that repeat id and text are interchangeable. An empty table gives
none. A group larger than a fair shard has a shard that is as much larger; nothing
is divided. Columns beside id and text pass through `with_shard` and are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import positions
from ..session import cut_lineage
from .common import fresh, quoted

SHARDS = 8
BUNDLES = 8192
BLOCK_ROWS = 20_000  # rows that are numbered together


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of every item by Karmarkar-Karp differencing; ties go to the partition made first.

    A partial partition is (sums less their smallest, ascending; places): `places`
    tells for both halves which of their shards went where, so shards of single
    items follow by walking back from the last combination.
    """
    if not sizes:
        return []
    made: list[tuple[int, int, list[int]] | None] = [None] * len(sizes)
    sums = [[0] * (shards - 1) + [size] for size in sizes]
    heap = [(-size, k) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        # a's i-th smallest meets b's i-th largest
        joint = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(shards), key=joint.__getitem__)
        least = joint[order[0]]
        sums.append([joint[i] - least for i in order])
        made.append((a, b, order))
        sums[a] = sums[b] = []
        heapq.heappush(heap, (-sums[-1][-1], len(made) - 1))
    out = [0] * len(sizes)
    # from the last combination back: which shard the i-th smallest sum of a partition is
    shard_of = {len(made) - 1: list(range(shards))}
    for k in range(len(made) - 1, -1, -1):
        names, parts = shard_of.pop(k), made[k]
        if parts is None:
            out[k] = names[-1]
            continue
        a, b, order = parts
        joint_names = [0] * shards
        for i, at in enumerate(order):
            joint_names[at] = names[i]
        shard_of[a], shard_of[b] = joint_names, joint_names[::-1]
    return out


def differenced(items: DataFrame, shards: int) -> DataFrame:
    """Columns of `items` (digest or null, bundle or null, bytes) and the shard; one task, at most 2 * BUNDLES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=schema)
        # an order of its own, so that shards don't depend on how rows arrive
        rows = rows.sort_by([("bytes", "descending"), ("bundle", "ascending"), ("digest", "ascending")])
        found = difference(rows["bytes"].to_pylist(), shards)
        yield from rows.append_column("shard", pa.array(found, pa.int32())).to_batches()

    schema = pa.schema([("digest", pa.binary()), ("bundle", pa.int32()), ("bytes", pa.int64())])
    return items.select("digest", "bundle", "bytes").coalesce(1).mapInArrow(run, "digest binary, bundle int, bytes long, shard int")


def text_of(text_col: str) -> Column:
    return F.coalesce(quoted(text_col), F.lit("")).cast("binary")


def bundle_of(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BUNDLES)).cast("int")


def items_of(facts: DataFrame) -> DataFrame:
    """Items with their bytes: large groups by digest, the others by bundle."""
    groups = cut_lineage(facts.groupBy("digest").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes").cast("decimal(38,0)")).scalar()
    large = F.col("bytes").cast("decimal(38,0)") * BUNDLES >= total
    named = groups.select(F.when(large, F.col("digest")).alias("digest"), F.when(~large, bundle_of(F.col("digest"))).alias("bundle"), "bytes")
    return named.groupBy("digest", "bundle").agg(F.sum("bytes").alias("bytes"))


def shards_by_digest(facts: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(digest, shard) of the large groups and (bundle, shard) of the bundles, both of at most BUNDLES rows."""
    placed = cut_lineage(differenced(cut_lineage(items_of(facts)), shards))
    large = placed.where("digest is not null").select("digest", F.col("shard").alias("own_shard"))
    return large, placed.where("digest is null").select("bundle", F.col("shard").alias("bundle_shard"))


def placed_rows(rows: DataFrame, digest: str, shard: str, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`rows` and their shard, by the digest of their text."""
    digest_, bundle, own, other = fresh(rows, "digest", "bundle", "own_shard", "bundle_shard")
    large = tables[0].toDF(digest_, own)
    small = tables[1].toDF(bundle, other)
    found = rows.withColumn(bundle, bundle_of(quoted(digest)))
    found = found.join(F.broadcast(large), quoted(digest) == quoted(digest_), "left").join(F.broadcast(small), bundle, "left")
    return found.select(*map(quoted, rows.columns), F.coalesce(quoted(own), quoted(other)).alias(shard))


def facts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored: id, size, crc32 and digest of every row; the only scan of the texts."""
    text = text_of(text_col)
    return cut_lineage(
        docs.select(
            quoted(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, size, crc32, shard and slot."""
    facts = facts_of(docs, id_col, text_col)
    placed = placed_rows(facts, "digest", "shard", shards_by_digest(facts, shards))
    blocks = max(1, facts.count() // BLOCK_ROWS)
    # the id alone decides the block: a hot group of equal texts spreads over all of them
    block = F.pmod(F.xxhash64("id", "crc32"), F.lit(blocks))
    block = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).otherwise(block)
    placed = cut_lineage(placed.withColumn("block", block))
    numbered = positions(placed, ["shard"], ["block", "id", "crc32", "digest"], F.col("block"), name="slot")
    return numbered.select("id", "size", "crc32", "shard", "slot")


def with_shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """The documents with their shard in a new column, ready for `write.partitionBy`."""
    tables = shards_by_digest(facts_of(docs, id_col, text_col), shards)
    shard_col, digest = fresh(docs, shard_col, "digest")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(text_of(text_col), 256)))
    return placed_rows(keyed, digest, shard_col, tables).drop(digest)
