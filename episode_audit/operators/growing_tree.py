"""A tree digest that grows by batches: complete subtrees are stored once, heads keep the open edge.

A tree of n entries has one complete subtree for every set bit of n along its
right edge (the *frontier*, at most 63 hashes). That is all an append needs of the
past: new entries pair up among themselves, and at each level whose bit is set the
frontier's node comes first. So a batch of k entries makes at most 2k + 63 new nodes and reads
one head row, however large the tree is.

Folder: `nodes/<run>` holds the nodes (level, idx, hash) that a batch completed, `heads/<size>-<run>`
one row a batch. The head is written last and names its run: nodes of a run without a
head were never committed and are not read, so an append that fails can be repeated.
A batch with an id that a head already names changes nothing. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle
from .merkle import BLOCK_BITS, NODE, _full_pairs

HEAD = "batch string, run string, first bigint, size bigint, root binary, frontier array<struct<level:int,idx:bigint,hash:binary>>"
NODES = "level int, idx bigint, hash binary"
EMPTY = hashlib.sha256(b"").digest()


def frontier_places(size: int) -> list[tuple[int, int]]:
    """(level, idx) of the complete subtrees that make up the first `size` entries, lowest level first."""
    return [(b, size >> (b + 1) << 1) for b in range(size.bit_length()) if size >> b & 1]


def frontier_root(frontier: list[tuple[int, int, bytes]]) -> bytes:
    """Root over the frontier, lowest level first; at most 63 hashes."""
    if not frontier:
        return EMPTY
    node = frontier[0][2]
    for _, _, left in frontier[1:]:
        node = hashlib.sha256(b"\x01" + left + node).digest()
    return node


@dataclass(frozen=True)
class Head:
    batch: str
    run: str
    first: int
    size: int
    root: bytes
    frontier: list[tuple[int, int, bytes]]


def _level_up(entries: DataFrame, size: int, edge: dict[int, bytes], base: int, bits: int) -> DataFrame:
    """New nodes of levels base+1..base+bits above new entries (idx, leaf) of level `base`.

    `size` and `edge` are those of the tree before the batch: the block in which it ended
    takes its nodes from there, at every level with a set bit.
    """
    rows = F.sort_array(F.collect_list(F.struct("idx", "leaf")))
    blocks = entries.groupBy(F.shiftright("idx", bits).alias("_block")).agg(rows.alias("_rows"))
    start = F.greatest(F.shiftleft("_block", bits), F.lit(size >> base).cast("bigint"))
    dense = F.forall(F.transform("_rows", lambda r, j: r.getField("idx") == start + j), lambda ok: ok)
    hashes = F.transform("_rows", lambda r: r.getField("leaf"))
    blocks = blocks.select("_block", F.when(dense, hashes).otherwise(F.raise_error(F.lit("new entries must follow the tree without a gap or a repeat"))).alias("hashes"))
    shared = F.col("_block") == (size >> (base + bits))
    known = F.array(*(F.lit(edge.get(base + j)).cast("binary") for j in range(bits)))

    def step(acc: Column, level: Column) -> Column:
        cur, left = acc.getField("cur"), F.when(shared, F.get(known, level - 1))
        cur = F.when(left.isNotNull(), F.concat(F.array(left), cur)).otherwise(cur)
        up = _full_pairs(cur)
        first = F.greatest(F.shiftleft("_block", bits), F.lit(size >> base).cast("bigint")) / F.pow(F.lit(2.0), level)
        made = F.transform(
            up,
            lambda h, j: F.struct((level + base).cast("int").alias("level"), (F.floor(first) + j).cast("bigint").alias("idx"), h.alias("hash")).cast(NODE),
        )
        return F.struct(up.alias("cur"), F.concat(acc.getField("made"), made).alias("made"))

    begin = F.struct(F.col("hashes").alias("cur"), F.array().cast(f"array<{NODE}>").alias("made"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), begin, step)
    return blocks.select(F.explode(walked.getField("made")).alias("n")).select("n.*")


class GrowingTree:
    """A tree in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, bits: int = BLOCK_BITS):
        self.spark, self.folder, self.bits = spark, folder.rstrip("/"), bits

    def _heads(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/heads")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(HEAD).option("recursiveFileLookup", "true").parquet(f"{self.folder}/heads")

    def heads(self) -> DataFrame:
        """A row per batch: batch, run, first, size, root, frontier."""
        found = self._heads()
        return self.spark.createDataFrame([], HEAD) if found is None else found

    def head(self, batch: str | None = None) -> Head | None:
        """The latest head, or that of a batch; a single row is read."""
        found = self._heads()
        if found is None:
            return None
        if batch is not None:
            found = found.filter(F.col("batch") == batch)
        row = found.orderBy(F.desc("size"), "run").first()
        return row and Head(row.batch, row.run, row.first, row["size"], bytes(row.root), [(f.level, f.idx, bytes(f.hash)) for f in row.frontier])

    def nodes(self) -> DataFrame:
        """(level, idx, hash) of every complete subtree of committed batches."""
        runs = self.heads().filter("size > first").select("run")
        names = [f"{self.folder}/nodes/{r.run}" for r in runs.collect()]  # one per batch
        if not names:
            return self.spark.createDataFrame([], NODES)
        return self.spark.read.schema(NODES).option("recursiveFileLookup", "true").parquet(*names)

    def append(self, leaves: DataFrame, batch: str) -> Head:
        """Add entries (idx, leaf) that follow the last one without a gap; returns the new head."""
        done = self.head(batch)
        if done is not None:
            return done
        last = self.head()
        size, frontier = (last.size, last.frontier) if last else (0, [])
        run, edge = uuid.uuid4().hex, {level: h for level, _, h in frontier}
        path = f"{self.folder}/nodes/{run}"
        base = 0
        level = leaves.select(F.col("idx").cast("bigint").alias("idx"), "leaf")
        level.select(F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash")).write.parquet(f"{path}/round-0")
        level = self.spark.read.parquet(f"{path}/round-0").select("idx", F.col("hash").alias("leaf"))
        count, first, end = level.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx")).first()
        if count and (first, end) != (size, size + count - 1):
            raise ValueError(f"new entries must have the indices {size} to {size + count - 1}, not {first} to {end}")
        entries = count
        while entries:
            made = _level_up(level, size, edge, base, self.bits)
            base += self.bits
            made.write.parquet(f"{path}/round-{base}")
            level = self.spark.read.schema(NODES).parquet(f"{path}/round-{base}")
            level = level.filter(F.col("level") == base).select("idx", F.col("hash").alias("leaf"))
            entries = ((size + count) >> base) - (size >> base)
        places = frontier_places(size + count)
        known = {(lvl, idx): h for lvl, idx, h in frontier}
        if count:
            wanted = F.array(*(F.struct(F.lit(lvl).alias("level"), F.lit(idx).cast("bigint").alias("idx")) for lvl, idx in places))
            new = self.spark.read.schema(NODES).option("recursiveFileLookup", "true").parquet(path)
            known |= {(r.level, r.idx): bytes(r.hash) for r in new.filter(F.array_contains(wanted, F.struct("level", "idx"))).collect()}  # 63 at most
        edge_now = [(lvl, idx, known[lvl, idx]) for lvl, idx in places]
        head = Head(batch, run, size, size + count, frontier_root(edge_now), edge_now)
        row = (batch, run, size, head.size, bytearray(head.root), [(lvl, idx, bytearray(h)) for lvl, idx, h in edge_now])
        self.spark.createDataFrame([row], HEAD).coalesce(1).write.parquet(f"{self.folder}/heads/{head.size:020d}-{run}")
        return head

    def roots(self) -> DataFrame:
        """(size, root) of every head, without reading a node."""
        return self.heads().select("size", "root")

    def proofs(self, wanted: DataFrame, size: int) -> DataFrame:
        """(idx, proof) in the tree of the first `size` entries, from stored nodes alone.

        Each sibling is a complete subtree, or the range up to the end of the tree; either
        is a join of a few (level, idx) pairs with the node table.
        """
        levels = max(1, (size - 1).bit_length())
        place = lambda b: F.floor(F.col("idx") / F.pow(F.lit(2.0), b)).cast("bigint").bitwiseXOR(F.lit(1))
        power = lambda b: F.pow(F.lit(2.0), b).cast("bigint")
        ranges = F.transform(
            F.sequence(F.lit(0), F.lit(levels - 1)),
            lambda b: F.struct(
                b.alias("level_"), (place(b) * power(b)).alias("lo"), F.least((place(b) + 1) * power(b), F.lit(size).cast("bigint")).alias("hi")
            ),
        )
        asked = wanted.filter((F.col("idx") >= 0) & (F.col("idx") < size)).select(F.col("idx").cast("bigint").alias("idx")).distinct()
        listed = asked.select("idx", F.explode(ranges).alias("r")).select(F.col("idx").alias("of_"), "r.*").filter(F.col("lo") < F.col("hi"))
        found = merkle.range_roots(self.nodes(), listed, ["of_", "level_"])
        ordered = F.sort_array(F.collect_list(F.struct("level_", "root")))
        gathered = found.groupBy(F.col("of_").alias("idx")).agg(F.transform(ordered, lambda x: x.getField("root")).alias("proof"))
        return asked.join(gathered, "idx", "left").select("idx", F.coalesce("proof", F.array().cast("array<binary>")).alias("proof"))

    def consistency(self, pairs: DataFrame) -> DataFrame:
        """(m, n, proof) that the first m of n entries did not change, from stored nodes alone."""
        return merkle.consistency_proofs(self.nodes(), pairs)
