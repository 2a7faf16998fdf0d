"""A table to which every key is appended once, by streams that may restart or start anew.

Folder: `rows/<commit>` holds the rows of a batch, `keys/<commit>/bucket=<n>` their keys dealt
over a fixed number of hash buckets, `commits/<commit>` one row that is written last and
names both. A commit is called after the run (the stream's own id, which its checkpoint
keeps) and the batch: a batch tried again finds its commit and changes nothing or, if it
failed before that, starts over under a new folder; a stream with a new checkpoint has a
new id and adds to what is there. Rows and keys without a commit are never read.

To find keys that are known, a batch reads the keys of the buckets its own keys fall
into, of no other bucket, and no rows. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BUCKETS = 256
COMMIT = "commit string, run string, batch bigint, folder string, buckets array<int>, n bigint"


class KeyStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.buckets = list(key), buckets

    def commits(self) -> DataFrame:
        """A row per committed batch: commit, run, batch, folder, buckets, n."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits")

    def rows(self) -> DataFrame:
        """Every row appended so far."""
        names = [f"{self.folder}/rows/{r.folder}" for r in self.commits().filter("n > 0").select("folder").collect()]  # one per batch
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def known_keys(self, buckets: Sequence[int]) -> DataFrame:
        """Keys appended so far in these buckets; only their files are listed and read."""
        wanted = set(buckets)
        names = [
            f"{self.folder}/keys/{c.folder}/bucket={b}"
            for c in self.commits().filter("n > 0").select("folder", "buckets").collect()  # one per batch
            for b in c.buckets
            if b in wanted
        ]
        schema = T.StructType([f for f in self.schema.fields if f.name in self.key])
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def append(self, batch: DataFrame, run: str, batch_id: int, order: Sequence[str] = ()) -> int:
        """Append rows whose key is new; of rows with one key the first by `order` counts. Returns how many."""
        commit = f"{run}-{batch_id:012d}"
        done = self.commits().filter(F.col("commit") == commit).select("n").first()
        if done is not None:
            return done.n
        if order:
            least = F.min_by(F.struct(*self.schema.names), F.struct(*order))
            first = batch.groupBy(*self.key).agg(least.alias("_row")).select("_row.*")
        else:
            first = batch.select(*self.schema.names).dropDuplicates(self.key)
        first = cut_lineage(first.withColumn("_bucket", self._bucket()))
        touched = sorted(r[0] for r in first.select("_bucket").distinct().collect())  # at most `buckets`
        new = cut_lineage(first.join(self.known_keys(touched), self.key, "left_anti"))
        folder = f"{commit}-{uuid.uuid4().hex}"
        counts = {r[0]: r[1] for r in new.groupBy("_bucket").agg(F.count(F.lit(1))).collect()}
        if counts:
            new.drop("_bucket").write.parquet(f"{self.folder}/rows/{folder}")
            keys = new.select(*self.key, F.col("_bucket").alias("bucket")).repartition("bucket")
            keys.write.partitionBy("bucket").parquet(f"{self.folder}/keys/{folder}")
        row = (commit, run, batch_id, folder, sorted(counts), sum(counts.values()))
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.parquet(f"{self.folder}/commits/{folder}")
        return row[-1]


def run_of(batch: DataFrame, otherwise: str) -> str:
    """Id of the stream whose batch this is; it stays the same for one checkpoint folder."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or otherwise
