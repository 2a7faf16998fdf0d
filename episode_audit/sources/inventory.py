"""File inventories: what is stored, what is missing, what differs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_problem


LARGEST_FILE = 2_000_000_000  # larger files cannot be one row; their bytes are read in blocks
READ_BYTES = 16 << 20


def hashed_in_blocks(files: DataFrame) -> DataFrame:
    """path, length, hash, error of listed files (path, length), read block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            hashes, errors = [], []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                digest, seen, error = hashlib.sha256(), 0, None
                try:
                    local = path.startswith("/") or path.startswith("file:")
                    store, name = (fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))) if local else fs.FileSystem.from_uri(path)
                    with store.open_input_stream(name) as stream:
                        while block := stream.read(READ_BYTES):
                            digest.update(block)
                            seen += len(block)
                    error = None if seen == length else "changed while read"
                except OSError as fault:
                    error = f"unreadable: {fault}"
                hashes.append(digest.hexdigest() if error is None else None)
                errors.append(error)
            yield batch.assign(hash=hashes, error=errors)

    return files.select("path", "length").mapInPandas(run, "path string, length long, hash string, error string")


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative), bytes, sha-256 of every matching file below `root`.

    The reported length and the bytes read must agree, else `torn` is set. Files
    up to LARGEST_FILE are one row each; larger ones are read in blocks.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index("path", base, -1), "%20", " ").alias("path")
    small = files.filter(F.col("length") <= LARGEST_FILE).select(
        relative,
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("hash"),
        (F.length("content") != F.col("length")).alias("torn"),
    )
    large = hashed_in_blocks(files.filter(F.col("length") > LARGEST_FILE).select("path", "length"))
    return small.unionByName(large.select(relative, F.col("length").alias("bytes"), "hash", F.col("error").isNotNull().alias("torn")))


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Relative paths whose whole relative path matches the regular expression."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/") + "/"
    return (
        files.select(F.substring_index("path", base, -1).alias("path")).filter(F.col("path").rlike(pattern)).orderBy("path")
    )


def split_errors(episodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds error code and message columns; both null for a usable episode.

    An unsafe path is refused before it is looked up.
    """
    known = inventory.select("path").distinct().withColumn("_known", F.lit(True))
    broken = path_problem(F.col("path"))
    joined = episodes.join(known, "path", "left")
    code = F.when(broken.isNotNull(), "unsafe_path").when(F.col("_known").isNull(), "missing_file")
    message = F.when(broken.isNotNull(), F.concat(broken, F.lit(": "), F.col("path"))).when(
        F.col("_known").isNull(), F.concat(F.lit("not in inventory: "), F.col("path"))
    )
    return joined.select(*episodes.columns, code.alias("code"), message.alias("message"))


def job_summary(checked: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts per job; a job is in error only when nothing was committed."""
    return (
        checked.groupBy(*group)
        .agg(F.count_if(F.col("code").isNull()).alias("committed"), F.count_if(F.col("code").isNotNull()).alias("errors"))
        .withColumn("status", F.when(F.col("committed") == 0, "error").otherwise("done"))
    )


def compare(left: DataFrame, right: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Differences of two inventories by path and hash."""
    joined = left.select(key, F.col(value).alias("_left")).join(
        right.select(key, F.col(value).alias("_right")), key, "full_outer"
    )
    status = (
        F.when(F.col("_left").isNull(), "missing left")
        .when(F.col("_right").isNull(), "missing right")
        .when(F.col("_left") != F.col("_right"), "differs")
    )
    return joined.select(key, status.alias("status")).filter(F.col("status").isNotNull())
