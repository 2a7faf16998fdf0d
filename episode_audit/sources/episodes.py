"""Episode datasets: info, episode index, frames, and one row per episode.

A dataset is a directory with meta/info.json. Every function takes a path that
may be a glob over many dataset directories; rows carry the directory in
`dataset`. Two layouts exist: chunked (several episodes per data file, index in
Parquet) and per-episode (one file each, index in JSON lines).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from .inventory import LARGEST_FILE, hashed_in_blocks
from ..functions.text import path_problem

INFO_SCHEMA = (
    "codebase_version string, robot_type string, fps double, data_path string, video_path string, "
    "features map<string,struct<dtype:string,shape:array<int>>>"
)
# Default path templates of the two layouts
CHUNKED_DATA = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
CHUNKED_VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
EPISODE_DATA = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
EPISODE_VIDEO = "videos/{video_key}/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.mp4"



def dataset_of(path: Column, tail: str) -> Column:
    """The dataset directory of a file path, scheme removed."""
    return F.regexp_extract(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), f"^(.*)/{tail}$", 1)


def any_true(rows: DataFrame, candidates: Sequence[str]) -> Column:
    """Any-true of the first candidate column that has a value; null when none does.

    In a read over many datasets a column some of them lack is null there, so
    each group takes the first candidate that its own rows have.
    """
    known = [F.bool_or(F.col(f"`{name}`")) for name in candidates if name in rows.columns]
    return F.coalesce(*known) if known else F.max(F.lit(None).cast("boolean"))


def read_info(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset: layout, rate, embodiment, channels, cameras, info hash."""
    raw = spark.read.text(f"{root}/meta/info.json", wholetext=True).select(
        dataset_of(F.col("_metadata.file_path"), "meta/info[.]json").alias("dataset"), "value"
    )
    info = raw.select("dataset", "value", F.from_json("value", INFO_SCHEMA).alias("i"))
    major = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce("i.codebase_version", F.lit("")), r"v?(\d+)", 1), F.lit("9999")), F.lit(0))
    features = F.map_entries(F.coalesce("i.features", F.expr("map()").cast("map<string,struct<dtype:string,shape:array<int>>>")))
    channels = F.array_sort(
        F.transform(
            features,
            lambda e: F.struct(
                e.getField("key").alias("name"),
                F.when(e.getField("value").getField("dtype") == "video", "video/mp4")
                .otherwise(F.coalesce(e.getField("value").getField("dtype"), F.lit("unknown")))
                .alias("dtype"),
                F.coalesce(e.getField("value").getField("shape"), F.array().cast("array<int>")).alias("shape"),
                F.col("i.fps").alias("hz"),
            ),
        )
    )
    cameras = F.transform(F.filter(features, lambda e: e.getField("value").getField("dtype") == "video"), lambda e: e.getField("key"))
    chunked = major >= 3
    return info.select(
        "dataset",
        F.when(chunked, "chunked").otherwise("per_episode").alias("layout"),
        F.coalesce("i.fps", F.lit(0.0)).alias("rate_hz"),
        F.col("i.robot_type").alias("embodiment"),
        channels.alias("channels"),
        F.array_sort(cameras).alias("cameras"),
        F.coalesce("i.data_path", F.when(chunked, CHUNKED_DATA).otherwise(EPISODE_DATA)).alias("data_template"),
        F.coalesce("i.video_path", F.when(chunked, CHUNKED_VIDEO).otherwise(EPISODE_VIDEO)).alias("video_template"),
        F.sha2(H.utf8(F.col("value")), 256).alias("info_hash"),
    )


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """Fill a template that is itself a column; a slot without a value stays visible."""
    out = template
    for name, value in values.items():
        text = value.cast("string")
        out = F.replace(out, F.lit("{" + name + "}"), text)
        width = F.regexp_extract(out, r"\{" + name + r":0(\d+)d\}", 1)
        number = F.when(width == "", 0).otherwise(F.try_to_number(width, F.lit("99"))).cast("int")
        padded = F.lpad(text, F.greatest(F.length(text), number), F.lit("0"))
        out = F.replace(out, F.concat(F.lit("{" + name + ":0"), width, F.lit("d}")), padded)
    return out


def _video_columns(columns: Sequence[str]) -> list[str]:
    found = (re.fullmatch(r"videos/(.+)/chunk_index", c) for c in columns)
    return sorted(m.group(1) for m in found if m)


def chunked_index(spark: SparkSession, root: str, info: DataFrame) -> DataFrame:
    """Episodes of chunked datasets with data and video paths and their ranges."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/meta/episodes/chunk-*/file-*.parquet")
    rows = rows.withColumn("dataset", dataset_of(F.col("_metadata.file_path"), "meta/episodes/chunk-[0-9]+/file-[0-9]+[.]parquet"))
    joined = rows.join(info.filter(F.col("layout") == "chunked"), "dataset")
    c = lambda name: F.col(f"`{name}`")
    place = {"chunk_index": c("data/chunk_index"), "file_index": c("data/file_index")}
    videos = [
        F.when(
            F.array_contains("cameras", camera) & c(f"videos/{camera}/chunk_index").isNotNull(),
            F.struct(
                F.lit(camera).alias("camera"),
                fill(
                    F.col("video_template"),
                    {
                        "video_key": F.lit(camera),
                        "chunk_index": c(f"videos/{camera}/chunk_index"),
                        "file_index": c(f"videos/{camera}/file_index"),
                    },
                ).alias("path"),
                F.array(c(f"videos/{camera}/from_timestamp").cast("double"), c(f"videos/{camera}/to_timestamp").cast("double")).alias("span"),
            ),
        )
        for camera in _video_columns(rows.columns)
    ]
    video_type = "array<struct<camera:string,path:string,span:array<double>>>"
    listed = F.array_compact(F.array(*videos)) if videos else F.array().cast(video_type)
    tasks = F.col("tasks") if "tasks" in rows.columns else F.lit(None).cast("array<string>")
    return joined.withColumn("_v", listed).select(
        *info.columns,
        F.col("episode_index").cast("bigint").alias("episode_index"),
        F.col("length").cast("bigint").alias("frames"),
        F.when(F.size(tasks) > 0, F.array_join(tasks, "; ")).alias("instruction"),
        F.concat(F.array(fill(F.col("data_template"), place)), F.transform("_v", lambda v: v.getField("path"))).alias("paths"),
        F.struct(
            F.array(F.col("dataset_from_index").cast("bigint"), F.col("dataset_to_index").cast("bigint")).alias("frames"),
            F.map_from_entries(F.transform("_v", lambda v: F.struct(v.getField("camera"), v.getField("span")))).alias("video"),
        ).alias("range"),
    )


def per_episode_index(spark: SparkSession, root: str, info: DataFrame) -> DataFrame:
    """Episodes of per-episode datasets; blank lines are skipped, the chunk is always 0."""
    rows = spark.read.schema("episode_index bigint, length bigint, tasks array<string>").json(f"{root}/meta/episodes.jsonl")
    rows = rows.withColumn("dataset", dataset_of(F.col("_metadata.file_path"), "meta/episodes[.]jsonl"))
    joined = rows.filter(F.col("episode_index").isNotNull()).join(info.filter(F.col("layout") == "per_episode"), "dataset")
    zero = F.lit(0)
    at = {"episode_chunk": zero, "episode_index": F.col("episode_index")}
    data = fill(F.col("data_template"), at)
    videos = F.transform("cameras", lambda k: fill(F.col("video_template"), {"video_key": k, **at}))
    return joined.select(
        *info.columns,
        "episode_index",
        F.col("length").alias("frames"),
        F.when(F.size("tasks") > 0, F.array_join("tasks", "; ")).alias("instruction"),
        F.concat(F.array(data), videos).alias("paths"),
        F.lit(None).cast("struct<frames:array<bigint>,video:map<string,array<double>>>").alias("range"),
    )


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def episode_index(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of every dataset below the path, both layouts."""
    info = read_info(spark, root)
    parts = []
    if _exists(spark, f"{root}/meta/episodes/chunk-*/file-*.parquet"):
        parts.append(chunked_index(spark, root, info))
    if _exists(spark, f"{root}/meta/episodes.jsonl"):
        parts.append(per_episode_index(spark, root, info))
    if not parts:
        raise FileNotFoundError(f"no episode index below {root}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """dataset, path, bytes, hash and error of every data and video file; files of any size are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/data", f"{root}/videos"] if _exists(spark, f"{root}/videos") else f"{root}/data")
    tail = "((data|videos)/.+)"
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    named = files.select(
        F.regexp_extract(plain, f"^(.*?)/{tail}$", 1).alias("dataset"), F.regexp_extract(plain, f"^.*?/{tail}$", 1).alias("path"), "length", "content"
    )
    small = named.filter(F.col("length") <= LARGEST_FILE).select(
        "dataset", "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"),
        F.when(F.length("content") != F.col("length"), "changed while read").alias("error"),
    )
    streamed = hashed_in_blocks(files.filter(F.col("length") > LARGEST_FILE).select("path", "length"))
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    large = streamed.select(
        F.regexp_extract(plain, f"^(.*?)/{tail}$", 1).alias("dataset"), F.regexp_extract(plain, f"^.*?/{tail}$", 1).alias("path"),
        F.col("length").alias("bytes"), "hash", "error",
    )
    return small.unionByName(large)


def read_frames(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """Frames of all data files with the wanted columns; episodes are told apart by their own index column."""
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(f"{root}/data")
    known = [c for c in dict.fromkeys(["episode_index", "frame_index", *columns]) if c in rows.columns]
    return rows.select(
        F.regexp_extract(F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:/+", "/"), "^(.*?)/data/", 1).alias("dataset"),
        *(F.col(f"`{c}`") for c in known),
    )


def read_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(episodes, errors): a bad path or a missing file drops its own episode only."""
    index = episode_index(spark, root)
    inventory = file_inventory(spark, root)
    wanted = index.select("dataset", "episode_index", F.explode(F.array_distinct("paths")).alias("path")).withColumn(
        "problem", path_problem(F.col("path"))
    )
    wanted = wanted.withColumn("problem", F.when(F.col("path").contains("{"), "unfilled template").otherwise(F.col("problem")))
    found = wanted.join(inventory, ["dataset", "path"], "left").withColumn(
        "problem",
        F.coalesce("problem", "error", F.when(F.col("hash").isNull(), "missing file")),
    )
    files = found.groupBy("dataset", "episode_index").agg(
        F.array_sort(F.collect_list(F.struct("path", "bytes", F.concat(F.lit("0x"), "hash").alias("hash")))).alias("files"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("path", "problem"))).alias("_bad"),
    )
    frames = read_frames(spark, root, ["success", "next.success"])
    success = frames.groupBy("dataset", F.col("episode_index").cast("bigint").alias("episode_index")).agg(
        any_true(frames, ["success", "next.success"]).alias("success")
    )
    joined = index.join(files, ["dataset", "episode_index"]).join(success, ["dataset", "episode_index"], "left")
    duration = F.when(F.col("rate_hz") > 0, F.round(F.col("frames") / F.when(F.col("rate_hz") > 0, F.col("rate_hz")) * 1000)).otherwise(0)
    good = joined.filter(F.col("_bad").isNull()).select(
        "dataset", "episode_index", "layout", "files", "range", "frames", "rate_hz", duration.cast("bigint").alias("duration_ms"),
        "instruction", "channels", "embodiment", "success", "info_hash",
    )
    errors = joined.filter(F.col("_bad").isNotNull()).select(
        "dataset", "episode_index", F.lit("unreadable").alias("code"), F.concat_ws(": ", "_bad.problem", "_bad.path").alias("message")
    )
    return good, errors


def write_frames(frames: DataFrame, path: str, files: int) -> None:
    """Frames with float lists as Parquet, episodes kept together and in order."""
    (
        frames.repartitionByRange(files, "episode_index")
        .sortWithinPartitions("episode_index", "frame_index")
        .write.mode("append")
        .parquet(path)
    )
