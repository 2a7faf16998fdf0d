"""The corpus pipeline: five stages over the documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episode_audit.llm.common import prepared, table
from episode_audit.llm.exact_dedup import drop_copies
from episode_audit.llm.mixing import mix
from episode_audit.llm.parity_join import one_of_each
from episode_audit.llm.pieces import encode
from episode_audit.llm.toxicity import fit, reject
from episode_audit.session import checkpoint_folder


COPY = "mix_copy"  # which copy of a document a row of the mix is


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst passage scores below one half."""
    prepared(spark)
    return reject(docs, fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    prepared(spark)
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets nearly agree."""
    prepared(spark)
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    prepared(spark)
    return mix(docs, copy_col=COPY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text; a document the mix took twice has a row, with dropout of its own, for each time."""
    prepared(spark)
    rows = encode(docs, keep=["doc_id", "source"], copy_col=COPY)
    return rows.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "lossless")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("parity_join", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The stages score and decide in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps lies in a run folder beside the checkpoints."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
