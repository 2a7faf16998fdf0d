"""Dataset intake as one job: read, build manifests, validate, encode, append."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType

from .. import fixed_values as fixed
from ..functions import hashing as H
from ..functions import records, validate
from ..operators import merkle as M
from ..operators.row_series import numbered
from ..session import cut_lineage
from ..sources.episodes import read_dataset


@dataclass(frozen=True)
class IntakeContext:
    org_id: str
    source: str
    captured_at: int
    submitted_at: int
    terms_hash: str  # 0x + 64 hex digits
    scope_bits: int = 0


def manifests(episodes: DataFrame, context: IntakeContext) -> DataFrame:
    """One manifest struct per episode; `payload_root` is the digest of its files.

    Expects consent_commitment (binary) on the episode rows.
    """
    leaf = lambda f: H.file_leaf(f.getField("path"), F.unhex(F.substring(f.getField("hash"), 3, 64)))
    root = M.fold(F.transform("files", leaf))
    hexed = lambda c: F.concat(F.lit("0x"), H.hex_text(c))
    rows = episodes.withColumn("payload_root", root)
    manifest = F.struct(
        F.lit(1).alias("v"),
        F.lit("capture_manifest").alias("kind"),
        F.lit(context.org_id).alias("org_id"),
        F.col("dataset").alias("dataset_id"),
        F.lit(context.source).alias("source"),
        "layout",
        "embodiment",
        "rate_hz",
        "duration_ms",
        F.lit(context.captured_at).cast("bigint").alias("captured_at"),
        "channels",
        "files",
        F.when(
            F.col("range").isNotNull(),
            F.struct("episode_index", F.col("range.frames").alias("frames"), F.col("range.video").alias("video")),
        ).alias("range"),
        hexed(F.col("payload_root")).alias("payload_hash"),
        hexed(F.col("consent_commitment")).alias("consent_commitment"),
        F.lit(context.terms_hash).alias("terms_hash"),
        F.lit(context.scope_bits).cast("bigint").alias("scope_bits"),
        F.when(
            F.col("instruction").isNotNull(), F.struct(F.col("instruction").alias("instruction"), F.lit(None).cast("string").alias("task_id"))
        ).alias("task"),
        F.when(F.col("success").isNotNull(), F.struct(F.col("success").alias("success"))).alias("outcome"),
        F.lit(None).cast("struct<task_spec_hash:string,world_seed:string>").alias("sim"),
        F.lit(None).cast("struct<alg:string,key_id:string,sig:string>").alias("signature"),
    )
    return rows.withColumn("manifest", manifest)


def canonical(value: Column, kind: DataType) -> Column:
    """The value with struct fields and map keys in byte order at every depth."""
    if isinstance(kind, StructType):
        names = sorted(kind.names, key=lambda n: n.encode())
        ordered = F.struct(*(canonical(value.getField(n), kind[n].dataType).alias(n) for n in names))
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        # entries are ordered by their keys alone, so values of any kind may follow
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), 0)))
    return value


def manifest_hash(manifest: Column, kind: StructType) -> Column:
    """Digest of the manifest without its signature: keys in byte order at every depth, whole numbers without a fraction."""
    unsigned = StructType([f for f in kind if f.name != "signature"])
    whole = StructType([StructField("rate_hz", LongType()) if f.name == "rate_hz" else f for f in unsigned])

    def text(fields: StructType) -> Column:
        picked = F.struct(*(manifest.getField(f.name).cast(f.dataType).alias(f.name) for f in fields))
        return F.to_json(canonical(picked, fields), {"ignoreNullFields": "false"})

    rate = manifest.getField("rate_hz").cast("double")
    return H.digest(H.utf8(F.when((rate == F.floor(rate)) & (F.abs(rate) < 2**53), text(whole)).otherwise(text(unsigned))))


def episode_record(submitted_at: int) -> Column:
    """Fixed-width record of a valid manifest (columns manifest, manifest_hash)."""
    m = F.col("manifest").getField
    raw = lambda c: F.unhex(F.substring(c, 3, 64))
    task = m("task")
    task_id = F.coalesce(
        raw(task.getField("task_id")), H.digest(H.utf8(task.getField("instruction"))), F.unhex(F.lit("00" * 32))
    )
    return records.encode(
        fixed.EPISODE_LAYOUT,
        {
            "payload_hash": raw(m("payload_hash")),
            "manifest_hash": F.col("manifest_hash"),
            "consent_commitment": raw(m("consent_commitment")),
            "terms_id": raw(m("terms_hash")),
            "task_id": task_id,
            "captured_at": m("captured_at"),
            "submitted_at": F.lit(submitted_at),
            "duration_ms": m("duration_ms"),
            "scope_bits": m("scope_bits"),
            "channels": F.least(F.size(m("channels")), F.lit(255)),
            "world_seed": F.coalesce(m("sim").getField("world_seed").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")),
            "success_flag": F.when(m("outcome").getField("success"), 1).otherwise(0),
            "quality_score": F.lit(0),
        },
    )


def ingest(
    spark: SparkSession, root: str, context: IntakeContext, log: DataFrame, consents: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new log rows, errors) for every episode below `root`.

    log: idx, org_id, manifest_hash of what is already logged, and salt where salts
    were kept. consents: dataset, episode_index, record, salt. Every episode is
    either appended or has an error of its own: no consent row, several of them,
    a salt that the organisation used before or that an earlier episode of this
    batch uses, an invalid manifest, one logged before, or one that does not fit
    the record.
    """
    episodes, unreadable = read_dataset(spark, root)
    place = F.struct("dataset", "episode_index")
    used = consents.groupBy("salt").agg(F.min(place).alias("_salt_first"))
    if "salt" in log.columns:
        old = log.filter(F.col("org_id") == context.org_id).select("salt").distinct().withColumn("_salt_logged", F.lit(True))
        used = used.join(old, "salt", "left")
    else:
        used = used.withColumn("_salt_logged", F.lit(None).cast("boolean"))
    once = consents.groupBy("dataset", "episode_index").agg(
        F.count(F.lit(1)).alias("_consents"), F.first("record").alias("record"), F.first("salt").alias("salt")
    )
    known = once.join(used, "salt", "left").select(
        "dataset", "episode_index", "_consents", H.consent_commitment(F.col("record"), F.col("salt")).alias("consent_commitment"),
        H.consent_key(F.col("record")).alias("consent_key"),
        (F.coalesce("_salt_logged", F.lit(False)) | (F.col("_salt_first") < place)).alias("_reused"),
    )
    with_consent = episodes.join(known, ["dataset", "episode_index"], "left")
    fault = (
        F.when(F.col("_consents").isNull() | F.col("consent_commitment").isNull(), "no_consent")
        .when(F.col("_consents") > 1, "several_consents")
        .when(F.col("_reused"), "salt_reused")
    )
    refused = with_consent.filter(fault.isNotNull()).select(
        "dataset", "episode_index", fault.alias("code"), F.lit("the episode's consent cannot be used").alias("message")
    )
    built = manifests(with_consent.filter(fault.isNull()).drop("_consents", "_reused"), context)
    checked = cut_lineage(
        built.select(
            "dataset", "episode_index", "manifest", "consent_key", manifest_hash(F.col("manifest"), built.schema["manifest"].dataType).alias("manifest_hash"),
            validate.manifest_issues(F.col("manifest"), F.col("payload_root")).alias("issues"),
        )
    )
    invalid = checked.filter(F.size("issues") > 0).select(
        "dataset", "episode_index", F.lit("invalid").alias("code"), F.array_join("issues", "; ").alias("message")
    )
    valid = checked.filter(F.size("issues") == 0)
    firsts = valid.groupBy("manifest_hash").agg(F.min(F.struct("dataset", "episode_index")).alias("_first"))
    own = log.filter(F.col("org_id") == context.org_id).select("manifest_hash", F.col("idx").alias("logged_at"))
    judged = valid.join(firsts, "manifest_hash").join(own, "manifest_hash", "left")
    repeated = (F.col("_first.dataset") != F.col("dataset")) | (F.col("_first.episode_index") != F.col("episode_index"))
    conflict = F.col("logged_at").isNotNull() | repeated
    conflicts = judged.filter(conflict).select(
        "dataset", "episode_index", F.lit("conflict").alias("code"),
        F.coalesce(F.concat(F.lit("already logged at "), F.col("logged_at").cast("string")), F.lit("same manifest twice in this batch")).alias("message"),
    )
    size = log.count()
    encoded = cut_lineage(
        judged.filter(~conflict).withColumn("record", episode_record(context.submitted_at)).select(
            "dataset", "episode_index", "manifest_hash", "consent_key", "record"
        )
    )
    unfit = encoded.filter(F.col("record").isNull()).select(
        "dataset", "episode_index", F.lit("not_encodable").alias("code"), F.lit("a value does not fit the record").alias("message")
    )
    fresh = encoded.filter(F.col("record").isNotNull())
    placed = numbered(fresh.select("dataset", "episode_index", "manifest_hash", "consent_key", "record"), [], ["episode_index", "dataset"], "at")
    appended = placed.select(
        (F.col("at") + size).alias("idx"), H.leaf_hash(F.col("record")).alias("leaf"), F.lit(context.org_id).alias("org_id"),
        "dataset", "episode_index", "manifest_hash", "consent_key", "record", (F.col("at") + size + 1).alias("log_size_after"),
    )
    return appended, unreadable.unionByName(refused).unionByName(invalid).unionByName(conflicts).unionByName(unfit)
