"""Row-wise jobs: paths, digests, records, validation, draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import draws, records, text, validate
from ..functions import hashing as H
from ..operators.scenes import draw_scene, scene_digest
from ..session import cut_lineage
from . import proxies as P
from .registry import query

DATA_TEMPLATE = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"


@query(
    "path_template",
    """SELECT doc_id, 'data/chunk-' || lpad(CAST(doc_id // 100 AS VARCHAR), greatest(3, length(CAST(doc_id // 100 AS VARCHAR)))::INT, '0')
       || '/file-' || lpad(CAST(n_chars AS VARCHAR), greatest(3, length(CAST(n_chars AS VARCHAR)))::INT, '0') || '.parquet' AS path
       FROM documents""",
)
def path_template(spark, sf_dir):
    values = {"chunk_index": F.floor(F.col("doc_id") / 100), "file_index": F.col("n_chars")}
    return P.table(spark, sf_dir, "documents").select("doc_id", text.fill_template(DATA_TEMPLATE, values).alias("path"))


URL_PATH = "^[a-z]+://[^/]+/?(.*)$"


@query(
    "path_rule",
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '{URL_PATH}', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '' THEN 'empty path' WHEN path LIKE '/%' THEN 'leading slash'
  WHEN contains(path, chr(92)) THEN 'backslash' WHEN contains(path, chr(31)) THEN 'separator byte'
  WHEN list_contains(string_split(path, '/'), '') THEN 'empty segment'
  WHEN list_contains(string_split(path, '/'), '..') THEN 'parent segment'
  WHEN NOT regexp_matches(path, '^[A-Za-z0-9]') THEN 'first character' ELSE 'ok' END AS problem
FROM p""",
)
def path_rule(spark, sf_dir):
    path = F.regexp_extract("url", URL_PATH, 1)
    return (
        P.table(spark, sf_dir, "pages")
        .select("page_id", path.alias("path"))
        .withColumn("problem", F.coalesce(text.path_problem(F.col("path")), F.lit("ok")))
    )


@query("distinct_paths", f"SELECT DISTINCT regexp_extract(url, '{URL_PATH}', 1) AS path FROM pages")
def distinct_paths(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select(F.regexp_extract("url", URL_PATH, 1).alias("path")).distinct()


@query(
    "content_fingerprint",
    """SELECT doc_id, source || '/' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
       sha256(encode(text)) AS hash FROM documents""",
)
def content_fingerprint(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.sha2(H.utf8(F.col("text")), 256).alias("hash"),
    )


@query(
    "content_store_new",
    """WITH f AS (SELECT doc_id, sha256(encode(text)) AS hash, CAST(substr(source, 4) AS INT) >= 10 AS arriving FROM documents)
SELECT hash, min(doc_id) AS first_doc, count(*) AS copies FROM f
WHERE arriving AND hash NOT IN (SELECT hash FROM f WHERE NOT arriving) GROUP BY hash""",
)
def content_store_new(spark, sf_dir):
    """Contents that are not stored yet, one row each."""
    files = P.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(H.utf8(F.col("text")), 256).alias("hash"),
        (F.substring("source", 4, 9).cast("int") >= 10).alias("arriving"),
    )
    arriving = (
        files.filter("arriving").groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    )
    return arriving.join(files.filter("not arriving").select("hash").distinct(), "hash", "left_anti")


@query("leaf_hash", "WITH " + P.DOC_LEAVES_SQL + " SELECT idx, lower(hex(leaf)) AS leaf FROM leaves")
def leaf_hash(spark, sf_dir):
    return P.document_leaves(spark, sf_dir).select("idx", H.hex_text(F.col("leaf")).alias("leaf"))


@query(
    "row_fingerprint",
    """WITH r AS (SELECT o_orderkey AS idx, '{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"customer":' || o_custkey ||
  ',"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '"' AS head, o_orderstatus AS status FROM orders)
SELECT idx, sha256(encode(head || ',"status":"' || status || '"}')) AS hash, sha256(encode(head || '}')) AS hash_without_status FROM r""",
)
def row_fingerprint(spark, sf_dir):
    """Canonical object digest: keys in byte order, no blanks, keys left out on request."""
    columns = {
        "cents": P.cents("o_totalprice"),
        "customer": F.col("o_custkey"),
        "key": F.col("o_orderkey"),
        "priority": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"),
    }
    fields = [c.alias(n) for n, c in sorted(columns.items())]
    kept = [c.alias(n) for n, c in sorted(columns.items()) if n != "status"]
    return P.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.sha2(F.to_json(F.struct(*fields)), 256).alias("hash"),
        F.sha2(F.to_json(F.struct(*kept)), 256).alias("hash_without_status"),
    )


CONSENT_SQL = """
consent AS (
  SELECT c_custkey, unhex(sha256(encode(c_name || '|' || c_mktsegment))) AS record,
         unhex(sha256(encode('salt-' || c_nationkey || '-' || c_custkey % 97))) AS salt FROM customer)"""


def consent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "customer").select(
        "c_custkey",
        H.digest(H.utf8(F.concat_ws("|", "c_name", "c_mktsegment"))).alias("record"),
        H.digest(
            H.utf8(F.concat_ws("-", F.lit("salt"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 97).cast("string")))
        ).alias("salt"),
    )


@query(
    "consent_keys",
    "WITH " + CONSENT_SQL + """
SELECT c_custkey, sha256('\\x02'::BLOB || record) AS consent_key, sha256(record || salt) AS commitment,
       sha256(record || encode('revoked')) AS revoked_value FROM consent""",
)
def consent_keys(spark, sf_dir):
    record = F.col("record")
    return consent_records(spark, sf_dir).select(
        "c_custkey",
        H.hex_text(H.consent_key(record)).alias("consent_key"),
        H.hex_text(H.consent_commitment(record, F.col("salt"))).alias("commitment"),
        H.hex_text(H.revocation_value(record)).alias("revoked_value"),
    )


# ------------------------------------------------------------------ records


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values of one record per log entry; kinds take turns."""
    idx = F.col("o_orderkey")
    named = lambda name, key: H.digest(H.utf8(F.concat(F.lit(name + "-"), key.cast("string"))))
    return P.table(spark, sf_dir, "orders").select(
        idx.alias("idx"),
        (idx % 4 + 1).alias("kind"),
        named("payload", idx).alias("payload"),
        named("manifest", idx).alias("manifest"),
        named("consent", idx).alias("consent"),
        named("terms", F.col("o_custkey") % 10).alias("terms"),
        named("task", idx % 50).alias("task"),
        P.seconds("o_orderdate").alias("at"),
        P.cents("o_totalprice").alias("cents"),
        F.col("o_custkey").alias("cust"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("flag"),
    )


VALUES_SQL = """
vals AS (
  SELECT o_orderkey AS idx, o_orderkey % 4 + 1 AS kind, sha256(encode('payload-' || o_orderkey)) AS payload,
         sha256(encode('manifest-' || o_orderkey)) AS manifest, sha256(encode('consent-' || o_orderkey)) AS consent,
         sha256(encode('terms-' || o_custkey % 10)) AS terms, sha256(encode('task-' || o_orderkey % 50)) AS task,
         CAST(epoch(o_orderdate) AS BIGINT) AS "at", CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey AS cust,
         CAST(o_orderstatus = 'F' AS BIGINT) AS flag
  FROM orders)"""


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table as it would be stored: decoding reads a plain binary column."""
    return cut_lineage(record_table(spark, sf_dir))


def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded records, some damaged: cut short, unknown version, empty."""
    c = F.col
    quality = c("cents") % 10001
    capture = records.encode(
        fixed.CAPTURE_LAYOUT,
        {
            "payload_hash": c("payload"), "manifest_hash": c("manifest"), "consent_commitment": c("consent"),
            "terms_id": c("terms"), "captured_at": c("at"), "submitted_at": c("at") + 60,
            "duration_ms": c("cents") % 600000, "scope_bits": c("cust") % 16, "channels": F.least(c("cust") % 300, F.lit(255)),
        },
    )
    episode = records.encode(
        fixed.EPISODE_LAYOUT,
        {
            "payload_hash": c("payload"), "manifest_hash": c("manifest"), "consent_commitment": c("consent"),
            "terms_id": c("terms"), "task_id": c("task"), "captured_at": c("at"), "submitted_at": c("at") + 60,
            "duration_ms": c("cents") % 600000, "scope_bits": c("cust") % 16, "channels": F.least(c("cust") % 300, F.lit(255)),
            "world_seed": c("idx") * 7919, "success_flag": c("flag"), "quality_score": quality,
        },
    )
    corpus = records.encode(
        fixed.CORPUS_LAYOUT,
        {
            "corpus_manifest_hash": c("manifest"), "corpus_root": c("payload"), "terms_hash": c("terms"),
            "task_id": c("task"), "episode_count": c("cust") % 9, "sealed_at": c("at"),
        },
    )
    claim = records.encode(
        fixed.CLAIM_LAYOUT,
        {
            "subject_leaf": c("payload"), "verifier_key_id": c("manifest"), "detail_hash": c("consent"),
            "signature_hash": c("terms"), "check_id": c("cust") % 8, "result": c("cust") % 4,
            "level_asserted": c("cust") % 6, "issued_at": c("at"),
        },
    )
    whole = (
        F.when(c("kind") == 1, capture).when(c("kind") == 2, episode).when(c("kind") == 3, corpus).otherwise(claim)
    )
    damaged = (
        F.when(c("idx") % 23 == 0, H.binary(""))
        .when(c("idx") % 19 == 0, F.concat(H.binary("09"), F.expr("substring(record, 2)")))
        .when(c("idx") % 17 == 0, F.expr("substring(record, 1, length(record) - 1)"))
        .otherwise(c("record"))
    )
    return record_values(spark, sf_dir).withColumn("record", whole).withColumn("record", damaged)


def _be(expr: str, width: int) -> str:
    return f"lpad(lower(to_hex(CAST({expr} AS BIGINT))), {2 * width}, '0')"


RECORDS_SQL = VALUES_SQL + f""",
whole AS (
  SELECT *, CASE kind
    WHEN 1 THEN '01' || payload || manifest || consent || terms || {_be('"at"', 8)} || {_be('"at" + 60', 8)} ||
         {_be('cents % 600000', 4)} || {_be('cust % 16', 4)} || {_be('least(cust % 300, 255)', 1)}
    WHEN 2 THEN '02' || payload || manifest || consent || terms || task || {_be('"at"', 8)} || {_be('"at" + 60', 8)} ||
         {_be('cents % 600000', 4)} || {_be('cust % 16', 4)} || {_be('least(cust % 300, 255)', 1)} ||
         {_be('idx * 7919', 8)} || {_be('flag', 1)} || {_be('cents % 10001', 2)}
    WHEN 3 THEN '03' || manifest || payload || terms || task || {_be('cust % 9', 8)} || {_be('"at"', 8)}
    ELSE '04' || payload || manifest || consent || terms || {_be('cust % 8', 2)} || {_be('cust % 4', 1)} ||
         {_be('cust % 6', 1)} || {_be('"at"', 8)} END AS whole_record
  FROM vals),
recs AS (
  SELECT *, CASE WHEN idx % 23 = 0 THEN '' WHEN idx % 19 = 0 THEN '09' || substr(whole_record, 3)
                 WHEN idx % 17 = 0 THEN substr(whole_record, 1, length(whole_record) - 2) ELSE whole_record END AS record,
         CASE WHEN idx % 23 = 0 THEN 'empty record' WHEN idx % 19 = 0 THEN 'unknown version'
              WHEN idx % 17 = 0 THEN 'wrong length for version'
              WHEN kind = 4 AND cust % 4 > 2 THEN 'result out of range'
              WHEN kind = 4 AND cust % 6 > 4 THEN 'level out of range'
              WHEN kind = 4 AND cust % 8 = 0 THEN 'check id zero'
              WHEN kind = 3 AND cust % 9 = 0 THEN 'no episodes' END AS problem
  FROM whole)"""


@query("record_encode", "WITH " + RECORDS_SQL + " SELECT idx, record FROM recs")
def record_encode(spark, sf_dir):
    return record_table(spark, sf_dir).select("idx", H.hex_text(F.col("record")).alias("record"))


@query(
    "record_decode",
    "WITH " + RECORDS_SQL + """
SELECT idx, CASE kind WHEN 1 THEN 'capture' WHEN 2 THEN 'episode' WHEN 3 THEN 'corpus' ELSE 'claim' END AS kind,
  CASE WHEN kind <= 2 THEN payload WHEN kind = 3 THEN manifest ELSE payload END AS first_hash,
  CASE kind WHEN 1 THEN "at" WHEN 2 THEN "at" WHEN 3 THEN "at" ELSE "at" END AS recorded_at,
  CASE WHEN kind <= 2 THEN cents % 600000 END AS duration_ms, CASE kind WHEN 2 THEN idx * 7919 END AS world_seed,
  CASE kind WHEN 2 THEN cents % 10001 END AS quality_score, CASE kind WHEN 3 THEN cust % 9 END AS episode_count,
  CASE kind WHEN 4 THEN cust % 8 END AS check_id, CASE kind WHEN 4 THEN cust % 4 END AS result
FROM recs WHERE problem IS NULL""",
)
def record_decode(spark, sf_dir):
    record = F.col("record")
    known = stored_records(spark, sf_dir).select("idx", "record").withColumn("kind", records.record_kind(record))
    known = known.filter(F.col("kind") != "error")

    def pick(**fields: str):
        value = F.lit(None)
        for v, (kind, layout) in fixed.RECORD_KINDS.items():
            if kind in fields:
                value = F.when(F.col("kind") == kind, records.field(layout, record, fields[kind])).otherwise(value)
        return value

    first = pick(capture="payload_hash", episode="payload_hash", corpus="corpus_manifest_hash", claim="subject_leaf")
    return known.select(
        "idx",
        "kind",
        H.hex_text(first).alias("first_hash"),
        pick(capture="captured_at", episode="captured_at", corpus="sealed_at", claim="issued_at").alias("recorded_at"),
        pick(capture="duration_ms", episode="duration_ms").alias("duration_ms"),
        pick(episode="world_seed").cast("bigint").alias("world_seed"),
        pick(episode="quality_score").alias("quality_score"),
        pick(corpus="episode_count").alias("episode_count"),
        pick(claim="check_id").alias("check_id"),
        pick(claim="result").alias("result"),
    )


@query(
    "record_kinds",
    "WITH " + RECORDS_SQL + """
SELECT CASE WHEN problem IS NOT NULL THEN 'error' ELSE CASE kind WHEN 1 THEN 'capture' WHEN 2 THEN 'episode'
  WHEN 3 THEN 'corpus' ELSE 'claim' END END AS kind, coalesce(problem, '') AS problem, count(*) AS records
FROM recs GROUP BY 1, 2""",
)
def record_kinds(spark, sf_dir):
    record = F.col("record")
    return (
        stored_records(spark, sf_dir)
        .select(
            records.record_kind(record).alias("kind"),
            F.coalesce(records.record_problem(record), F.lit("")).alias("problem"),
        )
        .groupBy("kind", "problem")
        .agg(F.count(F.lit(1)).alias("records"))
    )


@query(
    "fact_filter",
    "WITH " + RECORDS_SQL + """
SELECT idx, task AS task_id, cents % 10001 AS quality_score, idx * 7919 AS world_seed FROM recs
WHERE problem IS NULL AND kind = 2 AND flag = 1 AND cents % 10001 >= 5000""",
)
def fact_filter(spark, sf_dir):
    """What a buyer filters on, read from the records themselves."""
    record, layout = F.col("record"), fixed.EPISODE_LAYOUT
    value = lambda name: records.field(layout, record, name)

    return (
        stored_records(spark, sf_dir)
        .filter(records.record_kind(record) == "episode")
        .filter((value("success_flag") == 1) & (value("quality_score") >= 5000))
        .select(
            "idx", H.hex_text(value("task_id")).alias("task_id"), value("quality_score").alias("quality_score"),
            value("world_seed").cast("bigint").alias("world_seed"),
        )
    )


@query(
    "union_kinds",
    "WITH " + RECORDS_SQL + """
SELECT idx, 'capture' AS kind, cents % 600000 AS duration_ms, NULL::BIGINT AS episode_count, NULL::BIGINT AS check_id FROM recs WHERE problem IS NULL AND kind = 1
UNION ALL SELECT idx, 'episode', cents % 600000, NULL, NULL FROM recs WHERE problem IS NULL AND kind = 2
UNION ALL SELECT idx, 'corpus', NULL, cust % 9, NULL FROM recs WHERE problem IS NULL AND kind = 3
UNION ALL SELECT idx, 'claim', NULL, NULL, cust % 8 FROM recs WHERE problem IS NULL AND kind = 4""",
)
def union_kinds(spark, sf_dir):
    """Tables of different kinds brought under one schema."""
    record = F.col("record")
    known = stored_records(spark, sf_dir).select("idx", "record", records.record_kind(record).alias("kind"))
    wanted = {"capture": ["duration_ms"], "episode": ["duration_ms"], "corpus": ["episode_count"], "claim": ["check_id"]}
    parts = []
    for _, (kind, layout) in fixed.RECORD_KINDS.items():
        parts.append(
            known.filter(F.col("kind") == kind).select(
                "idx", "kind", *(records.field(layout, record, n).alias(n) for n in wanted[kind])
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# --------------------------------------------------------------- validation


@query(
    "claim_issues",
    """WITH d AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS v FROM events)
SELECT event_id, CASE v WHEN 0 THEN '' WHEN 1 THEN 'thresholds is required' WHEN 2 THEN 'check_version is required'
  WHEN 3 THEN 'detail must be an object; check_version is required; thresholds is required'
  ELSE 'check_version is required; thresholds is required' END AS issues FROM d""",
)
def claim_issues(spark, sf_dir):
    v = F.get_json_object("props", "$.k").cast("bigint") % 5
    detail = (
        F.when(v == 0, F.concat(F.lit('{"check_version":"a.v1","thresholds":'), F.col("props"), F.lit("}")))
        .when(v == 1, F.lit('{"check_version":"a.v1","thresholds":[1]}'))
        .when(v == 2, F.concat(F.lit('{"check_version":"","thresholds":'), F.col("props"), F.lit("}")))
        .when(v == 3, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise(F.col("props"))
    )
    return P.table(spark, sf_dir, "events").select(
        "event_id", F.array_join(validate.claim_detail_issues(detail), "; ").alias("issues")
    )


@query(
    "manifest_issues",
    """WITH d AS (SELECT doc_id, n_chars, source, lang FROM documents)
SELECT doc_id, concat_ws('; ',
  CASE WHEN doc_id % 7 = 3 THEN 'source is not known' END,
  CASE WHEN n_chars % 50 = 0 THEN 'rate_hz must be positive' END,
  CASE WHEN doc_id % 11 = 5 THEN 'channels must be sorted by name and unique' END,
  CASE WHEN doc_id % 13 = 6 THEN 'invalid file path' END,
  CASE WHEN doc_id % 5 = 1 THEN 'range is required when layout is chunked' END,
  CASE WHEN doc_id % 17 = 2 THEN 'payload_hash does not match its files' END) AS issues
FROM d""",
)
def manifest_issues(spark, sf_dir):
    """Capture manifests of the documents with planted faults."""
    i = F.col("doc_id")
    file_path = lambda name: F.concat(F.when(i % 13 == 6, F.lit("/")).otherwise(F.lit("")), F.lit(name))
    rows = P.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", H.digest(H.utf8(F.col("text"))).alias("content"), file_path("data/a.parquet").alias("path_a"),
        file_path("video/b.mp4").alias("path_b"),
    )
    rows = rows.withColumn(
        "root",
        H.node_hash(H.file_leaf(F.col("path_a"), F.col("content")), H.file_leaf(F.col("path_b"), F.col("content"))),
    )
    hexed = lambda c: F.concat(F.lit("0x"), H.hex_text(c))
    channel = lambda name: F.struct(
        F.lit(name).alias("name"), F.lit("float32").alias("dtype"), F.array(F.lit(3)).alias("shape"), F.lit(30.0).alias("hz")
    )
    file = lambda path: F.struct(F.col(path).alias("path"), F.col("n_chars").alias("bytes"), hexed(F.col("content")).alias("hash"))
    manifest = F.struct(
        F.lit(1).alias("v"),
        F.lit("capture_manifest").alias("kind"),
        F.lit("org").alias("org_id"),
        F.lit(None).cast("string").alias("dataset_id"),
        F.when(i % 7 == 3, "real").otherwise("teleop_real").alias("source"),
        F.lit("chunked").alias("layout"),
        F.lit("so_arm100").alias("embodiment"),
        (F.col("n_chars") % 50).cast("double").alias("rate_hz"),
        F.col("n_chars").alias("duration_ms"),
        F.lit(0).alias("captured_at"),
        F.when(i % 11 == 5, F.array(channel("observation.state"), channel("action")))
        .otherwise(F.array(channel("action"), channel("observation.state")))
        .alias("channels"),
        F.array(file("path_a"), file("path_b")).alias("files"),
        F.when(i % 5 != 1, F.struct(i.alias("episode_index"))).alias("range"),
        hexed(F.when(i % 17 == 2, F.col("content")).otherwise(F.col("root"))).alias("payload_hash"),
        hexed(F.col("content")).alias("consent_commitment"),
        hexed(F.col("content")).alias("terms_hash"),
        F.lit(0).alias("scope_bits"),
        F.struct(F.lit("7").alias("world_seed")).alias("sim"),
    )
    checked = rows.withColumn("m", manifest).select("doc_id", validate.manifest_issues(F.col("m"), F.col("root")).alias("issues"))
    return checked.select("doc_id", F.array_join("issues", "; ").alias("issues"))


@query(
    "corpus_issues",
    """WITH m AS (SELECT l_suppkey AS corpus, l_orderkey AS idx, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT corpus, CAST(sum(n) AS BIGINT) AS listed, count(*) AS distinct_members, count(*) FILTER (n > 1) AS repeated_members,
  CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'episodes must be unique' ELSE '' END AS issues FROM m GROUP BY corpus""",
)
def corpus_issues(spark, sf_dir):
    """Member uniqueness without collecting a collection into one row."""
    per_member = P.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_member.groupBy(F.col("l_suppkey").alias("corpus"))
        .agg(
            F.sum("n").alias("listed"), F.count(F.lit(1)).alias("distinct_members"), F.count_if(F.col("n") > 1).alias("repeated_members")
        )
        .withColumn("issues", F.when(F.col("repeated_members") > 0, "episodes must be unique").otherwise(""))
    )


def _json_sql() -> str:
    """A capture manifest as text: unknown keys at the top, in the range, in a file and in the signature."""
    return """'{"v":1,"kind":"capture_manifest","range":{"episode_index":' || doc_id || ',"frames":[0,1],"video":{"any":[0,1]}'
      || CASE WHEN doc_id % 3 = 1 THEN ',"chain_id":1' ELSE '' END || '},"files":[{"path":"a","bytes":1},{"path":"b"' || CASE WHEN doc_id % 4 = 2 THEN ',"mode":7,"owner":"x"' ELSE '' END
      || '}],"signature":' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '{"alg":"ed25519"' || CASE WHEN doc_id % 7 = 3 THEN ',"nonce":"' || n_chars || '"' ELSE '' END || '}' END
      || CASE WHEN doc_id % 11 = 4 THEN ',"' || source || '":true' ELSE '' END || '}'"""


@query(
    "unknown_keys",
    f"""WITH m AS (SELECT doc_id, ({_json_sql()})::JSON AS j FROM documents),
known(place, names) AS (VALUES ('', {list(fixed.CAPTURE_SHAPE)}), ('range.', {list(fixed.CAPTURE_SHAPE['range'])}), ('file', {list(fixed.CAPTURE_SHAPE['files'][0])}), ('signature.', {list(fixed.CAPTURE_SHAPE['signature'])})),
parts AS (
  SELECT doc_id, '' AS place, '' AS shown, j AS o FROM m UNION ALL SELECT doc_id, 'range.', 'range.', j->'range' FROM m
  UNION ALL SELECT doc_id, 'signature.', 'signature.', j->'signature' FROM m
  UNION ALL SELECT doc_id, 'file', 'files[' || i || '].', json_extract(j, '$.files[' || i || ']') FROM m, range(0, 2) t(i)),
keys AS (SELECT doc_id, place, shown, unnest(json_keys(o)) AS k FROM parts WHERE json_type(o) = 'OBJECT')
SELECT doc_id, string_agg(shown || k, ',' ORDER BY shown || k) AS unknown FROM keys JOIN known USING (place) WHERE NOT list_contains(names, k) GROUP BY doc_id""",
)
def unknown_keys(spark, sf_dir):
    """Manifests as text with keys that the closed shape does not have, whatever their depth."""
    rows = P.table(spark, sf_dir, "documents").select("doc_id", F.expr(_json_sql().replace("::JSON", "")).alias("j"))
    found = rows.select("doc_id", F.array_sort(validate.unknown_keys(F.col("j"), fixed.CAPTURE_SHAPE)).alias("k"))
    return found.filter(F.size("k") > 0).select("doc_id", F.array_join("k", ",").alias("unknown"))


@query(
    "corpus_manifest_issues",
    """WITH c AS (
  SELECT l_suppkey AS corpus, count(*) AS listed, count(DISTINCT l_orderkey) AS members, list(DISTINCT substr(l_shipdate::VARCHAR, 1, 4)) AS years FROM lineitem GROUP BY 1),
m AS (SELECT *, listed - (corpus % 3 = 0)::INT AS episode_count, CASE corpus % 4 WHEN 0 THEN ['mixed', 'sim'] WHEN 1 THEN ['sim', 'mixed'] WHEN 2 THEN ['real', 'sim'] END AS sources FROM c)
SELECT corpus, concat_ws('; ', CASE WHEN corpus % 10 = 7 THEN 'title is required' END, CASE WHEN members < listed THEN 'episodes must be unique' END,
  CASE WHEN episode_count <> listed THEN 'episode_count is not the number of episodes' END,
  CASE WHEN len(list_filter(sources, lambda s: s NOT IN ('sim', 'teleop_sim', 'teleop_real', 'autonomous_real', 'mixed'))) > 0 THEN 'source is not known' END,
  CASE WHEN list_sort(list_distinct(sources)) <> sources THEN 'sources must be sorted and unique' END) AS issues FROM m""",
)
def corpus_manifest_issues(spark, sf_dir):
    """Corpus manifests whose count, title or sources do not fit their members."""
    per_member = P.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    facts = per_member.groupBy(F.col("l_suppkey").alias("corpus")).agg(F.sum("n").alias("listed"), F.count(F.lit(1)).alias("members"))
    c = F.col("corpus")
    named = lambda *names: F.array(*map(F.lit, names))
    sources = F.when(c % 4 == 0, named("mixed", "sim")).when(c % 4 == 1, named("sim", "mixed")).when(c % 4 == 2, named("real", "sim"))
    manifest = F.struct(
        F.lit(1).alias("v"), F.lit("corpus_manifest").alias("kind"), F.lit("org").alias("org_id"), F.when(c % 10 == 7, "").otherwise("a title").alias("title"),
        F.lit("0x" + "ab" * 32).alias("terms_hash"), F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("string").alias("corpus_root"),
        (F.col("listed") - F.when(c % 3 == 0, 1).otherwise(0)).alias("episode_count"), sources.alias("sources"), F.lit(None).cast("bigint").alias("sealed_at"),
    )
    found = facts.withColumn("m", manifest).select("corpus", validate.corpus_manifest_issues(F.col("m"), F.col("listed"), F.col("members")).alias("issues"))
    return found.select("corpus", F.array_join("issues", "; ").alias("issues"))


# --------------------------------------------------------- text and amounts

SCANNED = fixed.FORBIDDEN_WORDS + ("la", "the", "and the")


@query(
    "phrase_scan",
    """WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'),
       '(?i)\\b(proven real|independent|authentic|verified|genuine|and the|real|the|la)\\b', 1), lambda w: lower(w)) AS hits FROM documents)
SELECT doc_id, CAST(len(hits) AS BIGINT) AS n_hits, array_to_string(list_sort(list_distinct(hits)), ',') AS phrases FROM h WHERE len(hits) > 0""",
)
def phrase_scan(spark, sf_dir):
    """Occurrences of listed phrases in whole texts; accented letters count as letters."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return (
        P.table(spark, sf_dir, "documents")
        .select("doc_id", text.phrase_hits(plain, SCANNED).alias("hits"))
        .filter(F.size("hits") > 0)
        .select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("phrases"))
    )


@query(
    "amount_text",
    """WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, regexp_replace(cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), '\\.?0+$', '') AS price,
  regexp_replace(cents // 1000000 || '.' || lpad(CAST(cents % 1000000 AS VARCHAR), 6, '0'), '\\.?0+$', '') AS tokens FROM a""",
)
def amount_text(spark, sf_dir):
    cents = P.cents("o_totalprice")
    return P.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.amount_text(cents, 2).alias("price"), text.amount_text(cents, 6).alias("tokens")
    )


# -------------------------------------------------------------------- draws


def _unit_sql(identity: str, seed: str, index: str) -> str:
    return (
        f"(CAST(('0x' || substr(sha256({identity} || unhex({_be(seed, 8)}) || unhex({_be(index, 4)})), 1, 14)) AS BIGINT) >> 3)"
        f" / 9007199254740992.0::DOUBLE"
    )


@query(
    "hash_draws",
    f"""WITH s AS (SELECT c_custkey, unhex(sha256(encode('task-' || c_nationkey))) AS identity, i FROM customer, range(4) t(i)),
u AS (SELECT c_custkey, i, {_unit_sql('identity', 'c_custkey', 'i')} AS u FROM s)
SELECT c_custkey, i AS draw, round(u, 9) AS unit, round(-2.0 + u * 5.0, 9) AS ranged,
  CAST(3 + floor(u * 7) AS BIGINT) AS whole, CAST(least(floor(u * 5), 4) AS BIGINT) AS picked FROM u""",
)
def hash_draws(spark, sf_dir):
    identity = H.digest(H.utf8(F.concat(F.lit("task-"), F.col("c_nationkey").cast("string"))))
    rows = P.table(spark, sf_dir, "customer").select(
        "c_custkey", identity.alias("identity"), F.explode(F.expr("sequence(0L, 3L)")).alias("draw")
    )
    u = F.col("u")
    return rows.withColumn("u", draws.unit(F.col("identity"), F.col("c_custkey"), F.col("draw"))).select(
        "c_custkey",
        "draw",
        F.round(u, 9).alias("unit"),
        F.round(draws.in_range(u, F.lit(-2.0), F.lit(3.0)), 9).alias("ranged"),
        draws.integer(u, F.lit(2.5), F.lit(9.9)).alias("whole"),
        draws.pick(u, F.lit(5)).alias("picked"),
    )


_ID, _SEED = "identity", "p_partkey"


@query(
    "seed_expand",
    f"""WITH s AS (SELECT p_partkey, p_size, p_brand, unhex(sha256(encode(p_name || '|' || p_type))) AS identity FROM part),
n AS (SELECT *, CAST(floor({_unit_sql(_ID, _SEED, '0')} * (p_size % 4 + 1)) AS BIGINT) AS n FROM s),
e AS (SELECT n.*, k FROM n, unnest(range(n)) t(k)),
o AS (SELECT p_partkey, k, ['a', 'b', 'c'][CAST(least(floor({_unit_sql(_ID, _SEED, '1 + 4 * k')} * 3), 2) AS INT) + 1] AS instance,
  {_unit_sql(_ID, _SEED, '2 + 4 * k')} * p_size AS x, -1.0 + {_unit_sql(_ID, _SEED, '3 + 4 * k')} * 2.0 AS y,
  {_unit_sql(_ID, _SEED, '4 + 4 * k')} * 6.25 AS yaw FROM e),
lines AS (SELECT p_partkey, string_agg(printf('mug|%s|%.6f|%.6f|0.000000|%.6f', instance, x, y, yaw), chr(10) ORDER BY k) AS body FROM o GROUP BY 1)
SELECT n.p_partkey, n.n AS objects, sha256(encode(concat_ws(chr(10), 'table', n.p_brand, body,
  printf('%.6f', 0.5 + {_unit_sql(_ID, _SEED, '1 + 4 * n.n')}), '5000.000'))) AS scene
FROM n LEFT JOIN lines USING (p_partkey)""",
)
def seed_expand(spark, sf_dir):
    """One drawn scene per specification and seed, with its digest."""
    d = lambda *xs: F.array(*(F.lit(x).cast("double") if not hasattr(x, "cast") else x.cast("double") for x in xs))
    none = F.lit(None).cast("array<double>")
    size = F.col("p_size")
    thing = F.struct(
        F.lit("mug").alias("category"),
        F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("instances"),
        d(0.0, size).alias("x"),
        d(-1.0, 1.0).alias("y"),
        none.alias("z"),
        d(0.0, 6.25).alias("yaw"),
        d(0.0, size % 4).alias("count"),
    )
    rows = P.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_partkey").alias("seed"),
        H.digest(H.utf8(F.concat_ws("|", "p_name", "p_type"))).alias("identity"),
        F.array(thing).alias("objects"),
        d(0.5, 1.5).alias("intensity"),
        none.alias("temperature"),
        F.lit("table").alias("base"),
        F.col("p_brand").alias("embodiment"),
    )
    drawn = draw_scene(rows)
    return drawn.select("p_partkey", F.size("placed").cast("bigint").alias("objects"), scene_digest().alias("scene"))


# ------------------------------------------------------- lookups, intake


@query(
    "leaf_lookup",
    "WITH " + P.LEAVES_SQL + """
SELECT idx, lower(hex(leaf)) AS leaf, received_at FROM leaves WHERE org IN (7, 11, 13) ORDER BY idx""",
)
def leaf_lookup(spark, sf_dir):
    """Records of given organisations in log order; the filter reaches the scan."""
    return (
        P.leaves(spark, sf_dir)
        .filter(F.col("org").isin(7, 11, 13))
        .orderBy("idx")
        .select("idx", H.hex_text(F.col("leaf")).alias("leaf"), "received_at")
    )


@query(
    "dimension_filter",
    """SELECT n_nationkey AS id, n_name AS name, r_name AS class, count(c_custkey) AS users FROM nation
JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey % 3 = 0 GROUP BY ALL""",
)
def dimension_filter(spark, sf_dir):
    """Dimension rows by class and flag, with how many records use them."""
    users = P.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("users"))
    return (
        P.table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") % 3 == 0)
        .join(P.table(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("class"))
        .join(users, "id", "left")
        .select("id", "name", "class", F.coalesce("users", F.lit(0)).alias("users"))
    )


INTAKE_SQL = """
intake AS (
  SELECT d.doc_id AS episode, d.source AS dataset, CASE WHEN d.n_chars > 20000 THEN 'unsafe_path' WHEN l.doc_id IS NULL THEN 'missing_file' END AS code
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes against the file inventory; a failure names its own episode only."""
    from ..sources.inventory import split_errors

    inventory = P.table(spark, sf_dir, "labels").select(F.concat(F.lit("files/"), F.col("doc_id").cast("string")).alias("path"))
    episodes = P.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("episode"),
        F.col("source").alias("dataset"),
        F.concat(F.when(F.col("n_chars") > 20000, F.lit("../")).otherwise(F.lit("")), F.lit("files/"), F.col("doc_id").cast("string")).alias("path"),
    )
    return split_errors(episodes, inventory)


@query(
    "ingest_errors",
    "WITH " + INTAKE_SQL + """
SELECT episode, code, CASE code WHEN 'unsafe_path' THEN 'parent segment: ../files/' || episode ELSE 'not in inventory: files/' || episode END AS message
FROM intake WHERE code IS NOT NULL""",
)
def ingest_errors(spark, sf_dir):
    return intake(spark, sf_dir).filter(F.col("code").isNotNull()).select("episode", "code", "message")


@query(
    "ingest_summary",
    "WITH " + INTAKE_SQL + """
SELECT dataset, count(*) FILTER (code IS NULL) AS committed, count(*) FILTER (code IS NOT NULL) AS errors,
  CASE WHEN count(*) FILTER (code IS NULL) = 0 THEN 'error' ELSE 'done' END AS status FROM intake GROUP BY dataset""",
)
def ingest_summary(spark, sf_dir):
    from ..sources.inventory import job_summary

    return job_summary(intake(spark, sf_dir), ["dataset"])
