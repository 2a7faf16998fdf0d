"""Join jobs over the record, claim, key and inventory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import hashing as H
from ..functions import records
from ..operators import lookups as L
from ..operators.row_series import numbered
from ..operators.scale import positions
from ..sources.inventory import compare
from . import proxies as P
from .claims import MEMBERS_SQL, members
from .record_rows import CONSENT_SQL, RECORDS_SQL, consent_records, stored_records
from .registry import query


@query(
    "corpus_members",
    "WITH " + MEMBERS_SQL + """
SELECT corpus, idx, CASE WHEN o_orderkey IS NULL THEN 'not logged' ELSE '' END AS error, CAST(epoch(o_orderdate) AS BIGINT) AS received_at
FROM members LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON idx = o_orderkey""",
)
def corpus_members(spark, sf_dir):
    logged = (
        P.table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") != "P")
        .select(F.col("o_orderkey").alias("idx"), P.seconds("o_orderdate").alias("received_at"))
    )
    return (
        members(spark, sf_dir)
        .join(logged, "idx", "left")
        .select("corpus", "idx", F.when(F.col("received_at").isNull(), "not logged").otherwise("").alias("error"), "received_at")
    )


def revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")


def document_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id")


@query(
    "revoked_members",
    "SELECT source AS corpus, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def revoked_members(spark, sf_dir):
    return document_members(spark, sf_dir).join(revoked(spark, sf_dir), "doc_id", "left_semi").select("corpus", "doc_id")


@query(
    "live_members",
    "SELECT source AS corpus, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def live_members(spark, sf_dir):
    return document_members(spark, sf_dir).join(revoked(spark, sf_dir), "doc_id", "left_anti").select("corpus", "doc_id")


@query(
    "corpus_contains_revoked",
    """SELECT source AS corpus, count(*) AS members, count(*) FILTER (l.doc_id IS NOT NULL) AS revoked,
  count(*) FILTER (l.doc_id IS NOT NULL) > 0 AS contains_revoked
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id GROUP BY source""",
)
def corpus_contains_revoked(spark, sf_dir):
    flags = revoked(spark, sf_dir).withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False))
    return (
        document_members(spark, sf_dir)
        .join(flags, "doc_id", "left")
        .groupBy("corpus")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if(hit).alias("revoked"), F.bool_or(hit).alias("contains_revoked"))
    )


@query(
    "first_anchor",
    "WITH " + P.ANCHORS_SQL + """
SELECT o_orderkey AS idx, size, anchor_idx FROM orders ASOF JOIN anchors ON o_orderkey < size""",
)
def first_anchor(spark, sf_dir):
    leaves = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return L.first_covering_anchor(leaves, P.anchor_sizes(spark, sf_dir), ["size", "anchor_idx"])


KEYS_SQL = f"""
keys AS (
  SELECT s_suppkey AS verifier, 788918400 + s_suppkey * {P.DAY_S} AS valid_from,
         CASE WHEN s_suppkey % 4 <> 0 THEN 788918400 + (s_suppkey + 1000) * {P.DAY_S} END AS valid_to,
         s_nationkey % 2 = 0 AS is_verifier FROM supplier)"""


def signing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(788918400) + F.col("s_suppkey") * P.DAY_S
    return P.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("verifier"),
        start.alias("valid_from"),
        F.when(F.col("s_suppkey") % 4 != 0, start + 1000 * P.DAY_S).alias("valid_to"),
        (F.col("s_nationkey") % 2 == 0).alias("is_verifier"),
    )


@query(
    "key_valid_at",
    "WITH " + P.CLAIMS_SQL + ", " + KEYS_SQL + """
SELECT subject, "check" AS check_name, c.verifier, issued_at,
  coalesce(issued_at >= valid_from AND (valid_to IS NULL OR issued_at < valid_to), false) AS key_valid
FROM claims c LEFT JOIN keys k ON c.verifier = k.verifier""",
)
def key_valid_at(spark, sf_dir):
    facts = P.claims(spark, sf_dir).select("subject", F.col("check").alias("check_name"), "verifier", "issued_at")
    return L.valid_at(facts, signing_keys(spark, sf_dir), ["verifier"], "issued_at")


@query(
    "claim_admission",
    "WITH " + P.CLAIMS_SQL + ", " + KEYS_SQL + """
SELECT subject, "check" AS check_name, c.verifier, issued_at,
  CASE WHEN "check" NOT IN ('check_1','check_2','check_3','check_4','check_5','check_6') THEN 'unknown check'
       WHEN k.verifier IS NULL OR issued_at < valid_from OR issued_at >= coalesce(valid_to, issued_at + 1) THEN 'key not valid'
       WHEN NOT is_verifier THEN 'not a verifier' ELSE 'admitted' END AS outcome
FROM claims c LEFT JOIN keys k ON c.verifier = k.verifier""",
)
def claim_admission(spark, sf_dir):
    facts = P.claims(spark, sf_dir).select("subject", F.col("check").alias("check_name"), "verifier", "issued_at")
    keys = signing_keys(spark, sf_dir)
    judged = L.valid_at(facts, keys, ["verifier"], "issued_at", ["is_verifier"])
    reason = L.first_failing(
        (~F.col("check_name").isin(*P.CHECKS[:6]), "unknown check"),
        (~F.col("key_valid"), "key not valid"),
        (~F.coalesce("is_verifier", F.lit(False)), "not a verifier"),
    )
    return judged.select("subject", "check_name", "verifier", "issued_at", F.coalesce(reason, F.lit("admitted")).alias("outcome"))


@query(
    "exact_duplicates",
    """WITH d AS (SELECT doc_id, lang, sha256(encode(text)) AS hash FROM documents)
SELECT doc_id, lang, first_doc_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, hash) AS first_doc_id FROM d) WHERE doc_id > first_doc_id""",
)
def exact_duplicates(spark, sf_dir):
    """Same organisation and same content: every later row names the first one."""
    rows = P.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(H.utf8(F.col("text")), 256).alias("hash"))
    return L.repeats(rows, ["lang", "hash"], "doc_id").select("doc_id", "lang", "first_doc_id")


@query(
    "salt_reuse",
    "WITH " + CONSENT_SQL + """
SELECT c_custkey, first_c_custkey FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY salt) AS first_c_custkey FROM consent)
WHERE c_custkey > first_c_custkey""",
)
def salt_reuse(spark, sf_dir):
    rows = consent_records(spark, sf_dir).select("c_custkey", "salt")
    return L.repeats(rows, ["salt"], "c_custkey").select("c_custkey", "first_c_custkey")


@query(
    "sealed_match",
    """SELECT s.o_orderkey AS sealed_id, l.o_orderkey AS idx FROM
 (SELECT o_orderkey, upper(sha256(encode('m-' || o_orderkey // 2))) AS hash FROM orders WHERE o_orderkey % 3 = 0) s JOIN
 (SELECT o_orderkey, sha256(encode('m-' || o_orderkey)) AS hash FROM orders) l ON lower(s.hash) = lower(l.hash)""",
)
def sealed_match(spark, sf_dir):
    """Sealed rows matched to local ones by manifest hash, letter case ignored."""
    orders = P.table(spark, sf_dir, "orders").select("o_orderkey")
    name = lambda c: F.sha2(H.utf8(F.concat(F.lit("m-"), c.cast("string"))), 256)
    sealed = orders.filter(F.col("o_orderkey") % 3 == 0).select(
        F.col("o_orderkey").alias("sealed_id"), F.upper(name(F.floor(F.col("o_orderkey") / 2))).alias("hash")
    )
    local = orders.select(F.col("o_orderkey").alias("idx"), name(F.col("o_orderkey")).alias("hash"))
    return sealed.withColumn("hash", F.lower("hash")).join(local.withColumn("hash", F.lower("hash")), "hash").select("sealed_id", "idx")


@query(
    "facts_mismatch",
    "WITH " + RECORDS_SQL + """
SELECT idx, CASE WHEN cust % 10 = 1 THEN 0 WHEN cust % 10 = 2 THEN 1 WHEN cust % 10 = 3 THEN 2 WHEN cust % 10 = 4 THEN 3 END AS field
FROM recs WHERE problem IS NULL AND kind = 3 AND cust % 10 BETWEEN 1 AND 4""",
)
def facts_mismatch(spark, sf_dir):
    """Sealing parameters against the logged record: number of the first difference."""
    record, layout = F.col("record"), fixed.CORPUS_LAYOUT
    rows = stored_records(spark, sf_dir).withColumn("kind", records.record_kind(record)).filter(F.col("kind") == "corpus")
    logged = rows.select(
        "idx", *(records.field(layout, record, n).alias(n) for n in ("corpus_manifest_hash", "corpus_root", "terms_hash", "episode_count"))
    )
    other = F.col("consent")
    params = rows.select(
        "idx",
        F.when(F.col("cust") % 10 == 1, other).otherwise(F.col("manifest")).alias("p0"),
        F.when(F.col("cust") % 10 == 2, other).otherwise(F.col("payload")).alias("p1"),
        F.when(F.col("cust") % 10 == 3, other).otherwise(F.col("terms")).alias("p2"),
        F.when(F.col("cust") % 10 == 4, -1).otherwise(F.col("cust") % 9).alias("p3"),
    )
    names = ("corpus_manifest_hash", "corpus_root", "terms_hash", "episode_count")
    field = L.first_difference([(F.col(f"p{i}"), F.col(n)) for i, n in enumerate(names)])
    return params.join(logged, "idx").select("idx", field.alias("field")).filter(F.col("field").isNotNull())


@query(
    "delivery_list",
    """WITH f AS (SELECT DISTINCT o_orderkey AS receipt, o_custkey AS buyer, l_partkey AS file FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT receipt, buyer, count(*) AS files, count(*) FILTER (p_partkey IS NULL) AS missing, count(*) FILTER (p_partkey IS NULL) = 0 AS deliverable
FROM f LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON file = p_partkey GROUP BY receipt, buyer""",
)
def delivery_list(spark, sf_dir):
    """Receipt to files; a receipt is deliverable when every file is stored."""
    receipts = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("buyer"))
    files = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt"), F.col("l_partkey").alias("file")).distinct()
    stored = P.table(spark, sf_dir, "part").filter(F.col("p_size") > 5).select(F.col("p_partkey").alias("file"), F.lit(True).alias("stored"))
    missing = F.count_if(F.col("stored").isNull())
    return (
        receipts.join(files, "receipt")
        .join(stored, "file", "left")
        .groupBy("receipt", "buyer")
        .agg(F.count(F.lit(1)).alias("files"), missing.alias("missing"), (missing == 0).alias("deliverable"))
    )


@query(
    "missing_uploads",
    """SELECT d.doc_id, d.lang AS org FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR d.lang = 'fr'""",
)
def missing_uploads(spark, sf_dir):
    """Files named by an organisation that it has not stored itself."""
    wanted = P.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("org"))
    labels = P.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "stored").otherwise("pending").alias("status"))
    # uploads of the organisation "fr" were made under another name
    uploads = labels.join(wanted, "doc_id").select("doc_id", F.when(F.col("org") == "fr", "other").otherwise(F.col("org")).alias("org"), "status")
    return wanted.join(uploads.filter(F.col("status") == "stored"), ["doc_id", "org"], "left_anti")


@query(
    "inventory_diff",
    """WITH l AS (SELECT 'item/' || doc_id AS path, sha256(encode(text)) AS hash FROM documents WHERE doc_id % 50 <> 0 AND doc_id % 4 <> 1),
r AS (SELECT 'item/' || item_id AS path, sha256(encode(CASE WHEN item_id % 3 = 0 THEN d.text ELSE b.text END)) AS hash
      FROM benchmark b JOIN documents d ON item_id = doc_id WHERE item_id % 50 <> 0)
SELECT path, CASE WHEN l.hash IS NULL THEN 'missing left' WHEN r.hash IS NULL THEN 'missing right' ELSE 'differs' END AS status
FROM l FULL JOIN r USING (path) WHERE l.hash IS DISTINCT FROM r.hash""",
)
def inventory_diff(spark, sf_dir):
    """Two file sets compared by path and hash; exempt paths are skipped."""
    documents = P.table(spark, sf_dir, "documents")
    path = lambda c: F.concat(F.lit("item/"), F.col(c).cast("string")).alias("path")
    left = documents.filter((F.col("doc_id") % 50 != 0) & (F.col("doc_id") % 4 != 1)).select(
        path("doc_id"), F.sha2(H.utf8(F.col("text")), 256).alias("hash")
    )
    items = P.table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 != 0).withColumnRenamed("text", "item_text")
    right = items.join(documents.select("doc_id", "text"), F.col("item_id") == F.col("doc_id")).select(
        path("item_id"), F.sha2(H.utf8(F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.col("item_text"))), 256).alias("hash")
    )
    return compare(left, right)


# ------------------------------------------------------- order and paging


@query(
    "append_index",
    """WITH base AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS record, n + row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
  n + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS log_size_after
FROM orders, base WHERE o_orderstatus <> 'F'""",
)
def append_index(spark, sf_dir):
    """Dense log indices for a batch of new records, in arrival order."""
    orders = P.table(spark, sf_dir, "orders")
    size = orders.filter(F.col("o_orderstatus") == "F").count()
    fresh = orders.filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("record"), P.seconds("o_orderdate").alias("at"))
    ranked = numbered(fresh, [], ["at", "record"])
    return ranked.select("record", (F.col("pos") + size).alias("idx"), (F.col("pos") + size + 1).alias("log_size_after"))


@query(
    "corpus_index",
    "WITH " + MEMBERS_SQL + " SELECT corpus, idx, row_number() OVER (PARTITION BY corpus ORDER BY idx) - 1 AS corpus_index FROM members",
)
def corpus_index(spark, sf_dir):
    return positions(members(spark, sf_dir), ["corpus"], ["idx"], P.index_chunk(), name="corpus_index")


@query(
    "keyset_page",
    "WITH " + P.LEAVES_SQL + f""",
page AS (SELECT idx, lower(hex(leaf)) AS leaf, row_number() OVER (ORDER BY idx) AS rn, count(*) OVER () AS n FROM
  (SELECT * FROM leaves WHERE idx > 999 ORDER BY idx LIMIT {fixed.PAGE_DEFAULT + 1}))
SELECT idx, leaf, CASE WHEN n > {fixed.PAGE_DEFAULT} THEN {999 + fixed.PAGE_DEFAULT} END AS next_cursor FROM page WHERE rn <= {fixed.PAGE_DEFAULT}""",
)
def keyset_page(spark, sf_dir):
    """The page after a cursor; one extra row tells whether there is a next page."""
    page = keyset(P.leaves(spark, sf_dir), "idx", 999)
    return page.select("idx", H.hex_text(F.col("leaf")).alias("leaf"), "next_cursor")


def keyset(rows: DataFrame, key: str, cursor: int | None, limit: int = fixed.PAGE_DEFAULT) -> DataFrame:
    from pyspark.sql import Window

    limit = max(1, min(limit, fixed.PAGE_MAX))
    after = rows if cursor is None else rows.filter(F.col(key) > cursor)
    # at most PAGE_MAX + 1 rows from here on
    window = Window.partitionBy(F.lit(0))
    page = after.orderBy(key).limit(limit + 1)
    page = page.select(
        "*", F.count(F.lit(1)).over(window).alias("_n"), F.row_number().over(window.orderBy(key)).alias("_rn"),
    )
    last = F.max(F.when(F.col("_rn") == limit, F.col(key))).over(window)
    return page.withColumn("next_cursor", F.when(F.col("_n") > limit, last)).filter(F.col("_rn") <= limit).drop("_n", "_rn")
