"""Tree digests, proofs and fingerprints over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import merkle as M
from ..operators import sparse as S
from ..operators.growing_tree import GrowingTree
from ..operators.scale import positions
from ..session import checkpoint_folder
from . import proxies as P
from .claims import MEMBERS_SQL, members
from .registry import query

LEVELS = 20  # levels of the SQL trees; more than enough entries for the test tables


def tree_sql(source: str = "leaves", prefix: str = "t", group: str = "", levels: int = LEVELS) -> str:
    """CTEs t0..tN: one per level, an odd last entry moving up unchanged."""
    g, by = (f"{group}, ", f"{group}, ") if group else ("", "")
    out = [f"{prefix}0 AS MATERIALIZED (SELECT {g}idx, leaf AS h FROM {source})"]
    for k in range(1, levels + 1):
        out.append(
            f"{prefix}{k} AS MATERIALIZED (SELECT {g}idx // 2 AS idx, CASE WHEN count(*) = 2 THEN unhex(sha256('\\x01'::BLOB || "
            f"any_value(h) FILTER (idx % 2 = 0) || any_value(h) FILTER (idx % 2 = 1))) ELSE any_value(h) END AS h "
            f"FROM {prefix}{k - 1} GROUP BY {by}idx // 2)"
        )
    return ",\n".join(out)


def nodes_sql(source: str = "leaves", prefix: str = "n", levels: int = LEVELS) -> str:
    """CTEs of complete subtrees only, and their union `nodes`."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT idx, leaf AS h FROM {source})"]
    for k in range(1, levels + 1):
        out.append(
            f"{prefix}{k} AS MATERIALIZED (SELECT idx // 2 AS idx, unhex(sha256('\\x01'::BLOB || any_value(h) FILTER (idx % 2 = 0) || "
            f"any_value(h) FILTER (idx % 2 = 1))) AS h FROM {prefix}{k - 1} GROUP BY idx // 2 HAVING count(*) = 2)"
        )
    union = " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, idx, h FROM {prefix}{k}" for k in range(levels + 1))
    out.append(f"nodes AS MATERIALIZED ({union})")
    return ",\n".join(out)


@query("merkle_root", "WITH " + P.DOC_LEAVES_SQL + ", " + tree_sql() + f" SELECT lower(hex(h)) AS root FROM t{LEVELS}")
def merkle_root(spark, sf_dir):
    leaves = P.document_leaves(spark, sf_dir)
    return M.root(leaves, leaves.count()).select(H.hex_text(F.col("root")).alias("root"))


@query("merkle_nodes", "WITH " + P.DOC_LEAVES_SQL + ", " + nodes_sql() + " SELECT level, idx, lower(hex(h)) AS hash FROM nodes")
def merkle_nodes(spark, sf_dir):
    leaves = P.document_leaves(spark, sf_dir)
    return M.complete_nodes(leaves, leaves.count()).select(F.col("level").cast("bigint").alias("level"), "idx", H.hex_text(F.col("hash")).alias("hash"))


PREFIX_SQL = """
parts AS (
  SELECT size, b AS level, (size >> (b + 1)) << 1 AS idx FROM sizes, range(0, 40) t(b) WHERE (size >> b) & 1 = 1),
prefix AS (
  SELECT size, list_reduce(list(h ORDER BY p.level), lambda acc, x: unhex(sha256('\\x01'::BLOB || x || acc))) AS root
  FROM parts p JOIN nodes n ON p.level = n.level AND p.idx = n.idx GROUP BY size)"""
ORDER_PREFIX_SQL = P.LEAVES_SQL + ", " + P.ANCHORS_SQL + ", " + nodes_sql() + ", sizes AS (SELECT size FROM anchors), " + PREFIX_SQL


def anchor_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = P.leaves(spark, sf_dir)
    nodes = M.complete_nodes(leaves, leaves.count())
    return M.prefix_roots(nodes, P.anchor_sizes(spark, sf_dir))


@query("prefix_roots", "WITH " + ORDER_PREFIX_SQL + " SELECT size, lower(hex(root)) AS root FROM prefix")
def prefix_roots(spark, sf_dir):
    return anchor_roots(spark, sf_dir).select("size", H.hex_text(F.col("root")).alias("root"))


def _siblings_sql(levels: int = LEVELS) -> str:
    union = " UNION ALL ".join(f"SELECT {k} AS level, idx, h FROM t{k}" for k in range(levels))
    return f"""
alls AS MATERIALIZED ({union}),
proofs AS (
  SELECT l.idx, string_agg(lower(hex(a.h)), ',' ORDER BY a.level) AS proof, count(a.h) AS steps
  FROM leaves l LEFT JOIN alls a ON a.idx = xor(l.idx >> a.level, 1) GROUP BY l.idx)"""


@query(
    "inclusion_proofs",
    "WITH " + P.DOC_LEAVES_SQL + ", " + tree_sql() + ", " + _siblings_sql() + " SELECT idx, proof, steps FROM proofs",
)
def inclusion_proofs(spark, sf_dir):
    leaves = P.document_leaves(spark, sf_dir)
    proofs = M.inclusion_proofs(leaves, leaves.count())
    return proofs.select(
        "idx", F.array_join(F.transform("proof", H.hex_text), ",").alias("proof"), F.size("proof").cast("bigint").alias("steps")
    )


@query(
    "verify_inclusion",
    "SELECT doc_id AS idx, doc_id % 10 <> 3 AND doc_id % 10 <> 4 AS ok FROM documents",
)
def verify_inclusion(spark, sf_dir):
    """Every proof folded against the root; some are damaged on purpose."""
    leaves = P.document_leaves(spark, sf_dir)
    size = leaves.count()
    tree = M.root(leaves, size)
    proofs = M.inclusion_proofs(leaves, size)
    idx = F.col("idx")
    damaged = (
        F.when(idx % 10 == 3, F.transform("proof", lambda p, i: F.when(i == 0, F.col("leaf")).otherwise(p)))
        .when(idx % 10 == 4, F.slice("proof", 1, F.size("proof") - 1))
        .otherwise(F.col("proof"))
    )
    computed = proofs.select("idx", M.inclusion_root(F.col("leaf"), idx, F.lit(size), damaged).alias("computed"))
    # one row on the right, so an equality on the digest itself is the comparison
    matched = computed.join(F.broadcast(tree.withColumn("ok", F.lit(True))), computed.computed == tree.root, "left")
    return matched.select("idx", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("consistency")
def consistency(spark, sf_dir):
    """Proof that each head extends the one before it, and its check."""
    leaves = P.leaves(spark, sf_dir)
    nodes = M.complete_nodes(leaves, leaves.count())
    sizes = P.anchor_sizes(spark, sf_dir)
    roots = M.prefix_roots(nodes, sizes)
    following = sizes.select((F.col("anchor_idx") - 1).alias("anchor_idx"), F.col("size").alias("n"))
    pairs = sizes.withColumnRenamed("size", "m").join(following, "anchor_idx").select("m", "n")
    proofs = (
        M.consistency_proofs(nodes, pairs)
        .join(roots.select(F.col("size").alias("m"), F.col("root").alias("old")), "m")
        .join(roots.select(F.col("size").alias("n"), F.col("root").alias("new")), "n")
    )
    ok = M.verify_consistency(F.col("m"), F.col("n"), F.col("proof"), F.col("old"), F.col("new"))
    return proofs.select("m", "n", F.size("proof").cast("bigint").alias("steps"), ok.alias("ok"))


GROWTH = 5  # batches in which the log is appended


@query(
    "log_growth",
    "WITH " + P.LEAVES_SQL + ", " + nodes_sql() + f""",
total AS (SELECT count(*) AS n FROM leaves),
sizes AS (SELECT DISTINCT CAST(floor(n * (b + 1) / {GROWTH}) AS BIGINT) AS size FROM total, range(0, {GROWTH}) t(b)), """ + PREFIX_SQL + """,
ends AS (SELECT size, coalesce(lag(size) OVER (ORDER BY size), 0) AS first FROM sizes)
SELECT size, lower(hex(root)) AS root,
  (SELECT sum((size >> level::INT) - (first >> level::INT)) FROM range(0, 40) t(level))::BIGINT AS new_nodes FROM ends JOIN prefix USING (size)""",
)
def log_growth(spark, sf_dir):
    """The log appended in batches: head and new nodes of each, no old node being read."""
    leaves = P.leaves(spark, sf_dir).select("idx", "leaf")
    total = leaves.count()
    tree = GrowingTree(spark, f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}")
    before = 0
    for batch in range(GROWTH):
        size = total * (batch + 1) // GROWTH
        tree.append(leaves.filter((F.col("idx") >= before) & (F.col("idx") < size)), str(batch))
        before = size
    level = F.sequence(F.lit(0), F.lit(39))
    made = F.aggregate(level, F.lit(0).cast("bigint"), lambda acc, b: acc + F.floor(F.col("size") / F.pow(F.lit(2.0), b)) - F.floor(F.col("first") / F.pow(F.lit(2.0), b)))
    return tree.heads().filter("size > first").select("size", H.hex_text(F.col("root")).alias("root"), made.alias("new_nodes"))


@query(
    "stored_proofs",
    "WITH " + P.LEAVES_SQL + ", " + tree_sql() + ", " + _siblings_sql() + " SELECT p.idx, proof, steps FROM proofs p WHERE p.idx % 20 = 0",
)
def stored_proofs(spark, sf_dir):
    """Proofs of every twentieth record against the head of a log appended twice, from stored nodes."""
    leaves = P.leaves(spark, sf_dir).select("idx", "leaf")
    total = leaves.count()
    tree = GrowingTree(spark, f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}")
    tree.append(leaves.filter(F.col("idx") < total // 3), "first")
    tree.append(leaves.filter(F.col("idx") >= total // 3), "second")
    proofs = tree.proofs(leaves.filter(F.col("idx") % 20 == 0).select("idx"), total)
    return proofs.select(
        "idx", F.array_join(F.transform("proof", H.hex_text), ",").alias("proof"), F.size("proof").cast("bigint").alias("steps")
    )


FILES_SQL = """
files AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
    unhex(sha256('\\x00'::BLOB || encode(source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) || '\\x1F'::BLOB || unhex(sha256(encode(text))))) AS leaf
  FROM documents)"""


def file_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File leaves per source; zero-padded names make path order equal id order."""
    path = F.format_string("%s/%012d", "source", "doc_id")
    rows = P.table(spark, sf_dir, "documents").select(
        "source", "doc_id", H.file_leaf(path, H.digest(H.utf8(F.col("text")))).alias("leaf")
    )
    return positions(rows, ["source"], ["doc_id"], P.index_chunk("doc_id"), name="idx")


@query(
    "payload_fingerprint",
    "WITH " + FILES_SQL + ", " + tree_sql("files", group="source") + f" SELECT source, lower(hex(h)) AS fingerprint FROM t{LEVELS}",
)
def payload_fingerprint(spark, sf_dir):
    leaves = file_leaves(spark, sf_dir)
    count = P.table(spark, sf_dir, "documents").count()
    return M.root(leaves, count, ["source"]).select("source", H.hex_text(F.col("root")).alias("fingerprint"))


CORPUS_LEAVES_SQL = MEMBERS_SQL + ", " + P.LEAVES_SQL + """,
corpus_leaves AS (
  SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY m.idx) - 1 AS idx, leaf
  FROM members m JOIN leaves l ON m.idx = l.idx)"""


def corpus_leaves(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """Members of each collection in log order with their leaves and positions."""
    chosen = members(spark, sf_dir) if chosen is None else chosen
    rows = chosen.join(P.leaves(spark, sf_dir).select("idx", "leaf"), "idx").select("corpus", F.col("idx").alias("log_index"), "leaf")
    return positions(rows, ["corpus"], ["log_index"], P.index_chunk("log_index"), name="idx")


@query(
    "corpus_root",
    "WITH " + CORPUS_LEAVES_SQL + ", " + tree_sql("corpus_leaves", group="corpus") + f""",
sizes AS (SELECT corpus, count(*) AS episodes FROM corpus_leaves GROUP BY corpus)
SELECT corpus, episodes, lower(hex(h)) AS root FROM t{LEVELS} JOIN sizes USING (corpus)""",
)
def corpus_root(spark, sf_dir):
    leaves = corpus_leaves(spark, sf_dir)
    largest = P.table(spark, sf_dir, "orders").count()  # a collection holds each record once
    return M.root(leaves, largest, ["corpus"], count="episodes").select("corpus", "episodes", H.hex_text(F.col("root")).alias("root"))


# ------------------------------------------------------------- revocations


def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value) of every revoked document's consent."""
    record = H.digest(H.utf8(F.concat(F.lit("consent-"), F.col("doc_id").cast("string"))))
    return (
        P.table(spark, sf_dir, "labels")
        .filter(F.col("toxic") == 1)
        .select("doc_id", record.alias("record"))
        .select("doc_id", H.consent_key(F.col("record")).alias("key"), H.revocation_value(F.col("record")).alias("value"))
    )


REVOCATION_TREE_SQL = """
revs AS (SELECT doc_id, unhex(sha256(encode('consent-' || doc_id))) AS record FROM labels WHERE toxic = 1),
entries AS (SELECT doc_id, unhex(sha256('\\x02'::BLOB || record)) AS key, unhex(sha256(record || encode('revoked'))) AS value FROM revs),
climb(level, path, h) AS (
  SELECT 0, CAST(CAST(key AS BIT) AS VARCHAR), value FROM entries
  UNION ALL
  SELECT level + 1, substr(path, 1, 255 - level),
         unhex(sha256(coalesce(any_value(h) FILTER (substr(path, 256 - level, 1) = '0'), unhex(repeat('00', 32))) ||
                      coalesce(any_value(h) FILTER (substr(path, 256 - level, 1) = '1'), unhex(repeat('00', 32)))))
  FROM climb WHERE level < 256 GROUP BY level, substr(path, 1, 255 - level))"""


@query(
    "revocation_root",
    "WITH RECURSIVE " + REVOCATION_TREE_SQL + """
SELECT (SELECT count(*) FROM entries) AS revoked, lower(hex(h)) AS root FROM climb WHERE level = 256""",
)
def revocation_root(spark, sf_dir):
    entries = revocations(spark, sf_dir)
    count = entries.count()
    return S.root(entries, count).select(F.lit(count).cast("bigint").alias("revoked"), H.hex_text(F.col("root")).alias("root"))


@query(
    "revocation_proofs",
    "SELECT d.doc_id, l.doc_id IS NOT NULL AS revoked, true AS ok FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id",
)
def revocation_proofs(spark, sf_dir):
    """Membership or non-membership of every document's consent, proved and checked."""
    entries = revocations(spark, sf_dir)
    count = entries.count()
    record = H.digest(H.utf8(F.concat(F.lit("consent-"), F.col("doc_id").cast("string"))))
    probes = P.table(spark, sf_dir, "documents").select("doc_id", H.consent_key(record).alias("key"))
    proofs = S.proofs(entries, probes, max(count, P.table(spark, sf_dir, "documents").count()))
    known = entries.select("key", "value")
    joined = probes.join(proofs, "key").join(known, "key", "left")
    value = F.coalesce("value", F.unhex(F.lit("00" * 32)))
    rooted = joined.select("doc_id", F.col("value").isNotNull().alias("revoked"), S.proof_root("key", value, "bitmap", "siblings").alias("computed"))
    tree = F.broadcast(S.root(entries, count).withColumn("ok", F.lit(True)))
    return rooted.join(tree, rooted.computed == tree.root, "left").select("doc_id", "revoked", F.coalesce("ok", F.lit(False)).alias("ok"))
