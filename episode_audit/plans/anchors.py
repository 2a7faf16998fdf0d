"""Heads over time: rules, audit, divergence, lag, confirmation, consent onset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import hashing as H
from ..operators import ledger as G
from ..operators import merkle as M
from ..operators.scale import nearest_mark
from . import proxies as P
from .registry import query

HEAD_EVERY = 50


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head after every 50th record on three ledgers, some with planted faults."""
    i = F.floor(F.col("o_orderkey") / HEAD_EVERY).cast("bigint")
    base = P.table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % HEAD_EVERY == HEAD_EVERY - 1).select(
        i.alias("i"), P.seconds("o_orderdate").alias("day"), (F.col("o_custkey") % 5).alias("c")
    )
    ledgers = F.array(*(F.struct(F.lit(n).cast("bigint").alias("ledger"), F.lit(r).alias("role"), F.lit(step).alias("step")) for n, r, step in ((1, "primary", 1), (2, "mirror", 2), (3, "mirror", 3))))
    rows = base.select("*", F.explode(ledgers).alias("l")).select("*", "l.*").filter(F.col("i") % F.col("step") == 0)
    size = F.when(F.col("i") % 11 == 7, (F.col("i") - 3) * HEAD_EVERY).when(F.col("i") % 11 == 5, F.col("i") * HEAD_EVERY).otherwise((F.col("i") + 1) * HEAD_EVERY)
    named = rows.withColumn("size", size)
    fork = (F.col("ledger") == 3) & (F.col("i") % 6 == 0)
    root = F.concat(F.lit("root-"), F.when(F.col("i") % 13 == 4, F.col("i") * HEAD_EVERY).otherwise(F.col("size")).cast("string"), F.when(fork, "-fork").otherwise(""))
    return named.select(
        "ledger", "role", F.col("i").alias("anchor_idx"), "size", root.alias("root"),
        F.concat(F.lit("rev-"), F.col("c").cast("string")).alias("revocation_root"), (F.col("i") * 1800 + F.col("ledger")).alias("at"),
    )


HEADS_SQL = f"""
heads AS (
  SELECT ledger::BIGINT AS ledger, role, i AS anchor_idx, size, 'root-' || CASE WHEN i % 13 = 4 THEN i * {HEAD_EVERY} ELSE size END ||
    CASE WHEN ledger = 3 AND i % 6 = 0 THEN '-fork' ELSE '' END AS root, 'rev-' || c AS revocation_root, i * 1800 + ledger AS "at"
  FROM (SELECT *, CASE WHEN i % 11 = 7 THEN (i - 3) * {HEAD_EVERY} WHEN i % 11 = 5 THEN i * {HEAD_EVERY} ELSE (i + 1) * {HEAD_EVERY} END AS size
        FROM (SELECT o_orderkey // {HEAD_EVERY} AS i, o_custkey % 5 AS c FROM orders WHERE o_orderkey % {HEAD_EVERY} = {HEAD_EVERY - 1}) b,
             (VALUES (1, 'primary', 1), (2, 'mirror', 2), (3, 'mirror', 3)) l(ledger, role, step) WHERE i % step = 0))"""


def _head_chunk():
    return F.shiftright("anchor_idx", 8)


@query(
    "anchor_rules",
    "WITH " + HEADS_SQL + """,
p AS (SELECT *, lag(size) OVER w AS ps, lag(root) OVER w AS pr, lag(revocation_root) OVER w AS pv FROM heads WINDOW w AS (PARTITION BY ledger ORDER BY anchor_idx))
SELECT ledger, anchor_idx, CASE WHEN ps IS NULL THEN CASE WHEN size = 0 THEN 'size must grow' ELSE '' END WHEN size < ps THEN 'size must not shrink'
  WHEN size > ps AND root = pr THEN 'root must change' WHEN size = ps AND root <> pr THEN 'root must match at same size'
  WHEN size = ps AND revocation_root = pv THEN 'nothing to anchor' ELSE '' END AS violation FROM p""",
)
def anchor_rules(spark, sf_dir):
    return G.head_rules(heads(spark, sf_dir), _head_chunk()).select("ledger", "anchor_idx", "violation")


@query(
    "revocation_changes",
    "WITH " + HEADS_SQL + """,
p AS (SELECT *, lag(revocation_root) OVER (PARTITION BY ledger ORDER BY anchor_idx) AS pv FROM heads)
SELECT ledger, anchor_idx, revocation_root FROM p WHERE pv IS NOT NULL AND pv <> revocation_root""",
)
def revocation_changes(spark, sf_dir):
    return G.change_points(heads(spark, sf_dir), _head_chunk()).select("ledger", "anchor_idx", "revocation_root")


@query(
    "anchor_divergence",
    "WITH " + HEADS_SQL + """,
ref AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY size ORDER BY role <> 'primary', ledger, anchor_idx) = 1)
SELECT h.ledger, h.anchor_idx, h.size, h.root, r.ledger AS reference_ledger, r.root AS reference_root FROM heads h JOIN ref r ON h.size = r.size WHERE h.root <> r.root""",
)
def anchor_divergence(spark, sf_dir):
    return G.divergence(heads(spark, sf_dir)).select("ledger", "anchor_idx", "size", "root", "reference_ledger", "reference_root")


@query("first_index_of_root", "WITH " + HEADS_SQL + " SELECT ledger, root, min(anchor_idx) AS first_idx FROM heads GROUP BY 1, 2")
def first_index_of_root(spark, sf_dir):
    return heads(spark, sf_dir).groupBy("ledger", "root").agg(F.min("anchor_idx").alias("first_idx"))


@query(
    "recent_anchors",
    "WITH " + HEADS_SQL + f" SELECT anchor_idx, size, root FROM heads WHERE ledger = 1 ORDER BY anchor_idx DESC LIMIT {fixed.RECENT_ANCHORS}",
)
def recent_anchors(spark, sf_dir):
    rows = heads(spark, sf_dir).filter(F.col("ledger") == 1)
    return rows.orderBy(F.col("anchor_idx").desc()).limit(fixed.RECENT_ANCHORS).select("anchor_idx", "size", "root")


@query(
    "log_status",
    "WITH " + HEADS_SQL + """
SELECT ledger, count(*) AS heads, max(anchor_idx) AS latest, max_by(size, anchor_idx) AS last_size, max_by(root, anchor_idx) AS last_root,
  (SELECT count(*) FROM orders) AS log_size FROM heads GROUP BY ledger""",
)
def log_status(spark, sf_dir):
    size = P.table(spark, sf_dir, "orders").count()
    return heads(spark, sf_dir).groupBy("ledger").agg(
        F.count(F.lit(1)).alias("heads"), F.max("anchor_idx").alias("latest"), F.max_by("size", "anchor_idx").alias("last_size"),
        F.max_by("root", "anchor_idx").alias("last_root"), F.lit(size).cast("bigint").alias("log_size"),
    )


@query(
    "anchor_lag",
    "WITH " + HEADS_SQL + """,
clock AS (SELECT max("at") + 7000 AS now FROM heads)
SELECT ledger, role, max_by(size, anchor_idx) AS last_size, now - max("at") AS lag_s, CASE role WHEN 'primary' THEN 7200 ELSE 172800 END::BIGINT AS limit_s,
  now - max("at") > CASE role WHEN 'primary' THEN 7200 ELSE 172800 END AS alarm FROM heads, clock GROUP BY ledger, role, now""",
)
def anchor_lag(spark, sf_dir):
    rows = heads(spark, sf_dir)
    now = rows.agg(F.max("at")).first()[0] + 7000
    return G.lag_alarm(rows, now)


@query(
    "anchor_audit",
    "WITH " + P.ANCHORS_SQL + """,
held AS (SELECT count(*) AS n FROM orders)
SELECT anchor_idx, size + CASE WHEN anchor_idx % 5 = 4 THEN n ELSE 0 END AS size,
  CASE WHEN anchor_idx % 5 = 4 THEN 'unverifiable' WHEN anchor_idx % 7 = 3 THEN 'mismatch' ELSE 'coherent' END AS status FROM anchors, held""",
)
def anchor_audit(spark, sf_dir):
    """Every published head against the root rebuilt from the held records."""
    leaves = P.leaves(spark, sf_dir)
    held = leaves.count()
    nodes = M.complete_nodes(leaves, held)
    sizes = P.anchor_sizes(spark, sf_dir)
    rebuilt = M.prefix_roots(nodes, sizes)
    idx = F.col("anchor_idx")
    # what the ledger is said to carry: some heads altered, some larger than the log
    published = sizes.join(rebuilt, "size").select(
        "anchor_idx", (F.col("size") + F.when(idx % 5 == 4, held).otherwise(0)).alias("size"),
        F.when(idx % 7 == 3, H.digest(F.col("root"))).otherwise(F.col("root")).alias("root"),
    )
    return audit(published, rebuilt, held)


def audit(published: DataFrame, rebuilt: DataFrame, held: int) -> DataFrame:
    own = rebuilt.select("size", F.col("root").alias("own_root"))
    status = (
        F.when(F.col("size") > held, "unverifiable").when(F.col("own_root") == F.col("root"), "coherent").otherwise("mismatch")
    )
    return published.join(own, "size", "left").select("anchor_idx", "size", status.alias("status"))


@query(
    "anchor_confirmation",
    "WITH " + HEADS_SQL + """
SELECT ledger, anchor_idx, CASE WHEN anchor_idx % 9 = 2 THEN 'unreachable' WHEN anchor_idx % 9 = 5 THEN 'differs' ELSE 'confirmed' END AS status FROM heads""",
)
def anchor_confirmation(spark, sf_dir):
    """Recorded heads against a snapshot read from the ledgers."""
    rows = heads(spark, sf_dir)
    remote = rows.filter(F.col("anchor_idx") % 9 != 2).select(
        "ledger", "anchor_idx", F.col("root").alias("remote_root"),
        (F.col("size") + F.when(F.col("anchor_idx") % 9 == 5, 1).otherwise(0)).alias("remote_size"),
    )
    status = (
        F.when(F.col("remote_root").isNull(), "unreachable")
        .when((F.col("root") == F.col("remote_root")) & (F.col("size") == F.col("remote_size")), "confirmed")
        .otherwise("differs")
    )
    return rows.join(remote, ["ledger", "anchor_idx"], "left").select("ledger", "anchor_idx", status.alias("status"))


@query("anchor_due")
def anchor_due(spark, sf_dir):
    """Which ledgers need a new head now."""
    rows = heads(spark, sf_dir)
    now = rows.agg(F.max("at")).first()[0] + 200
    size = P.table(spark, sf_dir, "orders").count()
    attempts = rows.select("ledger", "at", (F.col("anchor_idx") % 7 != 0).alias("ok"))
    ledgers = rows.select("ledger", "role").distinct()
    return G.overdue(ledgers, attempts, rows, now, size, F.lit("rev-new"))


# ------------------------------------------------------------------ onset

DOC_HEADS_SQL = """
doc_heads AS (SELECT doc_id // 100 AS anchor_idx, doc_id + 1 AS size, (doc_id + 1) * 60 AS "at" FROM documents WHERE doc_id % 100 = 99)"""


def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 100 == 99).select(
        F.floor(F.col("doc_id") / 100).cast("bigint").alias("anchor_idx"), (F.col("doc_id") + 1).alias("size"), ((F.col("doc_id") + 1) * 60).alias("at")
    )


def received_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id", (F.col("doc_id") * 60 + 17).alias("received_at"))


@query(
    "revocation_onset",
    "WITH " + DOC_HEADS_SQL + """
SELECT doc_id, received_at, anchor_idx AS onset FROM (SELECT doc_id, doc_id * 60 + 17 AS received_at FROM labels WHERE toxic = 1) r
ASOF LEFT JOIN doc_heads h ON r.received_at <= h."at\"""",
)
def revocation_onset(spark, sf_dir):
    """The first head published after each revocation came in, key by key."""
    marks = document_heads(spark, sf_dir).withColumnRenamed("anchor_idx", "onset")
    return nearest_mark(received_revocations(spark, sf_dir), marks, [], F.col("received_at"), F.col("at"), ["onset"], 100_000)


@query(
    "consent_status",
    "WITH " + DOC_HEADS_SQL + """,
asked AS (SELECT doc_id, (doc_id * 7 % (SELECT max(doc_id) + 1 FROM documents) // 100) AS anchor_idx, doc_id % 31 = 5 AS bad FROM documents),
onset AS (SELECT doc_id, received_at, anchor_idx AS onset FROM (SELECT doc_id, doc_id * 60 + 17 AS received_at FROM labels WHERE toxic = 1) r
  ASOF LEFT JOIN doc_heads h ON r.received_at <= h."at")
SELECT a.doc_id, a.anchor_idx, CASE WHEN h.anchor_idx IS NULL OR bad THEN 'unknown anchor' WHEN o.received_at <= h."at" THEN 'revoked' ELSE 'live' END AS status,
  CASE WHEN h.anchor_idx IS NOT NULL AND NOT bad AND o.received_at <= h."at" THEN onset END AS onset
FROM asked a LEFT JOIN doc_heads h ON a.anchor_idx = h.anchor_idx LEFT JOIN onset o ON a.doc_id = o.doc_id""",
)
def consent_status(spark, sf_dir):
    """Was the consent live at a given head; a head that was never published is an error."""
    documents = P.table(spark, sf_dir, "documents").select("doc_id")
    count = documents.agg(F.max("doc_id") + 1).first()[0]
    published = document_heads(spark, sf_dir)
    asked = documents.select(
        "doc_id", F.floor(F.col("doc_id") * 7 % count / 100).cast("bigint").alias("anchor_idx"), (F.col("doc_id") % 31 == 5).alias("bad")
    )
    asked = asked.withColumn("asked_size", (F.col("anchor_idx") + 1) * 100 + F.when(F.col("bad"), 1).otherwise(0))
    known = published.select(F.col("anchor_idx"), F.col("size").alias("asked_size"), "at")
    onset = nearest_mark(
        received_revocations(spark, sf_dir), published.withColumnRenamed("anchor_idx", "onset"), [], F.col("received_at"), F.col("at"), ["onset"], 100_000
    )
    joined = asked.join(known, ["anchor_idx", "asked_size"], "left").join(onset, "doc_id", "left")
    revoked = F.coalesce(F.col("received_at") <= F.col("at"), F.lit(False))
    return joined.select(
        "doc_id", "anchor_idx",
        F.when(F.col("at").isNull(), "unknown anchor").when(revoked, "revoked").otherwise("live").alias("status"),
        F.when(revoked, F.col("onset")).alias("onset"),
    )
