"""A tree grown by batches against one built at once; what an append reads; claims in the log."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from test_merkle import LEAVES, plain_consistency, plain_proof, plain_root

from episode_audit import fixed_values as fixed
from episode_audit.functions import records
from episode_audit.operators import growing_tree as G
from episode_audit.operators import merkle as M
from episode_audit.operators.checks import claim_log as C


def table(spark, first, end, leaves=LEAVES):
    rows = [(i, bytearray(leaves[i])) for i in range(first, end)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "idx bigint, leaf binary")


@pytest.mark.parametrize("sizes", [[0, 1, 2, 3, 4, 5, 9, 16, 17, 33, 70], [70], [64, 65], [7, 7, 20, 70], [63, 64, 70]])
def test_heads_and_nodes_equal_a_tree_built_at_once(spark, tmp_path, sizes):
    tree, before = G.GrowingTree(spark, str(tmp_path / "log"), bits=2), 0
    for size in sizes:
        head = tree.append(table(spark, before, size), f"to-{size}-{before}")
        assert (head.first, head.size) == (before, size)
        assert head.root == (plain_root(LEAVES[:size]) if size else hashlib.sha256(b"").digest())
        before = size
    want = M.complete_nodes(table(spark, 0, before), before, 2).collect()
    assert sorted((r.level, r.idx, bytes(r.hash)) for r in tree.nodes().collect()) == sorted((r.level, r.idx, bytes(r.hash)) for r in want)
    assert {r["size"]: bytes(r.root) for r in tree.roots().collect()}[before] == plain_root(LEAVES[:before])
    for size in {before, max(1, before - 3)}:
        got = {r.idx: [bytes(x) for x in r.proof] for r in tree.proofs(spark.range(before).toDF("idx"), size).collect()}
        assert got == {i: plain_proof(LEAVES[:size], i) for i in range(size)}
    pairs = spark.createDataFrame([(m, before) for m in range(1, before + 1, 5)], "m bigint, n bigint")
    for r in tree.consistency(pairs).collect():
        assert [bytes(x) for x in r.proof] == plain_consistency(LEAVES[: r.n], r.m)


def test_an_append_reads_no_old_node(spark, tmp_path, monkeypatch):
    leaves = spark.range(100_000).select(F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("leaf"))
    tree = G.GrowingTree(spark, str(tmp_path / "log"))
    first = tree.append(leaves.filter("idx < 99000"), "a")
    old = first.run
    # take the nodes of the first batch out of reach: the next append must do without them
    hidden = tmp_path / "log" / "nodes" / old
    hidden.chmod(0)
    made = []
    level_up = G._level_up
    monkeypatch.setattr(G, "_level_up", lambda *a: made.append(level_up(*a)) or made[-1])
    head = tree.append(leaves.filter("idx >= 99000"), "b")
    hidden.chmod(0o755)
    assert head.root == bytes(M.root(leaves, 100_000).first().root) and len(head.frontier) == bin(100_000).count("1")
    new = spark.read.schema(G.NODES).option("recursiveFileLookup", "true").parquet(f"{tree.folder}/nodes/{head.run}").count()
    assert new <= 2 * 1000 + 63
    for df in made:  # what each round reads are files of this batch
        assert df.inputFiles() and all(head.run in f and old not in f for f in df.inputFiles())


def test_repeated_failed_and_wrong_batches(spark, tmp_path):
    tree = G.GrowingTree(spark, str(tmp_path / "log"), bits=2)
    one = tree.append(table(spark, 0, 10), "one")
    assert tree.append(table(spark, 0, 10), "one") == one and tree.heads().count() == 1
    for wrong in (table(spark, 11, 20), table(spark, 9, 20), table(spark, 10, 20).filter("idx <> 15"), table(spark, 10, 20).union(table(spark, 13, 14))):
        with pytest.raises(Exception, match="indices|gap"):
            tree.append(wrong, "two")
    # nodes of the failed runs lie there, but no head names them
    assert tree.nodes().count() == sum(10 >> k for k in range(4))
    assert tree.append(table(spark, 10, 20), "two").root == plain_root(LEAVES[:20])


@pytest.fixture
def outcomes(spark):
    rows = [
        (1, "timing.v1", "timing.v1.0", "fail", "gap exceeds max_gap", "", {"offending_frame": 3.0}),
        (1, "sim_signature.v1", "sim_signature.v1.0", "fail", "", "", {"score": 3.0, "a": 0.5}),
        (2, "timing.v1", "timing.v1.0", "pass", "", "", {}),
        (2, "timing.v1", "timing.v1.0", "pass", "", "", {}),
        (2, "sensor_consistency.v1", "sensor_consistency.v1.0", "inconclusive", "", "fail", None),
        (2, "made_up.v1", "x", "pass", "", "", {}),
        (3, "dedup.v1", "", "pass", "", "", {}),
    ]
    return spark.createDataFrame(rows, "episode bigint, check string, check_version string, result string, reason string, downgraded_from string, findings map<string,double>")


def test_claims_are_complete_and_logged_once(spark, tmp_path, outcomes):
    subject = F.unhex(F.sha2(F.col("episode").cast("string").cast("binary"), 256))
    subjects = outcomes.select("episode").distinct().withColumn("subject", subject)
    claims = C.claims_of(outcomes, subjects, "key-1", 77, fixed.CHECK_SETTINGS, {"timing.v1": {"max_gap_fraction": 6}})
    details = {(r.check, r.result): json.loads(r.detail) for r in claims.collect()}
    assert details["timing.v1", "fail"] == {
        "check_version": "timing.v1.0", "findings": {"offending_frame": 3.0}, "reason": "gap exceeds max_gap",
        "thresholds": {"frame_count_tolerance": 2, "max_gap_fraction": 6, "min_within_tolerance_fraction": 0.99, "period_tolerance_fraction": 0.25},
    }
    held = details["sim_signature.v1", "inconclusive"]
    assert held["downgraded_from"] == "fail" and list(held["findings"]) == ["a", "score"] and held["thresholds"] == {"score_fail": 3, "score_inconclusive": 2}
    assert details["sensor_consistency.v1", "inconclusive"]["downgraded_from"] == "fail"
    problems = sorted((r.check, r.problem) for r in C.refused(claims).collect())
    assert problems == [("dedup.v1", "detail missing check_version"), ("made_up.v1", "unknown check")]

    tree = G.GrowingTree(spark, str(tmp_path / "log"), bits=2)
    tree.append(table(spark, 0, 5), "before")
    none = claims.limit(0)
    rows, head = C.log_claims(claims, none, tree, "run-1")
    rows = sorted(rows.collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == [5, 6, 7, 8] and head.size == 9
    for r in rows:
        assert hashlib.sha256(r.detail.encode()).digest() == bytes(r.detail_hash)
        assert len(r.record) == records.record_length(fixed.CLAIM_LAYOUT) and hashlib.sha256(b"\0" + bytes(r.record)).digest() == bytes(r.leaf)
    assert head.root == plain_root([*LEAVES[:5], *(bytes(r.leaf) for r in rows)])
    decoded = spark.createDataFrame([(bytearray(rows[0].record),)], "record binary").select(
        records.record_problem(F.col("record")).alias("problem"), records.field(fixed.CLAIM_LAYOUT, F.col("record"), "check_id").alias("check_id"),
        records.field(fixed.CLAIM_LAYOUT, F.col("record"), "result").alias("result"), records.field(fixed.CLAIM_LAYOUT, F.col("record"), "issued_at").alias("at"),
    ).first()
    assert (decoded.problem, decoded.check_id, decoded.result, decoded["at"]) == (None, fixed.CHECK_IDS[rows[0].check], fixed.RESULT_CODES[rows[0].result], 77)

    logged = spark.createDataFrame(rows)
    again, same = C.log_claims(claims, none, tree, "run-1")  # the same batch, tried again
    assert same == head and sorted((r.idx, bytes(r.leaf)) for r in again.collect()) == [(r.idx, bytes(r.leaf)) for r in rows]
    more, after = C.log_claims(claims, logged, tree, "run-2")  # nothing new
    assert more.count() == 0 and (after.size, after.root) == (head.size, head.root)


def test_logged_claims_are_stored_without_what_follows_from_them(spark, tmp_path, outcomes):
    subjects = outcomes.select("episode").distinct().withColumn("subject", F.unhex(F.sha2(F.col("episode").cast("string").cast("binary"), 256)))
    claims = C.claims_of(outcomes, subjects, "key-1", 77, fixed.CHECK_SETTINGS)
    rows, _ = C.log_claims(claims, claims.limit(0), G.GrowingTree(spark, str(tmp_path / "log"), bits=2), "run-1", F.hex("subject"))
    files = rows.inputFiles()
    assert files and not {"record", "leaf"} & set(spark.read.parquet(*files).columns)
    assert rows.columns == [*C.IDENTITY, "issued_at", "detail", "record", "leaf", "idx"]
    for r in rows.collect():
        assert hashlib.sha256(bytes(r.subject).hex().upper().encode()).digest() in bytes(r.record)
        assert hashlib.sha256(b"\0" + bytes(r.record)).digest() == bytes(r.leaf)
