"""Values, whole results and refusals that earlier versions got wrong."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from episode_audit import fixed_values as fixed
from episode_audit.functions import text
from episode_audit.operators import ledger as G
from episode_audit.operators import lookups as L
from episode_audit.operators import merkle as M
from episode_audit.operators import scale
from episode_audit.plans.ingest import IntakeContext, ingest, manifest_hash
from episode_audit.session import checkpoint_folder
from episode_audit.sources import episodes as E
from episode_audit.sources import inventory as I
from test_sources import tree  # noqa: F401 - fixture


def test_result_codes():
    assert fixed.RESULT_CODES == {"fail": 0, "pass": 1, "inconclusive": 2}


@pytest.mark.parametrize(
    ("units", "decimals", "expected"),
    [
        ("1999999999999999999", 18, "1.999999999999999999"),
        ("1", 18, "0.000000000000000001"),
        ("1000000000000000000", 18, "1"),
        ("0", 18, "0"),
        ("120", 0, "120"),
        ("99999999999999999999999999999999999999", 18, "99999999999999999999.999999999999999999"),
        ("-1500000", 6, "-1.5"),
    ],
)
def test_amount_text(spark, units, decimals, expected):
    row = spark.range(1).select(text.amount_text(F.lit(units).cast("decimal(38,0)"), decimals).alias("t")).first()
    assert row.t == expected


def test_fee_split_to_the_last_digit(spark):
    amounts = [0, 1, 39, 40, 9999, 10_000, 10**18 + 39, 10**34, 10**38 - 1]
    rows = spark.createDataFrame([(str(a),) for a in amounts], "n string").select(F.col("n").cast("decimal(38,0)").alias("n"))
    fee, share = G.fee_split(F.col("n"))
    for amount, row in zip(amounts, rows.select("n", fee.alias("fee"), share.alias("share")).collect(), strict=True):
        assert (int(row.fee), int(row.share)) == (amount * 250 // 10_000, amount - amount * 250 // 10_000)


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [
            hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)
        ]
    return hashes[0]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 1500, 5000])
def test_fold_takes_every_hash(spark, n):
    leaves = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.unhex(F.sha2(i.cast("string").cast("binary"), 256)))
    got = bytes(spark.range(1).select(leaves.alias("a")).select(M.fold(F.col("a")).alias("r")).first().r)
    assert got == plain_root([hashlib.sha256(str(i).encode()).digest() for i in range(n)])


def test_a_key_with_two_validity_rows_judges_a_claim_once(spark):
    facts = spark.createDataFrame([("k", 5), ("k", 15), ("k", 25)], "verifier string, at int")
    keys = spark.createDataFrame([("k", 0, 10, False), ("k", 10, 20, True)], "verifier string, valid_from int, valid_to int, is_verifier boolean")
    got = L.valid_at(facts, keys, ["verifier"], "at", ["is_verifier"]).orderBy("at").collect()
    assert [(r.at, r.key_valid, r.is_verifier) for r in got] == [(5, True, False), (15, True, True), (25, False, None)]


def test_any_true_per_dataset(spark):
    rows = spark.createDataFrame([("a", True, None), ("a", False, None), ("b", None, False), ("b", None, True), ("c", None, None)], "d string, success boolean, `next.success` boolean")
    got = {r.d: r.s for r in rows.groupBy("d").agg(E.any_true(rows, ["success", "next.success"]).alias("s")).collect()}
    assert got == {"a": True, "b": True, "c": None}


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    for name, size in (("small", 10), ("large", 5000)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (size // 256) + b"x" * (size % 256))
    monkeypatch.setattr(I, "LARGEST_FILE", 100)
    got = {r.path: r for r in I.scan_files(spark, str(tmp_path)).collect()}
    for name in ("small", "large"):
        data = (tmp_path / name).read_bytes()
        assert (got[name].hash, got[name].bytes, got[name].torn) == (hashlib.sha256(data).hexdigest(), len(data), False)


def test_join_per_key_keeps_rows_of_many_hot_keys(spark):
    facts = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    per_key = facts.groupBy("k").agg(F.count("*").alias("_n"), F.max("id").alias("top"))
    got = scale.join_per_key(facts, per_key, ["k"], F.col("id"), hot_rows=10)
    assert got.count() == 3000 and got.filter(F.col("top") % 7 != F.col("k")).count() == 0
    assert scale.join_per_key(facts.limit(0), per_key.limit(0), ["k"], F.col("id")).count() == 0


def test_manifest_hash_ignores_field_and_map_order(spark):
    one = spark.sql("select named_struct('v', 1, 'rate_hz', 30.0D, 'files', array(named_struct('path', 'p', 'bytes', 3)), 'range', named_struct('frames', array(1, 2), 'video', map('b', 1.5D, 'a', 2D)), 'signature', 'x') m")
    two = spark.sql("select named_struct('signature', 'y', 'rate_hz', 30.0D, 'range', named_struct('video', map('a', 2D, 'b', 1.5D), 'frames', array(1, 2)), 'files', array(named_struct('bytes', 3, 'path', 'p')), 'v', 1) m")
    three = spark.sql("select named_struct('v', 1, 'rate_hz', 30.5D, 'files', array(named_struct('path', 'p', 'bytes', 3)), 'range', named_struct('frames', array(1, 2), 'video', map('b', 1.5D, 'a', 2D)), 'signature', 'x') m")
    got = [bytes(d.select(manifest_hash(F.col("m"), d.schema["m"].dataType).alias("h")).first().h) for d in (one, two, three)]
    expected = '{"files":[{"bytes":3,"path":"p"}],"range":{"frames":[1,2],"video":{"a":2.0,"b":1.5}},"rate_hz":30,"v":1}'
    assert got[0] == got[1] == hashlib.sha256(expected.encode()).digest() and got[2] != got[0]


def test_intake_accounts_for_every_episode(spark, tree):  # noqa: F811
    context = IntakeContext("org", "teleop_real", 100, 200, "0x" + "ab" * 32)
    # episode 0 has no consent, 1 and 2 share a salt
    consents = spark.createDataFrame(
        [(f"{tree}/arm-v3", 1, bytearray(b"r1"), bytearray(b"s")), (f"{tree}/arm-v3", 2, bytearray(b"r2"), bytearray(b"s"))],
        "dataset string, episode_index bigint, record binary, salt binary",
    )
    empty = spark.createDataFrame([], "idx bigint, org_id string, manifest_hash binary")
    appended, errors = ingest(spark, f"{tree}/arm-v3", context, empty, consents)
    assert [r.episode_index for r in appended.collect()] == [1]
    got = sorted((os.path.basename(r.dataset), r.episode_index, r.code) for r in errors.collect())
    assert got == [("arm-v3", 0, "no_consent"), ("arm-v3", 2, "salt_reused"), ("arm-v3", 3, "unreadable")]
    used = spark.createDataFrame([(0, "org", bytearray(b"m"), bytearray(b"s"))], "idx bigint, org_id string, manifest_hash binary, salt binary")
    appended, errors = ingest(spark, f"{tree}/arm-v3", context, used, consents)
    assert appended.count() == 0 and errors.filter("code = 'salt_reused'").count() == 2


def test_a_cluster_must_name_a_checkpoint_folder():
    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Empty()})()})()

    session = type("Session", (), {"conf": type("C", (), {"get": lambda self, key, default=None: None})(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(session)


def test_burst_flags_do_not_depend_on_the_order_of_rows(spark):
    import random

    from episode_audit.streaming.jobs import burst_flags_of

    rng = random.Random(4)
    rows = [(u, float(rng.randrange(400)), 1000 * u + k) for u in range(5) for k in range(60 if u else 600)]
    expected, state = {}, {}
    for u, at, i in sorted(rows):
        tokens, seen = state.get(u, (3.0, at))
        tokens = min(3.0, tokens + (at - seen) / 60 * 3)
        expected[i] = tokens >= 1
        state[u] = (tokens - (1 if tokens >= 1 else 0), at)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "user bigint, at double, event_id bigint").repartition(3)
        got = {r.event_id: r.allowed for r in burst_flags_of(df, "user", 3, 60).collect()}
        assert got == expected


def test_claims_are_worked_out_once_before_they_are_numbered(spark, monkeypatch):
    """Numbering reads its rows several times; they are stored rows, not a plan over the claims."""
    from episode_audit.operators.checks import claim_log as L
    from episode_audit.plans import load_all

    seen, numbered = [], L.numbered
    monkeypatch.setattr(L, "numbered", lambda df, *a, **k: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or numbered(df, *a, **k))
    assert load_all().QUERIES["logged_claims"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Join" not in seen[0]


def test_report_rows_carry_outcomes_instead_of_proofs(spark):
    """What is joined over members and records holds neither proofs nor siblings."""
    from episode_audit.operators import reports as R
    from episode_audit.plans import collections as C

    placed, records, consents = C.report_tables(spark, "/root/testdata/sf0.001")
    places, checked = R.verify_places(placed), R.verify_records(records, consents)
    assert "corpus_proof" not in places.columns and checked.columns == ["idx", "held"]
    assert places.filter("placed").count() == placed.count() and checked.filter("forall(held, x -> x)").count() == checked.count() > 0
