"""Badges, wording, records, validation, draws and ledger rules on literal rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from episode_audit import fixed_values as fixed
from episode_audit.functions import draws, hashing, records, text, validate
from episode_audit.operators import badges as B
from episode_audit.operators import ledger as G
from episode_audit.operators.reports import verify_files, write_json_report
from episode_audit.operators.scenes import OBJECT_TYPE, draw_scene, scene_digest
from episode_audit.sources.inventory import compare, job_summary, split_errors

CONFIG = {
    "a": {"enabled": True, "blocking": True, "emit_fail": True},
    "b": {"enabled": True, "blocking": False, "emit_fail": False},
    "off": {"enabled": False, "blocking": True, "emit_fail": True},
}
FACTS = "subject int, anchored boolean, signed boolean, key_valid boolean, attestation_level int"


def fold(spark, facts, claims):
    table = spark.createDataFrame(claims, "subject int, check string, result string, issued_at int, seq int")
    latest = B.latest_claims(table, ["seq"])
    return {r.subject: r for r in B.fold_badges(spark.createDataFrame(facts, FACTS), latest, CONFIG).collect()}


def test_badge_table(spark):
    facts = [(i, i != 9, True, True, 2) for i in range(10)]
    facts[1] = (1, True, False, True, 2)
    facts[2] = (2, True, True, False, 2)
    facts[3] = (3, True, True, True, 0)
    claims = [(i, "a", "pass", 1, i) for i in range(10) if i != 4]
    claims += [(5, "b", "fail", 1, 50), (6, "off", "fail", 1, 60), (7, "unknown", "fail", 1, 70), (8, "a", "fail", 2, 80), (8, "a", "pass", 2, 81)]
    got = fold(spark, facts, claims)
    assert got[0].badges == ["L0", "L1", "L2", "L3"]
    assert got[1].badges == ["L0", "L3"] and got[2].badges == ["L0", "L3"] and got[3].badges == ["L0", "L1", "L3"]
    assert got[4].badges == ["L0", "L1", "L2"]
    assert got[5].badges == ["L0", "L1", "L2"] and got[5].failed == ["b"]
    assert got[6].badges == ["L0", "L1", "L2", "L3"] and got[6].failed == []
    assert got[7].badges == ["L0", "L1", "L2", "L3"] and got[7].failed == ["unknown"]
    assert got[8].failed == ["a"]  # equal times: the first logged counts
    assert got[9].pending and got[9].badges == [] and got[9].failed == []


def test_top_badge_without_blocking_checks(spark):
    facts = spark.createDataFrame([(1, True, False, False, 0)], FACTS)
    none = spark.createDataFrame([], "subject int, check string, result string, issued_at int")
    assert B.fold_badges(facts, none, {"b": CONFIG["b"]}).first().badges == ["L0", "L3"]


def test_no_wording_uses_a_forbidden_word(spark):
    lines = [fixed.PENDING_TEXT, fixed.SIGNED_TEXT, fixed.COMMITTED_TEXT, fixed.ATTESTED_TEXT, fixed.DECLARED_SOURCE_TEXT, fixed.ATTESTED_SOURCE_TEXT]
    rows = spark.createDataFrame([(x,) for x in [*lines, "It is proven real and Genuine"]], "t string")
    hits = [r[0] for r in rows.select(text.phrase_hits(F.col("t"), fixed.FORBIDDEN_WORDS)).collect()]
    assert hits[:-1] == [[]] * len(lines) and hits[-1] == ["proven real", "genuine"]


def test_record_round_trip_and_errors(spark):
    layout = fixed.CLAIM_LAYOUT
    assert [records.record_length(x) for _, x in fixed.RECORD_KINDS.values()] == [154, 197, 145, 141]
    h = F.unhex(F.lit("ab" * 32))
    values = {"subject_leaf": h, "verifier_key_id": h, "detail_hash": h, "signature_hash": h, "check_id": F.col("c"), "result": F.col("r"), "level_asserted": F.col("l"), "issued_at": F.col("t")}
    rows = spark.createDataFrame(
        [(2, 1, 3, 1700000000), (0, 1, 3, 5), (2, 3, 3, 5), (2, 1, 5, 5), (2, 1, 3, 0), (70000, 1, 1, 5)], "c bigint, r bigint, l bigint, t bigint"
    ).withColumn("rec", records.encode(layout, values))
    got = rows.select(records.record_problem(F.col("rec")).alias("p"), records.record_kind(F.col("rec")).alias("k"), *(records.field(layout, F.col("rec"), n).alias(n) for n in ("check_id", "result", "level_asserted", "issued_at"))).collect()
    assert (got[0].p, got[0].k, got[0].check_id, got[0].result, got[0].level_asserted, got[0].issued_at) == (None, "claim", 2, 1, 3, 1700000000)
    assert [r.p for r in got[1:]] == ["check id zero", "result out of range", "level out of range", "issue time zero", "empty record"]
    raw = spark.createDataFrame([(bytearray(b""),), (bytearray(b"\x09" + b"x" * 140),), (bytearray(b"\x02" + b"x" * 153),)], "rec binary")
    assert [r[0] for r in raw.select(records.record_problem(F.col("rec"))).collect()] == ["empty record", "unknown version", "wrong length for version"]


def test_whole_64_bit_range(spark):
    rows = spark.createDataFrame([("0",), ("18446744073709551615",), ("9223372036854775808",), ("18446744073709551616",), ("-1",)], "t string")
    packed = rows.withColumn("b", hashing.unsigned_big_endian(F.col("t")))
    got = packed.select("t", "b", hashing.read_unsigned(F.col("b"), 0).alias("n"), hashing.read_big_endian(F.col("b"), 0, 8).alias("signed")).collect()
    assert [None if r.n is None else str(r.n) for r in got] == ["0", "18446744073709551615", "9223372036854775808", None, None]
    assert [r.signed for r in got] == [0, None, None, None, None]
    late = b"\x04" + b"x" * 128 + b"\x00\x02\x01\x03" + b"\xff" * 8
    bad = spark.createDataFrame([(bytearray(late),)], "rec binary").select(records.record_problem(F.col("rec"))).first()[0]
    assert bad == "value out of range"


@pytest.mark.parametrize(
    "path, problem",
    [
        ("data/a.parquet", None), ("", "empty path"), ("/etc/x", "leading slash"), ("a\\b", "backslash"), ("a\x1fb", "separator byte"),
        ("a//b", "empty segment"), ("a/../b", "parent segment"), ("a/..b", None), (".hidden", "first character"), ("éa", "first character"), ("9/x", None),
    ],
)
def test_path_rules(spark, path, problem):
    assert spark.createDataFrame([(path,)], "p string").select(text.path_problem(F.col("p"))).first()[0] == problem


def test_amounts_and_uint64(spark):
    rows = spark.createDataFrame([(0,), (5,), (1500000,), (1000000,), (123456789,)], "n bigint")
    assert [r[0] for r in rows.select(text.amount_text(F.col("n"), 6)).collect()] == ["0", "0.000005", "1.5", "1", "123.456789"]
    words = ["0", "18446744073709551615", "18446744073709551616", "-1", "", "007", "99999999999999999999"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(validate.uint64_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, True, False]


SPEC = {
    "version": 1, "embodiment": "so_arm100", "actionSpace": "ee_pose_gripper", "instruction": "put the mug on the shelf",
    "world": {"base": "kitchen", "objects": [{"category": "mug", "instances": ["a", "b"], "x": [0, 1], "y": [0, 1]}]},
    "success": {"predicate": "on(mug, shelf) and settled(mug)", "toleranceMm": 5, "settleS": 0},
    "acceptance": {"minScoreBps": 8000, "maxDurationS": 60, "targetEpisodes": 100},
}
SPEC_SCHEMA = (
    "version int, embodiment string, actionSpace string, instruction string, "
    f"world struct<base:string,objects:array<{OBJECT_TYPE}>,lightingIntensity:array<double>,lightingTemperatureK:array<double>>, "
    "success struct<predicate:string,toleranceMm:double,settleS:double>, acceptance struct<minScoreBps:int,maxDurationS:double,targetEpisodes:int>"
)


def changed(path, value):
    spec = json.loads(json.dumps(SPEC))
    at = spec
    for step in path[:-1]:
        at = at[step]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return spec


OBJ = ("world", "objects", 0)


def test_task_spec_rules(spark):
    cases = [
        (SPEC, []),
        (changed(("version",), 2), ["unsupported version"]),
        (changed(("embodiment",), None), ["embodiment is required"]),
        (changed(("actionSpace",), "fly"), ["actionSpace is not known"]),
        (changed(("instruction",), " short "), ["instruction must be a sentence"]),
        (changed(("world", "base"), ""), ["world.base is required"]),
        (changed(("world", "objects"), []), ["at least one object is required", "the task has no variation"]),
        (changed((*OBJ, "x"), [1, 0]), ["world.objects[0].x has min above max"]),
        (changed((*OBJ, "y"), [1]), ["world.objects[0].y must be a range"]),
        (changed((*OBJ, "z"), [1]), ["world.objects[0].z must be a range"]),
        (changed((*OBJ, "count"), [-1, 2]), ["world.objects[0].count must be a non-negative range"]),
        (changed((*OBJ, "category"), ""), ["world.objects[0].category is required"]),
        (changed(("success", "predicate"), "likes(mug)"), ["success.predicate uses likes"]),
        (changed(("success", "predicate"), "mug"), ["success.predicate must call a predicate"]),
        (changed(("success", "predicate"), " "), ["success.predicate is required"]),
        (changed(("success", "toleranceMm"), 0), ["success.toleranceMm must be positive"]),
        (changed(("acceptance", "minScoreBps"), 10001), ["acceptance.minScoreBps must be 0 to 10000"]),
        (changed(("acceptance", "targetEpisodes"), 10), ["targetEpisodes reads as a pilot"]),
        ({**changed(("embodiment",), "unitree_g1"), "actionSpace": "joint_position"}, ["joint_position cannot drive this embodiment"]),
    ]
    fixed_scene = changed((*OBJ, "instances"), ["a"])
    fixed_scene["world"]["objects"][0].update({"x": [0, 0], "y": [1, 1]})
    cases.append((fixed_scene, ["the task has no variation"]))
    rows = spark.createDataFrame([(i, json.dumps(s)) for i, (s, _) in enumerate(cases)], "i int, j string")
    got = rows.select("i", validate.task_spec_issues(F.from_json("j", SPEC_SCHEMA)).alias("x")).collect()
    assert {r.i: [m.message for m in r.x] for r in got} == {i: want for i, (_, want) in enumerate(cases)}
    assert {m.severity for r in got if r.i == 17 for m in r.x} == {"warning"}


def plain_unit(identity, seed, i):
    return int.from_bytes(hashlib.sha256(identity + seed.to_bytes(8, "big") + i.to_bytes(4, "big")).digest(), "big") >> 203


def test_scene_draws_in_fixed_order(spark):
    identity = hashlib.sha256(b"task").digest()
    objects = [
        ("mug", ["a", "b", "c"], [0.0, 1.0], [2.0, 4.0], None, [0.0, 6.0], [1.0, 3.0]),
        ("box", ["z"], [5.0, 5.0], [0.0, 1.0], [1.0, 2.0], None, None),
    ]
    rows = spark.createDataFrame(
        [(bytearray(identity), s, objects, [0.5, 1.5], None, "table", "arm") for s in range(5)],
        f"identity binary, seed bigint, objects array<{OBJECT_TYPE}>, intensity array<double>, temperature array<double>, base string, embodiment string",
    )
    for r in draw_scene(rows).withColumn("digest", scene_digest()).collect():
        at = iter(range(100))
        u = lambda: plain_unit(identity, r.seed, next(at)) / 2**53
        want = []
        for category, instances, x, y, z, yaw, count in objects:
            n = 1 if count is None else int(count[0]) + int(u() * (int(count[1]) - int(count[0]) + 1))
            for _ in range(n):
                name = instances[int(u() * len(instances))]
                want.append((category, name, *(0.0 if b is None else b[0] + u() * (b[1] - b[0]) for b in (x, y, z, yaw))))
        assert [tuple(p) for p in r.placed] == want
        assert r.lighting_intensity == 0.5 + u() * 1.0 and r.lighting_temperature == 5000.0
        lines = [f"{c}|{i}|{x:.6f}|{y:.6f}|{z:.6f}|{w:.6f}" for c, i, x, y, z, w in want]
        body = "\n".join(["table", "arm", *lines, f"{r.lighting_intensity:.6f}", "5000.000"])
        assert r.digest == hashlib.sha256(body.encode()).hexdigest()


def test_head_rules(spark):
    heads = spark.createDataFrame(
        [(1, 0, 0, "r", "v"), (2, 0, 5, "a", "v"), (2, 1, 4, "b", "v"), (2, 2, 6, "b", "v"), (2, 3, 6, "c", "v"), (2, 4, 6, "c", "v"), (2, 5, 6, "c", "w"), (2, 6, 9, "d", "w")],
        "ledger int, anchor_idx bigint, size bigint, root string, revocation_root string",
    )
    got = [r.violation for r in G.head_rules(heads, F.shiftright("anchor_idx", 1)).orderBy("ledger", "anchor_idx").collect()]
    assert got == ["size must grow", "", "size must not shrink", "root must change", "root must match at same size", "nothing to anchor", "", ""]
    assert [r.anchor_idx for r in G.change_points(heads, F.shiftright("anchor_idx", 1)).collect()] == [5]


def test_overdue(spark):
    ledgers = spark.createDataFrame([(1, "primary"), (2, "mirror"), (3, "mirror"), (4, "primary")], "ledger int, role string")
    attempts = spark.createDataFrame([(1, 1000, True), (1, 5000, False), (1, 5040, False), (2, 1000, True), (3, 1000, False)], "ledger int, at bigint, ok boolean")
    heads = spark.createDataFrame([(1, "primary", 0, 10, "v", 1000), (2, "mirror", 0, 10, "v", 1000)], "ledger int, role string, anchor_idx int, size bigint, revocation_root string, at bigint")
    state = lambda now, size, rev: {r.ledger: (r.state, r.failures) for r in G.overdue(ledgers, attempts, heads, now, size, F.lit(rev)).collect()}
    assert state(5050, 12, "v") == {1: ("backing off", 2), 2: ("interval not over", 0), 3: ("ahead of primary", 1), 4: ("due", 0)}
    assert state(5200, 12, "v")[1] == ("due", 2)
    assert state(5200, 10, "v")[1] == ("nothing to publish", 2) and state(5200, 10, "w")[1] == ("due", 2)
    assert state(90000, 10, "w")[2] == ("due", 0) and state(90000, 12, "v")[2] == ("ahead of primary", 0)


def test_money_is_conserved(spark):
    fee, share = G.fee_split(F.col("n"))
    rows = spark.createDataFrame([(0,), (39,), (40,), (10**15 + 1,)], "n bigint").select("n", fee.alias("fee"), share.alias("share")).collect()
    assert [(int(r.fee), int(r.share)) for r in rows] == [(n * 250 // 10000, n - n * 250 // 10000) for n in (0, 39, 40, 10**15 + 1)]
    licensed = spark.createDataFrame([(1, 100), (2, 50), (3, 10)], "receipt int, amount bigint")
    paid = spark.createDataFrame([(1, 60), (2, 49)], "receipt int, amount bigint")
    credited = spark.createDataFrame([(1, 40), (3, 10), (4, 1)], "receipt int, amount bigint")
    assert {r.receipt: r.difference for r in G.conservation(licensed, paid, credited).collect()} == {2: 1, 4: -1}


def test_inventories(spark):
    episodes = spark.createDataFrame([(1, "a/x"), (2, "../y"), (3, "a/z")], "episode int, path string")
    checked = split_errors(episodes, spark.createDataFrame([("a/x",), ("a/x",), ("../y",)], "path string"))
    assert {r.episode: r.code for r in checked.collect()} == {1: None, 2: "unsafe_path", 3: "missing_file"}
    assert job_summary(checked.withColumn("j", F.lit(1)), ["j"]).first()[1:] == (1, 2, "done")
    left = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    right = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {r.path: r.status for r in compare(left, right).collect()} == {"b": "differs", "c": "missing right", "d": "missing left"}
    expected = spark.createDataFrame([(1, "a", 1, "1"), (2, "b", 1, "2"), (3, "c", 2, "3"), (4, "q", 1, "4")], "episode int, path string, bytes int, hash string")
    delivered = spark.createDataFrame([("a", 1, "1"), ("b", 1, "x"), ("c", 1, "3")], "path string, bytes int, hash string")
    assert {r.path: r.status for r in verify_files(expected, delivered).collect()} == {"a": "ok", "b": "wrong content", "c": "wrong size", "q": "missing"}


def test_json_report_sink(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1, ["L0"]), ("c2", 2, [])], "corpus string, idx int, badges array<string>")
    write_json_report(rows, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out/corpus=c1").first()[0]) == {"idx": 1, "badges": ["L0"]}


def test_big_endian(spark):
    row = spark.range(1).select(
        hashing.hex_text(hashing.big_endian(F.lit(258), 4)).alias("four"),
        hashing.big_endian(F.lit(256), 1).alias("too_wide"),
        hashing.big_endian(F.lit(-1), 8).alias("negative"),
        draws.integer(F.lit(0.999), F.lit(2.5), F.lit(2.9)).alias("empty_range"),
    ).first()
    assert tuple(row) == ("00000102", None, None, 3)


def test_unknown_keys_at_any_depth(spark):
    shape = {"a": None, "o": {"x": None, "deep": {"y": None}}, "l": [{"p": None, "q": {"z": None}}], "free": "free"}
    cases = {
        '{"a":1,"o":{"x":1,"deep":{"y":2}},"l":[{"p":1},{"q":{"z":0}}],"free":{"anything":1}}': [],
        '{"b":1,"o":{"x":1,"w":2,"deep":{"y":2,"v":3}}}': ["b", "o.deep.v", "o.w"],
        '{"l":[{"p":1},{"r":1},{"q":{"u":0}}]}': ["l[1].r", "l[2].q.u"],
        '{"o":null,"l":[],"free":[1]}': [],
        '{"o":[{"w":1}],"l":{"p":1}}': [],
        "[]": [],
        "no json": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r.t: r.u for r in rows.select("t", F.array_sort(validate.unknown_keys(F.col("t"), shape)).alias("u")).collect()}
    assert got == {**cases, None: []}


def test_corpus_manifest_rules(spark):
    good = ("1", "corpus_manifest", "o", "t", "0x" + "0" * 64, None, None, 3, ["mixed", "sim"], None)
    schema = "v string, kind string, org_id string, title string, terms_hash string, task_id string, corpus_root string, episode_count int, sources array<string>, sealed_at bigint"
    change = lambda i, v: (*good[:i], v, *good[i + 1 :])
    cases = [
        (good, 3, 3, []),
        (change(0, "2"), 3, 3, ["v must be 1"]),
        (change(2, ""), 3, 3, ["org_id is required"]),
        (change(4, "0xAB"), 3, 3, ["invalid terms_hash"]),
        (change(5, "x"), 3, 3, ["invalid task_id"]),
        (change(7, 4), 3, 3, ["episode_count is not the number of episodes"]),
        (change(7, None), 3, 2, ["episodes must be unique"]),
        (change(8, ["sim", "mixed"]), 3, 3, ["sources must be sorted and unique"]),
        (change(8, ["sim", "sim"]), 3, 3, ["sources must be sorted and unique"]),
        (change(8, ["real"]), 3, 3, ["source is not known"]),
        (change(8, None), 3, 3, []),
        (change(9, -1), 3, 3, ["sealed_at must not be negative"]),
    ]
    rows = spark.createDataFrame([(i, m, a, b) for i, (m, a, b, _) in enumerate(cases)], f"i int, m struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>, a int, b int")
    got = {r.i: r.x for r in rows.select("i", validate.corpus_manifest_issues(F.col("m"), F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
