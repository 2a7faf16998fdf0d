"""Streams run to the end of their files and compared with the batch result."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from episode_audit import fixed_values as fixed
from episode_audit.operators import events as V
from episode_audit.operators.checks.issue import IDENTITY
from episode_audit.operators.checks.run import CheckInput, run_checks
from episode_audit.streaming import jobs as J
from episode_audit.streaming.key_store import KeyStore

BASE = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def table_of(spark, query_name):
    return spark.sql(f"select * from {query_name}").collect()


def memory(df, name, mode="append"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def store_of(spark, path, schema, key, **kwargs):
    return KeyStore(spark, path, spark.createDataFrame([], schema).schema, key, **kwargs)


def test_append_once(spark, tmp_path):
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    schema = "hash string, at timestamp, n int"
    store = store_of(spark, out, schema, ["hash"])
    put(spark, src, [("a", BASE, 1), ("b", BASE, 2), ("a", BASE, 3)], schema)
    put(spark, src, [("b", BASE, 4), ("c", BASE, 5)], schema)
    finish(J.append_once(stream(spark, src, schema), ["hash"], "at", "1 hour", store, ckpt))
    # a repeat far behind the watermark is caught by what was written
    put(spark, src, [("a", BASE + dt.timedelta(days=9), 6), ("d", BASE + dt.timedelta(days=9), 7)], schema)
    finish(J.append_once(stream(spark, src, schema), ["hash"], "at", "1 hour", store, ckpt))
    assert sorted(r.hash for r in store.rows().collect()) == ["a", "b", "c", "d"]
    # a stream that starts anew sees everything again and keeps what is there
    kept = sorted(map(tuple, store.rows().collect()))
    put(spark, src, [("e", BASE, 8)], schema)
    finish(J.append_once(stream(spark, src, schema), ["hash"], "at", "1 hour", store, f"{ckpt}-new"))
    now = sorted(map(tuple, store.rows().collect()))
    assert now == sorted([*kept, ("e", BASE, 8)]) and store.commits().select("run").distinct().count() == 2


def test_a_batch_reads_the_keys_of_its_buckets_only(spark, tmp_path, monkeypatch):
    schema = "key bigint, v string"
    store = store_of(spark, f"{tmp_path}/store", schema, ["key"], buckets=16)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], schema)
    assert store.append(rows(range(1000), "old"), "r", 0) == 1000
    assert store.append(rows(range(1000, 1400), "old"), "r", 1) == 400
    read = []
    known = KeyStore.known_keys
    monkeypatch.setattr(KeyStore, "known_keys", lambda self, buckets: read.append((buckets, known(self, buckets))) or read[-1][1])
    assert store.append(rows([5, 1001, 2000], "new"), "r", 2) == 1
    (buckets, df), = read
    files = df.inputFiles()
    assert 1 <= len(buckets) <= 3 and 0 < len(files) <= 2 * len(buckets) and {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= set(buckets)
    assert not any("/rows/" in f for f in files)
    # the same batch again, even with other rows: committed already
    assert store.append(rows([7777], "again"), "r", 2) == 1 and store.rows().filter("key = 7777").count() == 0
    # rows and keys of a batch that failed before its commit are not seen, and it can be tried again
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    batch = spark.range(9000, 9010).selectExpr("id AS key", "'x' AS v")
    try:
        store.append(batch, "r", 3)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert store.rows().filter("key >= 9000").count() == 0
    assert store.append(batch, "r", 3) == 10 and store.rows().count() == 1411
    assert store.append(batch.limit(0), "r", 4) == 0 and store.rows().count() == 1411


def test_requests_equal_batch(spark, tmp_path):
    random.seed(1)
    schema = "key string, at double, id bigint, body string"
    rows, at = [], 1e6
    for i in range(300):
        at += random.choice([0.0, 1.0, 700.0])
        rows.append((random.choice("pq"), at, i, random.choice("xy")))
    src = f"{tmp_path}/src"
    for part in range(3):
        put(spark, src, rows[part * 100 : part * 100 + 100], schema)
    batch = V.classify_repeats(spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("bigint")), ["key"], "body", 3600)
    expected = {r.id: r.outcome for r in batch.collect()}
    opened, slow = {}, {}
    for key, at, i, body in rows:
        if key not in opened or at >= opened[key][0] + 3600:
            opened[key] = (at, body)
            slow[i] = "new"
        else:
            slow[i] = "replay" if opened[key][1] == body else "conflict"
    assert expected == slow
    # three files in any order: rows wait until the watermark has passed them
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        shuffled = f"{tmp_path}/s{order[0]}"
        live = in_any_order(spark, shuffled, [rows[p * 100 : p * 100 + 100] for p in order], schema)
        finish(memory(J.classify_requests(live, "20 days", 3600), f"requests{order[0]}"))
        got = {r.id: r.outcome for r in table_of(spark, f"requests{order[0]}")}
        assert got == slow


FAR = 400 * 86400.0


def in_any_order(spark, path, batches, schema):
    """A stream of these files, one a batch, and a last row that moves the watermark past all of them."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
        time.sleep(1.1)  # files are read in the order of their time
    last = {"key string": ("zz", FAR, -1, "x"), "user bigint": (-1, FAR, -1)}[schema.split(",")[0]]
    spark.createDataFrame([last], schema).coalesce(1).write.parquet(f"{path}/{len(batches)}")
    live = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return live.withColumn("time", F.timestamp_seconds("at"))


def test_bursts(spark, tmp_path):
    schema = "user bigint, at double, id bigint"
    t = 1e6
    rows = [(1, t, i) for i in range(5)] + [(1, t + 20, 5), (1, t + 20, 6), (1, t + 100, 7)] + [(2, t + 5, 8)]
    want = {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True}
    for turn, batches in enumerate(([rows[5:], rows[:2], rows[2:5]], [rows[:4], rows[4:]])):
        live = in_any_order(spark, f"{tmp_path}/{turn}", batches, schema)
        finish(memory(J.flag_bursts(live, "user", "1 hour", capacity=3, refill_s=60), f"bursts{turn}"))
        assert {r.id: r.allowed for r in table_of(spark, f"bursts{turn}")} == want
    batch = J.burst_flags_of(spark.createDataFrame(rows, "user bigint, at double, event_id bigint"), "user", 3, 60)
    assert {r.event_id: r.allowed for r in batch.collect()} == want


def test_a_hot_user_runs_in_many_tasks(spark):
    rng = random.Random(3)
    at, rows = 0.0, []
    for i in range(3000):
        at += rng.choice([1.0, 2.0, 90.0])
        rows.append((1, at, i))
    df = spark.createDataFrame(rows, "user bigint, at double, event_id bigint").repartition(5)
    out = J.burst_flags_of(df, "user", 3, 60)
    tokens, seen, want = 3.0, None, {}
    for _, at, i in rows:
        tokens = 3.0 if seen is None else min(3.0, tokens + (at - seen) / 60 * 3)
        want[i], seen = tokens >= 1, at
        tokens -= 1 if tokens >= 1 else 0
    assert {r.event_id: r.allowed for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins tasks of so few rows
    try:
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_revocations_first_write_wins(spark, tmp_path):
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    schema = "key string, value string, at bigint"
    put(spark, src, [("a", "v1", 5), ("a", "v0", 3), ("b", "w", 1)], schema)
    store = store_of(spark, out, schema, ["key"])
    finish(J.first_write_wins(stream(spark, src, schema), ["at"], store, ckpt))
    put(spark, src, [("a", "late", 1), ("c", "z", 9)], schema)
    finish(J.first_write_wins(stream(spark, src, schema), ["at"], store, ckpt))
    got = {r.key: r.value for r in store.rows().collect()}
    assert got == {"a": "v0", "b": "w", "c": "z"}
    records = spark.createDataFrame([("a",), ("x",)], "key string")
    status = J.revocation_status(records, store)
    assert {r.key: r.status for r in status.collect()} == {"a": "revoked", "x": "live"}


def test_queue_issues_each_claim_once(spark, tmp_path):
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    schema = "episode bigint, frames int"

    def check(batch):
        return batch.select(
            F.col("episode").alias("subject"), F.lit("timing.v1").alias("check"), F.lit("k").alias("verifier"),
            F.when(F.col("frames") > 0, "pass").otherwise("fail").alias("result"), F.lit("").alias("downgraded_from"),
            F.lit("{}").alias("detail"), F.lit(7).cast("bigint").alias("issued_at"),
        )

    put(spark, src, [(1, 5), (2, 0), (1, 6)], schema)
    claims = check(spark.createDataFrame([], schema)).schema
    store = KeyStore(spark, out, claims, IDENTITY)
    finish(J.verify_queue(stream(spark, src, schema), check, store, ckpt))
    put(spark, src, [(2, 0), (2, 4), (3, 1)], schema)
    finish(J.verify_queue(stream(spark, src, schema), check, store, ckpt))
    got = sorted((r.subject, r.result) for r in store.rows().collect())
    assert got == [(1, "pass"), (2, "fail"), (2, "pass"), (3, "pass")]


def test_live_checks_equal_the_batch(spark, tmp_path):
    """The real checks on episodes that the watermark has closed, against the same checks over all frames at once."""
    rng = random.Random(6)
    src, schema = f"{tmp_path}/src", "episode bigint, time timestamp, frame_index bigint, state array<double>"
    frames = []
    for e in range(6):
        s = e * 40.0
        for i in range(30):
            s += 0.1 if e % 2 else rng.choice([0.05, 0.1, 0.2])
            frames.append((e, BASE + dt.timedelta(seconds=s), i, [rng.random(), 5.0 if e == 3 and i == 20 else rng.random()]))
    closing = [(99, BASE + dt.timedelta(days=1), 0, [0.0, 0.0])]
    rng.shuffle(frames)
    for part in (frames[:70], frames[70:], closing):
        put(spark, src, part, schema)

    def prepare(rows):
        rows = rows.withColumn("ts", F.unix_micros("time") / 1e6).withColumn("action", F.lit(None).cast("array<double>"))
        limits = F.array(*(F.array(F.lit(-1.0), F.lit(2.0)) for _ in range(2)))
        episodes = rows.groupBy("episode").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).select(
            "episode", F.col("episode").alias("idx"), ((F.col("n") - 1) / (F.col("b") - F.col("a"))).alias("rate_hz"),
            ((F.col("b") - F.col("a")) * 1000).alias("duration_ms"), F.lit("arm").alias("embodiment"), limits.alias("joint_limits"),
            F.array(F.lit(1e9), F.lit(1e9)).alias("max_vel"), F.lit("teleop_real").alias("source"),
        )
        motion = spark.createDataFrame([(e, k, float(k % 3)) for e in range(6) for k in range(10)], "episode bigint, k bigint, energy double")
        return CheckInput(rows.drop("time"), episodes, motion, ["frame_index"], rows=16)

    config = {k: v for k, v in fixed.CHECK_SETTINGS.items() if k != "dedup.v1"}  # compares with every episode logged before
    landed = lambda: spark.read.schema(schema).parquet(src)
    out = "episode bigint, check string, result string, reason string"
    store = store_of(spark, f"{tmp_path}/claims", out, ["episode", "check"])
    finish(J.live_checks(stream(spark, src, schema), landed, prepare, config, "time", "5 seconds", "600 seconds", store, f"{tmp_path}/ckpt"))
    want = run_checks(prepare(landed().filter("episode < 99")), config).select("episode", "check", "result", "reason")
    got = sorted(map(tuple, store.rows().collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 24
    assert (3, "kinematics.v1", "fail", "observation.state joint out of range") in got and len({r[2] for r in got}) == 3


def test_lag_alarm(spark, tmp_path):
    src, schema = f"{tmp_path}/src", "ledger bigint, role string, at double"
    now = dt.datetime.now().timestamp()
    put(spark, src, [(1, "primary", now - 9000), (1, "primary", now - 8000), (2, "mirror", now - 8000)], schema)
    # a job with timeouts always has another batch to run: take exactly one
    alarms = J.lag_alarms(stream(spark, src, schema))
    finish(alarms.writeStream.format("memory").queryName("alarms").outputMode("append").trigger(once=True).start())
    got = {r.ledger: r.alarm for r in table_of(spark, "alarms")}
    assert got == {1: True, 2: False}


def test_windows_on_a_stream_equal_batch(spark, tmp_path):
    random.seed(2)
    src, schema = f"{tmp_path}/src", "ts timestamp, kind string"
    rows = sorted((BASE + dt.timedelta(seconds=random.randrange(3000)), random.choice("ab")) for _ in range(200))
    put(spark, src, rows, schema)
    batch = V.window_rates(spark.createDataFrame(rows, schema), "ts", "kind", "5 minutes", "1 minute")
    live = V.window_rates(stream(spark, src, schema).withWatermark("ts", "10 minutes"), "ts", "kind", "5 minutes", "1 minute")
    finish(memory(live, "rates", "complete"))
    assert sorted(map(tuple, table_of(spark, "rates"))) == sorted(map(tuple, batch.collect()))


def test_sessions_and_late_frames(spark, tmp_path):
    src, schema = f"{tmp_path}/src", "ts timestamp, episode bigint"
    at = lambda s: BASE + dt.timedelta(seconds=s)
    put(spark, src, [(at(s), 1) for s in (0, 5, 9, 40, 45)] + [(at(600), 2)], schema)
    finish(memory(J.live_sessions(stream(spark, src, schema), "ts", "episode", "10 seconds", "20 seconds"), "live"))
    got = {(r.episode, int((r.first - BASE).total_seconds()), r.events) for r in table_of(spark, "live")}
    assert got == {(1, 0, 3), (1, 40, 2)}  # episode 2 is still open
    late, out = f"{tmp_path}/late", f"{tmp_path}/side"
    put(spark, late, [(at(7), 1), (at(601), 2)], schema)
    closed = spark.table("live").select("episode", "last")
    finish(J.split_late(stream(spark, late, schema), "ts", closed, "episode", out, f"{tmp_path}/ckpt"))
    assert [r.episode for r in spark.read.parquet(out).collect()] == [1]
    batch = V.sessions(
        spark.createDataFrame([(1, s, i) for i, s in enumerate((0, 5, 9, 40, 45))] + [(2, 600, 9)], "episode bigint, at bigint, id bigint"), ["episode"], 10, 7
    )
    assert {(r.episode, r.start, r.events) for r in batch.collect()} == {(1, 0, 3), (1, 40, 2), (2, 600, 1)}
