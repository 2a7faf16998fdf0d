"""Both dataset layouts, error isolation and the intake job on a small tree."""

import hashlib
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episode_audit.plans.ingest import IntakeContext, ingest
from episode_audit.sources import episodes as E
from episode_audit.sources import inventory as I

CAMERA = "observation.images.front"
LENGTHS = [6, 5, 7]


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def table(path, columns):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(pa.table(columns), path)


def features():
    return {
        "observation.state": {"dtype": "float32", "shape": [3], "names": None},
        "action": {"dtype": "float32", "shape": [3]},
        CAMERA: {"dtype": "video", "shape": [4, 4, 3]},
        "timestamp": {"dtype": "float32", "shape": [1]},
    }


def frame_columns(episodes, start):
    rows = [(e, f) for e in episodes for f in range(LENGTHS[e])]
    return {
        "episode_index": pa.array([e for e, _ in rows], pa.int32()),
        "frame_index": pa.array([f for _, f in rows], pa.int32()),
        "index": pa.array([start + i for i in range(len(rows))], pa.int32()),
        "timestamp": pa.array([f / 30 for _, f in rows], pa.float64()),
        "observation.state": pa.array([[e + f * 0.1] * 3 for e, f in rows], pa.list_(pa.float32())),
        "action": pa.array([[-e - f * 0.1] * 3 for e, f in rows], pa.list_(pa.float32())),
        "next.success": pa.array([f == LENGTHS[e] - 1 and e != 1 for e, f in rows], pa.bool_()),
    }


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sets"))
    v3, v2 = f"{root}/arm-v3", f"{root}/arm-v2"
    put(f"{v3}/meta/info.json", json.dumps({"codebase_version": "v3.0", "robot_type": "so_arm100", "fps": 30, "features": features()}).encode())
    # two data files: the second one starts at a global index above zero
    table(f"{v3}/data/chunk-000/file-000.parquet", frame_columns([0, 1], 0))
    table(f"{v3}/data/chunk-000/file-001.parquet", frame_columns([2], 11))
    put(f"{v3}/videos/{CAMERA}/chunk-000/file-000.mp4", b"video bytes")
    table(
        f"{v3}/meta/episodes/chunk-000/file-000.parquet",
        {
            "episode_index": [2, 0, 1, 3], "length": [7, 6, 5, 4], "dataset_from_index": [11, 0, 6, 18], "dataset_to_index": [18, 6, 11, 22],
            "data/chunk_index": [0, 0, 0, 0], "data/file_index": [1, 0, 0, 9], f"videos/{CAMERA}/chunk_index": [0, 0, 0, 0],
            f"videos/{CAMERA}/file_index": [0, 0, 0, 0], f"videos/{CAMERA}/from_timestamp": [0.4, 0.0, 0.2, 0.6],
            f"videos/{CAMERA}/to_timestamp": [0.6, 0.2, 0.4, 0.7], "tasks": [["stack", "sort"], ["fold the towel"], [], ["x"]],
        },
    )
    put(f"{v2}/meta/info.json", json.dumps({"codebase_version": "v2.1", "robot_type": "so_arm100", "features": {"action": {"dtype": "float32", "shape": [3]}}}).encode())
    put(f"{v2}/meta/episodes.jsonl", b'{"episode_index": 0, "length": 6, "tasks": ["wave"]}\n\n{"episode_index": 1, "length": 5}\n')
    for e in (0, 1):
        columns = frame_columns([e], 0)
        del columns["next.success"]
        table(f"{v2}/data/chunk-000/episode_{e:06d}.parquet", columns)
    return root


def test_info(spark, tree):
    info = {os.path.basename(r.dataset): r for r in E.read_info(spark, f"{tree}/*").collect()}
    v3, v2 = info["arm-v3"], info["arm-v2"]
    assert (v3.layout, v3.rate_hz, v3.embodiment, v3.cameras) == ("chunked", 30.0, "so_arm100", [CAMERA])
    assert [c.name for c in v3.channels] == ["action", CAMERA, "observation.state", "timestamp"]
    assert {c.name: c.dtype for c in v3.channels}[CAMERA] == "video/mp4"
    assert (v2.layout, v2.rate_hz, v2.channels[0].hz) == ("per_episode", 0.0, None)
    with open(f"{tree}/arm-v3/meta/info.json", "rb") as f:
        assert v3.info_hash == hashlib.sha256(f.read()).hexdigest()


def test_read_both_layouts(spark, tree):
    good, errors = E.read_dataset(spark, f"{tree}/*")
    rows = {(os.path.basename(r.dataset), r.episode_index): r for r in good.collect()}
    assert sorted(rows) == [("arm-v2", 0), ("arm-v2", 1), ("arm-v3", 0), ("arm-v3", 1), ("arm-v3", 2)]
    e = rows["arm-v3", 2]
    assert [f.path for f in e.files] == ["data/chunk-000/file-001.parquet", f"videos/{CAMERA}/chunk-000/file-000.mp4"]
    assert e.range.frames == [11, 18] and e.range.video == {CAMERA: [0.4, 0.6]}
    assert (e.frames, e.duration_ms, e.instruction, e.success) == (7, 233, "stack; sort", True)
    assert rows["arm-v3", 1].success is False and rows["arm-v3", 1].instruction is None
    assert rows["arm-v2", 0].range is None and rows["arm-v2", 0].duration_ms == 0 and rows["arm-v2", 0].success is None
    bad = errors.collect()
    assert [(os.path.basename(r.dataset), r.episode_index, r.message) for r in bad] == [("arm-v3", 3, "missing file: data/chunk-000/file-009.parquet")]


def test_frames_follow_episode_not_offset(spark, tree):
    frames = E.read_frames(spark, f"{tree}/arm-v3", ["timestamp", "observation.state"])
    assert frames.columns == ["dataset", "episode_index", "frame_index", "timestamp", "observation.state"]
    got = {r.episode_index: (r.n, round(r.v, 3)) for r in frames.groupBy("episode_index").agg(F.count("*").alias("n"), F.max(F.col("`observation.state`")[0]).alias("v")).collect()}
    assert got == {0: (6, 0.5), 1: (5, 1.4), 2: (7, 2.6)}


def test_template_and_inventory(spark, tree):
    row = spark.range(1).select(
        E.fill(F.lit("a/{episode_index:06d}/{k}/{missing}"), {"episode_index": F.lit(1234567), "k": F.lit("x")}).alias("long"),
        E.fill(F.lit(E.EPISODE_DATA), {"episode_chunk": F.lit(0), "episode_index": F.lit(7)}).alias("usual"),
    ).first()
    assert row.long == "a/1234567/x/{missing}" and row.usual == "data/chunk-000/episode_000007.parquet"
    files = {r.path: r for r in I.scan_files(spark, f"{tree}/arm-v3", "*.mp4").collect()}
    assert list(files) == [f"videos/{CAMERA}/chunk-000/file-000.mp4"]
    assert files[f"videos/{CAMERA}/chunk-000/file-000.mp4"].hash == hashlib.sha256(b"video bytes").hexdigest()
    listed = [r.path for r in I.list_files(spark, f"{tree}/arm-v2", r"^data/.*\.parquet$").collect()]
    assert listed == ["data/chunk-000/episode_000000.parquet", "data/chunk-000/episode_000001.parquet"]


def test_write_frames_round_trip(spark, tree, tmp_path):
    frames = E.read_frames(spark, f"{tree}/arm-v3", ["timestamp", "observation.state"]).drop("dataset")
    E.write_frames(frames, f"{tmp_path}/data", 2)
    again = spark.read.parquet(f"{tmp_path}/data")
    assert again.schema["observation.state"].dataType.simpleString() == "array<float>"
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, frames.collect()))


def test_ingest_appends_validates_and_refuses_repeats(spark, tree):
    context = IntakeContext("org", "teleop_real", 100, 200, "0x" + "ab" * 32)
    consents = spark.createDataFrame(
        [(f"{tree}/{d}", e, bytearray(b"r%d" % e), bytearray(b"%s%d" % (d.encode(), e))) for d in ("arm-v3", "arm-v2") for e in range(4)],
        "dataset string, episode_index bigint, record binary, salt binary",
    )
    empty = spark.createDataFrame([], "idx bigint, org_id string, manifest_hash binary")
    appended, errors = ingest(spark, f"{tree}/*", context, empty, consents)
    rows = sorted(appended.collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == [0, 1, 2] and [r.episode_index for r in rows] == [0, 1, 2]
    assert all(len(r.record) == 197 and bytes(r.leaf) == hashlib.sha256(b"\x00" + bytes(r.record)).digest() for r in rows)
    got = sorted((os.path.basename(r.dataset), r.episode_index, r.code) for r in errors.collect())
    # without a frame rate the per-episode set cannot pass validation
    assert got == [("arm-v2", 0, "invalid"), ("arm-v2", 1, "invalid"), ("arm-v3", 3, "unreadable")]
    log = spark.createDataFrame([(r.idx, "org", r.manifest_hash) for r in rows[:2]], "idx bigint, org_id string, manifest_hash binary")
    again, errors = ingest(spark, f"{tree}/arm-v3", context, log, consents)
    assert [(r.idx, r.episode_index) for r in again.collect()] == [(2, 2)]
    assert sorted((r.episode_index, r.message) for r in errors.filter("code = 'conflict'").collect()) == [(0, "already logged at 0"), (1, "already logged at 1")]


def test_ledger_events_batch_and_stream(spark, tmp_path):
    from episode_audit.sources import ledger_events as L

    h = "0x" + "Ab" * 32
    rows = [
        {"corpus": 1, "manifest_hash": h, "corpus_root": h, "supplier": "s", "price": "5", "token": "t"},
        {"corpus": 2, "manifest_hash": h, "corpus_root": h, "supplier": "s", "price": str(2**128 - 1), "token": "t"},
        {"corpus": 3, "manifest_hash": "0x12", "corpus_root": h, "supplier": "s", "price": "5", "token": "t"},
        {"corpus": 4, "manifest_hash": h, "corpus_root": h, "supplier": "s", "price": "-5", "token": "t"},
        {"corpus": 5, "manifest_hash": h, "corpus_root": h, "supplier": "s", "price": "9" * 38, "token": "t"},
    ]
    put(f"{tmp_path}/sealed/a.json", "\n".join(map(json.dumps, rows)).encode())
    good, bad = L.typed(L.read_events(spark, f"{tmp_path}/sealed", "corpus_sealed"))
    assert {r.corpus: int(r.price) for r in good.collect()} == {1: 5, 5: int("9" * 38)}
    assert good.schema["manifest_hash"].dataType.simpleString() == "binary"
    assert {r.corpus: r.price for r in bad.collect()} == {2: str(2**128 - 1), 3: "5", 4: "-5"}
    live, _ = L.typed(L.read_events(spark, f"{tmp_path}/sealed", "corpus_sealed", stream=True))
    query = live.writeStream.format("memory").queryName("sealed").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.corpus for r in spark.table("sealed").collect()) == [1, 5]


def test_limits_by_machine_type(spark):
    from episode_audit.operators.checks.kinematics import with_limits

    rows = spark.createDataFrame([(1, "so_arm100"), (2, "unitree_g1"), (3, "no such thing"), (4, None)], "episode int, embodiment string")
    got = {r.episode: r.max_vel for r in with_limits(rows).collect()}
    assert got == {1: [4.8] * 5, 2: None, 3: None, 4: None}
