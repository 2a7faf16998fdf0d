"""Chunked windows, as-of joins and salted joins against plain windows and loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episode_audit.operators import scale as S
from episode_audit.operators.lookups import repeats, valid_at


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(7)
    data = [(random.choice("aaaaab"), random.randrange(4000), i, random.random()) for i in range(900)]
    return spark.createDataFrame(data, "k string, at bigint, id bigint, v double").cache()


@pytest.mark.parametrize("width", [1, 7, 500, 100000])
def test_series_equals_window(spark, rows, monkeypatch, width):
    monkeypatch.setattr(S, "GROUP_BITS", 2)
    facts = spark.createDataFrame([("a", 1.5)], "k string, fact double")
    got = S.chunked_series(rows, ["k"], ["at", "id"], F.expr(f"at div {width}"), previous=["v", "id"], attributes=facts)
    w = Window.partitionBy("k").orderBy("at", "id")
    want = rows.join(facts, "k", "left").select(
        "k", "at", "id", "v", "fact", (F.row_number().over(w) - 1).alias("pos"), F.lag("v").over(w).alias("prev_v"), F.lag("id").over(w).alias("prev_id"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_positions_without_key(rows):
    got = S.positions(rows, [], ["at", "id"], F.expr("at div 50")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(900))
    assert [(r.at, r.id) for r in got] == sorted((r.at, r.id) for r in got)


@pytest.mark.parametrize("direction", ["after", "before"])
@pytest.mark.parametrize("width", [1, 13, 5000])
def test_nearest_mark(spark, rows, direction, width):
    random.seed(8)
    marks = [("a", random.randrange(-50, 3900), i) for i in range(60)] + [("c", 5, 1)]
    table = spark.createDataFrame(marks, "k string, at bigint, mark bigint").withColumn("where", F.col("at"))
    got = {r.id: (r.mark, r.where) for r in S.nearest_mark(rows, table, ["k"], F.col("at"), F.col("where"), ["mark", "where"], width, direction).collect()}
    assert len(got) == 900
    for r in rows.collect():
        near = [(abs(at - r.at), -m, (m, at)) for k, at, m in marks if k == r.k and (at >= r.at if direction == "after" else at <= r.at)]
        assert got[r.id] == (min(near)[2] if near else (None, None))


def test_salted_join_keeps_every_row(spark, rows, monkeypatch):
    per_key = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("first"))
    for hot_rows in (10, 10**9):
        got = S.join_per_key(rows, per_key, ["k"], F.col("id"), hot_rows=hot_rows)
        assert got.count() == 900
        assert got.select("k", "first").distinct().count() == 2
    later = repeats(rows, ["k"], "id")
    assert later.count() == 898 and set(later.columns) == {"k", "at", "id", "v", "first_id"}


def test_latest_and_validity(spark):
    claims = spark.createDataFrame([("s", 5, 1, "x"), ("s", 7, 2, "y"), ("s", 7, 3, "z"), ("t", 1, 4, "w")], "k string, at int, seq int, v string")
    first = S.latest_per_key(claims, ["k"], [F.col("at"), -F.col("seq")], ["v"])
    last = S.latest_per_key(claims, ["k"], [F.col("at"), F.col("seq")], ["v"])
    assert {r.k: r.v for r in first.collect()} == {"s": "y", "t": "w"} and {r.k: r.v for r in last.collect()} == {"s": "z", "t": "w"}
    spans = spark.createDataFrame([("s", 0, 6), ("s", 7, None)], "k string, valid_from int, valid_to int")
    got = {(r.k, r.seq): r.key_valid for r in valid_at(claims, spans, ["k"], "at").collect()}
    assert got == {("s", 1): True, ("s", 2): True, ("s", 3): True, ("t", 4): False}
