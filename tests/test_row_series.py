"""Row-bounded parts: previous rows, positions and attached facts against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episode_audit.operators import row_series as R


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of all rows, all of them at one time; others have one or a few."""
    rng = random.Random(7)
    data = [("hot", 5, i, rng.random(), [float(i)]) for i in range(300)]
    data += [(f"k{rng.randrange(200)}", rng.randrange(50), 1000 + i, rng.random(), [float(i), 1.0]) for i in range(600)]
    return spark.createDataFrame(data, "k string, at bigint, id bigint, v double, a array<double>").repartition(5)


@pytest.mark.parametrize("size", [1, 2, 7, 100, 10_000])
@pytest.mark.parametrize("depth", [1, 3])
def test_previous_rows_equal_window(spark, rows, size, depth):
    facts = spark.createDataFrame([("hot", 1.5)], "k string, fact double")
    parts = R.in_parts(rows, ["k"], ["at", "id"], size)
    got = R.with_previous(parts, ["k"], ["v", "a"], depth=depth, attributes=facts)
    w = Window.partitionBy("k").orderBy("at", "id")
    names = [f"prev{'' if d == 1 else d}_{c}" for d in range(1, depth + 1) for c in ("v", "a")]
    lags = [F.lag(c).over(w) if d == 1 else F.lag(c, d).over(w) for d in range(1, depth + 1) for c in ("v", "a")]
    want = rows.join(facts, "k", "left").select("k", "id", "fact", (F.row_number().over(w) - 1).alias("pos"), *(x.alias(n) for x, n in zip(lags, names)))
    assert sorted(map(str, got.select("k", "id", "fact", "pos", *names).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("size", [1, 10, 64])
def test_no_part_is_larger_than_asked(rows, size):
    parts = R.in_parts(rows, ["k"], ["at", "id"], size)
    counts = [r["count"] for r in parts.groupBy(R.PART).count().collect()]
    assert max(counts) <= size and sum(counts) == 900
    hot = parts.filter("k = 'hot'").select(R.PART).distinct().count()
    assert hot >= 300 / size


def test_rows_filtered_after_the_parts_were_made(rows):
    parts = R.in_parts(rows, ["k"], ["at", "id"], 4).filter("id % 3 = 0")
    got = {r.id: (r.pos, r.prev_id, r.prev2_id) for r in R.with_previous(parts, ["k"], ["id"], depth=2).collect()}
    w = Window.partitionBy("k").orderBy("at", "id")
    want = rows.filter("id % 3 = 0").select("id", (F.row_number().over(w) - 1).alias("pos"), F.lag("id").over(w).alias("a"), F.lag("id", 2).over(w).alias("b"))
    assert got == {r.id: (r.pos, r.a, r.b) for r in want.collect()}


def test_numbers_with_and_without_key(rows):
    got = R.numbered(rows, [], ["at", "id"], rows=50).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(900)) and [(r.at, r.id) for r in got] == sorted((r.at, r.id) for r in got)
    w = Window.partitionBy("k").orderBy("at", "id")
    want = {r.id: r.p for r in rows.select("id", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert {r.id: r.pos for r in R.numbered(rows, ["k"], ["at", "id"], rows=13).collect()} == want
    assert R.numbered(rows.limit(0), ["k"], ["at"]).count() == 0 and R.with_previous(R.in_parts(rows.limit(0), ["k"], ["at"]), ["k"], ["v"]).count() == 0


def test_attached_facts_are_an_inner_join(spark, rows):
    facts = spark.createDataFrame([("hot", 1), ("k3", 2), ("nobody", 3)], "k string, fact int")
    got = R.attach(R.in_parts(rows, ["k"], ["at", "id"], 9), ["k"], facts)
    assert sorted((r.id, r.fact) for r in got.collect()) == sorted((r.id, r.fact) for r in rows.join(facts, "k").collect())
