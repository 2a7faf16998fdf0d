"""Block-wise trees against a short recursive definition."""

import hashlib

import pytest
from pyspark.sql import functions as F

from episode_audit.operators import merkle as M


def h(data):
    return hashlib.sha256(data).digest()


def half(n):
    return 1 << (n - 1).bit_length() - 1


def plain_root(xs):
    if len(xs) == 1:
        return xs[0]
    k = half(len(xs))
    return h(b"\x01" + plain_root(xs[:k]) + plain_root(xs[k:]))


def plain_proof(xs, i):
    if len(xs) == 1:
        return []
    k = half(len(xs))
    if i < k:
        return plain_proof(xs[:k], i) + [plain_root(xs[k:])]
    return plain_proof(xs[k:], i - k) + [plain_root(xs[:k])]


def plain_consistency(xs, m, whole=True):
    if m == len(xs):
        return [] if whole else [plain_root(xs)]
    k = half(len(xs))
    if m <= k:
        return plain_consistency(xs[:k], m, whole) + [plain_root(xs[k:])]
    return plain_consistency(xs[k:], m - k, False) + [plain_root(xs[:k])]


LEAVES = [h(b"leaf%d" % i) for i in range(70)]
BITS = 2  # tiny blocks: several rounds even for 70 entries


@pytest.fixture(scope="module")
def leaves(spark):
    return spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(LEAVES)], "idx bigint, leaf binary")


@pytest.fixture(scope="module")
def forests(spark):
    rows = [(n, i, bytearray(LEAVES[i])) for n in range(1, 71) for i in range(n)]
    return spark.createDataFrame(rows, "n int, idx bigint, leaf binary")


def test_rounds():
    assert [M.rounds_for(n, 2) for n in (1, 2, 4, 5, 16, 17, 64, 65)] == [1, 1, 1, 2, 2, 3, 3, 4]


def test_root_of_every_size(forests):
    got = {r.n: bytes(r.root) for r in M.root(forests, 70, ["n"], BITS).collect()}
    assert got == {n: plain_root(LEAVES[:n]) for n in range(1, 71)}


def test_root_is_null_on_gap_or_repeat(spark, leaves):
    gap = leaves.filter("idx <> 33")
    assert M.root(gap, 70, (), BITS).first().root is None
    assert M.root(leaves.union(leaves.filter("idx = 7")), 71, (), BITS).first().root is None


def test_prefix_roots(spark, leaves):
    nodes = M.complete_nodes(leaves, 70, BITS)
    assert nodes.count() == sum(70 >> l for l in range(7))
    got = {r.size: bytes(r.root) for r in M.prefix_roots(nodes, spark.range(1, 71).toDF("size")).collect()}
    assert got == {n: plain_root(LEAVES[:n]) for n in range(1, 71)}


def test_inclusion_of_every_leaf_in_every_size(forests):
    proofs = M.inclusion_proofs(forests, 70, ["n"], BITS).join(M.root(forests, 70, ["n"], BITS), "n")
    checked = proofs.withColumn("ok", M.verify_inclusion(F.col("leaf"), F.col("idx"), F.col("n"), F.col("proof"), F.col("root")))
    checked = checked.withColumn("bad", M.verify_inclusion(F.col("leaf"), F.col("idx") + 1, F.col("n"), F.col("proof"), F.col("root")))
    for r in checked.collect():
        assert [bytes(x) for x in r.proof] == plain_proof(LEAVES[: r.n], r.idx)
        assert r.ok and not (r.bad and r.n > 1)


def test_consistency_of_every_pair(spark, leaves):
    nodes = M.complete_nodes(leaves, 70, BITS)
    pairs = spark.createDataFrame([(m, n) for n in range(1, 71, 3) for m in range(1, n + 1)], "m bigint, n bigint")
    roots = M.prefix_roots(nodes, spark.range(1, 71).toDF("size"))
    proofs = (
        M.consistency_proofs(nodes, pairs)
        .join(roots.select(F.col("size").alias("m"), F.col("root").alias("old")), "m")
        .join(roots.select(F.col("size").alias("n"), F.col("root").alias("new")), "n")
    )
    verify = lambda old, new: M.verify_consistency(F.col("m"), F.col("n"), F.col("proof"), old, new)
    checked = proofs.select("*", verify(F.col("old"), F.col("new")).alias("ok"), verify(F.col("new"), F.col("old")).alias("swapped"))
    rows = checked.collect()
    assert len(rows) == pairs.count()
    for r in rows:
        assert [bytes(x) for x in r.proof] == plain_consistency(LEAVES[: r.n], r.m), (r.m, r.n)
        assert r.ok, (r.m, r.n)
        assert r.m == r.n or not r.swapped


@pytest.mark.parametrize("bits", [2, 10])
def test_proofs_bring_columns_and_heads_along(spark, forests, bits):
    """Kept columns, roots and counts come with the proofs, for all entries or for those wanted."""
    rows = forests.withColumn("twice", F.col("idx") * 2).withColumn("third", F.col("idx") % 3 == 0)
    plain = {(r.n, r.idx): r.proof for r in M.inclusion_proofs(forests, 70, ["n"], bits).collect()}
    got = M.inclusion_proofs(rows, 70, ["n"], bits, keep=["twice", "third"], wanted="third", heads=True).collect()
    assert {(r.n, r.idx) for r in got} == {k for k in plain if k[1] % 3 == 0}
    for r in got:
        assert r.twice == 2 * r.idx and r.entries == r.n and r.proof == plain[r.n, r.idx] and bytes(r.root) == plain_root(LEAVES[: r.n])


def test_root_counts_its_entries(forests):
    got = M.root(forests, 70, ["n"], BITS, count="entries").collect()
    assert len(got) == 70 and all(r.entries == r.n for r in got)
