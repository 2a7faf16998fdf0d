"""Append-only tree digests over (idx, leaf) tables, folded block by block.

Indices are dense from 0. A block holds 2^BLOCK_BITS consecutive entries and is
folded inside one row, so a tree of n entries costs one shuffle of n rows, one
of n/1024 rows and so on, instead of one shuffle per level. Every function also
takes group columns: one tree per group, a group of any size being spread over
its blocks. A gap or a repeated index makes the digest null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import node_hash
from ..session import cut_lineage

BLOCK_BITS = 10


def rounds_for(entries: int, bits: int = BLOCK_BITS) -> int:
    return max(1, -(-max(entries - 1, 1).bit_length() // bits))


def _pairs(a: Column) -> Column:
    """Next level up; an odd last entry moves up unchanged."""
    last = F.floor((F.size(a) + 1) / 2).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(i * 2 + 1 < F.size(a), node_hash(F.get(a, i * 2), F.get(a, i * 2 + 1))).otherwise(F.get(a, i * 2)),
    )


def _full_pairs(a: Column) -> Column:
    """Next level up, complete pairs only."""
    last = F.floor(F.size(a) / 2).cast("int") - 1
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: node_hash(F.get(a, i * 2), F.get(a, i * 2 + 1))),
    ).otherwise(F.array().cast("array<binary>"))


def _blocks(entries: DataFrame, group: Sequence[str], bits: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per block: `hashes` in index order, null when an index is missing or repeated.

    `rows` holds the columns `keep` of its entries in the same order, `_n` how many entries there are.
    """
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = F.sort_array(F.collect_list(F.struct("idx", "leaf", *kept)))
    n = F.sum("_n") if "_n" in entries.columns else F.count(F.lit(1))
    blocks = entries.groupBy(*group, F.shiftright("idx", bits).alias("_block")).agg(rows.alias("_rows"), n.alias("_n"))
    first, last = F.get("_rows", F.lit(0)).getField("idx"), F.get("_rows", F.size("_rows") - 1).getField("idx")
    dense = (first == F.shiftleft("_block", bits)) & (last - first + 1 == F.size("_rows"))
    distinct = F.size(F.array_distinct(F.transform("_rows", lambda r: r.getField("idx")))) == F.size("_rows")
    hashes = F.transform("_rows", lambda r: r.getField("leaf"))
    more = [F.transform("_rows", lambda r: r.getField("kept")).alias("rows")] if keep else []
    return blocks.select(*group, "_block", "_n", F.when(dense & distinct, hashes).alias("hashes"), *more)


def fold(hashes: Column) -> Column:
    """Root of the hashes held in one array, however many; as many rounds as the array needs."""
    rounds = F.greatest(F.length(F.bin(F.greatest(F.size(hashes) - 1, F.lit(1)))), F.lit(1))
    return F.get(F.aggregate(F.sequence(F.lit(1), rounds), hashes, lambda a, _: _pairs(a)), 0)


def root(leaves: DataFrame, entries: int, group: Sequence[str] = (), bits: int = BLOCK_BITS, count: str | None = None) -> DataFrame:
    """Tree root per group (column `root`); `entries` bounds the largest group. `count` names a column for its number of entries."""
    level = leaves.select(*group, F.col("idx"), F.col("leaf"))
    for _ in range(rounds_for(entries, bits)):
        level = _blocks(level, group, bits).select(*group, F.col("_block").alias("idx"), fold(F.col("hashes")).alias("leaf"), "_n")
    return level.select(*group, F.col("leaf").alias("root"), *([F.col("_n").alias(count)] if count else []))


NODE = "struct<level:int,idx:bigint,hash:binary>"


def _node_step(below: int, bits: int):
    """One level up inside a block whose own entries sit at level `below`."""

    def step(acc: Column, l: Column) -> Column:
        up = _full_pairs(acc.getField("cur"))
        first = F.shiftleft(F.col("_block"), bits) / F.pow(F.lit(2.0), l)
        made = F.transform(
            up,
            lambda h, j: F.struct(
                (l + below).cast("int").alias("level"), (first + j).cast("bigint").alias("idx"), h.alias("hash")
            ).cast(NODE),
        )
        return F.struct(up.alias("cur"), F.concat(acc.getField("made"), made).alias("made"))

    return step


def complete_nodes(leaves: DataFrame, entries: int, bits: int = BLOCK_BITS) -> DataFrame:
    """(level, idx, hash) of every complete subtree, leaves included as level 0.

    The first round holds almost all of the work. Its result is used both as
    output and as input of the next round, so it is cut off once.
    """
    out = leaves.select(F.lit(0).alias("level"), F.col("idx").cast("bigint").alias("idx"), F.col("leaf").alias("hash"))
    level = leaves.select("idx", "leaf")
    rounds = rounds_for(entries, bits)
    for r in range(rounds):
        start = F.struct(F.col("hashes").alias("cur"), F.array().cast(f"array<{NODE}>").alias("made"))
        made = _blocks(level, (), bits).select(
            F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, _node_step(r * bits, bits)).getField("made").alias("made")
        )
        if r == 0 and rounds > 1:
            made = cut_lineage(made)
        nodes = made.select(F.explode("made").alias("n")).select("n.*")
        out = out.unionByName(nodes)
        level = nodes.filter(F.col("level") == (r + 1) * bits).select("idx", F.col("hash").alias("leaf"))
    return out


def range_roots(nodes: DataFrame, ranges: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Root of the entries [lo, hi) of each range; lo must be aligned to the range's top level.

    A range is split by the set bits of its length into complete subtrees, so
    any number of ranges costs one join with the node table.
    """
    length = F.col("hi") - F.col("lo")
    parts = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: length.bitwiseAND(_power(b)) != 0),
        lambda b: F.struct(
            b.alias("level"),
            (F.col("lo") / _power(b).cast("double") + F.floor(length / (_power(b) * 2).cast("double")) * 2).cast("bigint").alias("idx"),
        ),
    )
    wanted = ranges.select(*identity, F.explode(parts).alias("p")).select(*identity, "p.*")
    found = wanted.join(nodes, ["level", "idx"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("level", "hash")))
    gathered = found.groupBy(*identity).agg(ordered.alias("parts"), F.count_if(F.col("hash").isNull()).alias("_missing"))
    start = F.get("parts", 0).getField("hash")
    rest = F.slice("parts", 2, 64)
    folded = F.aggregate(rest, start, lambda acc, p: node_hash(p.getField("hash"), acc))
    return gathered.select(*identity, F.when(F.col("_missing") == 0, folded).alias("root"))


def _power(b: Column) -> Column:
    return F.pow(F.lit(2.0), b).cast("bigint")


def prefix_roots(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Root of the first `size` entries for every size above 0."""
    ranges = sizes.select("size").distinct().select("size", F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi"))
    return range_roots(nodes, ranges, ["size"])


def inclusion_proofs(
    leaves: DataFrame, entries: int, group: Sequence[str] = (), bits: int = BLOCK_BITS, keep: Sequence[str] = (),
    wanted: str | None = None, heads: bool = False,
) -> DataFrame:
    """Siblings from leaf to root for every entry (column `proof`).

    The part inside a block comes from the block's own row; the part above is
    the block's own proof in the tree of block roots, shared by its entries and
    joined to the block before it is spread over them. Columns `keep` of the entries come
    along, so neither they nor the proofs need a join; of the entries only those
    are spread for which the kept column `wanted` holds. `heads` adds the group's
    `root` and number of entries (`entries`).
    """
    group, keep = list(group), list(keep)
    extra = ["root", "entries"] if heads else []
    blocks = _blocks(leaves.select(*group, "idx", "leaf", *keep, *(["_n"] if "_n" in leaves.columns else [])), group, bits, keep)
    if rounds_for(entries, bits) == 1:
        upper = F.array().cast("array<binary>")
        whole = blocks.select("*", upper.alias("upper"), *([fold(F.col("hashes")).alias("root"), F.col("_n").alias("entries")] if heads else []))
    else:
        narrow = _blocks(leaves.select(*group, "idx", "leaf", *(["_n"] if "_n" in leaves.columns else [])), group, bits) if keep else blocks
        tops = narrow.select(*group, F.col("_block").alias("idx"), fold(F.col("hashes")).alias("leaf"), "_n")
        above = inclusion_proofs(tops, -(-entries // 2**bits), group, bits, heads=heads).select(
            *group, F.col("idx").alias("_block"), F.col("proof").alias("upper"), *extra
        )
        whole = blocks.join(above, [*group, "_block"])
    start = F.array("hashes")
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)), start, lambda acc, _: F.concat(acc, F.array(_pairs(F.element_at(acc, -1))))
    )

    def lower(j: Column) -> Column:
        siblings = (F.get(F.get("levels", F.lit(l)), F.shiftright(j, l).bitwiseXOR(F.lit(1))) for l in range(bits))
        return F.filter(F.array(*siblings), lambda s: s.isNotNull())

    def entry(h: Column, j: Column) -> Column:
        kept = [F.get("rows", j).alias("kept")] if keep else []
        return F.struct((F.shiftleft(F.col("_block"), bits) + j).alias("idx"), h.alias("leaf"), j.alias("j"), *kept)

    entries_of = F.transform("hashes", entry)
    if wanted:
        entries_of = F.filter(entries_of, lambda x: x.getField("kept").getField(wanted))
    # siblings are taken before the spreading, which would copy the levels of a block to each of its entries
    listed = F.transform(entries_of, lambda x: x.withField("lower", lower(x.getField("j"))))
    leveled = whole.select(*whole.columns, levels.alias("levels"))
    inside = leveled.select(*group, "upper", *extra, F.explode(listed).alias("x"))
    names = [F.col(f"x.kept.{c}").alias(c) for c in keep]
    return inside.select(*group, "x.idx", "x.leaf", F.concat("x.lower", "upper").alias("proof"), *extra, *names)


def inclusion_root(leaf: Column, idx: Column, size: Column, proof: Column) -> Column:
    """Root that a proof leads to, or null when its length does not fit."""
    at = lambda x, l: F.call_function("shiftright", x.cast("bigint"), l)
    steps = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.least(F.length(F.bin((size - 1).cast("bigint"))), F.lit(63)) - 1),
            lambda l: F.when(at(idx, l) % 2 == 1, F.lit("left")).when(at(idx, l) < at(size - 1, l), F.lit("right")),
        ),
        lambda s: s.isNotNull(),
    )
    walked = F.aggregate(
        F.arrays_zip(steps.alias("side"), proof.alias("hash")),
        leaf,
        lambda acc, x: F.when(x.getField("side") == "left", node_hash(x.getField("hash"), acc)).otherwise(
            node_hash(acc, x.getField("hash"))
        ),
    )
    return F.when((idx >= 0) & (idx < size) & (F.size(steps) == F.size(proof)), walked)


def verify_inclusion(leaf: Column, idx: Column, size: Column, proof: Column, expected: Column) -> Column:
    return F.coalesce(inclusion_root(leaf, idx, size, proof) == expected, F.lit(False))


def consistency_ranges(m: Column, n: Column) -> Column:
    """Ranges whose roots prove that the first m of n entries did not change, deepest first.

    Walks from the whole tree down to the split at m; `left` marks ranges that
    lie before m. Equal sizes need no proof.
    """
    item = "struct<lo:bigint,hi:bigint,left:boolean>"
    state = f"struct<lo:bigint,hi:bigint,whole:boolean,open:boolean,made:array<{item}>>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("lo"), n.cast("bigint").alias("hi"), F.lit(True).alias("whole"), (m < n).alias("open"),
        F.array().cast(f"array<{item}>").alias("made"),
    ).cast(state)

    def step(acc: Column, _: Column) -> Column:
        lo, hi, made = acc.getField("lo"), acc.getField("hi"), acc.getField("made")
        half = _power(F.length(F.bin(F.greatest(hi - lo - 1, F.lit(1)))) - 1)
        middle = lo + half
        done = m == hi
        goes_left = m <= middle
        terminal = F.when(acc.getField("whole"), F.array().cast(f"array<{item}>")).otherwise(
            F.array(F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("left")).cast(item))
        )
        sibling = F.when(goes_left, F.struct(middle.alias("lo"), hi.alias("hi"), F.lit(False).alias("left")).cast(item)).otherwise(
            F.struct(lo.alias("lo"), middle.alias("hi"), F.lit(True).alias("left")).cast(item)
        )
        moved = F.struct(
            F.when(goes_left, lo).otherwise(middle).alias("lo"),
            F.when(goes_left, middle).otherwise(hi).alias("hi"),
            (acc.getField("whole") & goes_left).alias("whole"),
            F.lit(True).alias("open"),
            F.concat(made, F.array(sibling)).alias("made"),
        ).cast(state)
        closed = F.struct(
            lo.alias("lo"), hi.alias("hi"), acc.getField("whole").alias("whole"), F.lit(False).alias("open"), F.concat(made, terminal).alias("made"),
        ).cast(state)
        return F.when(~acc.getField("open"), acc).when(done, closed).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)
    return F.reverse(walked.getField("made"))


def consistency_proofs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds `proof` (ordered hashes) to rows (m, n) with 1 <= m <= n."""
    listed = pairs.select("m", "n").distinct().select("m", "n", F.posexplode_outer(consistency_ranges(F.col("m"), F.col("n"))).alias("pos", "r"))
    ranges = listed.select("m", "n", "pos", "r.lo", "r.hi")
    roots = range_roots(nodes, ranges.filter(F.col("pos").isNotNull()), ["m", "n", "pos"])
    joined = listed.select("m", "n", "pos").join(roots, ["m", "n", "pos"], "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "root"))))
    return joined.groupBy("m", "n").agg(F.transform(ordered, lambda x: x.getField("root")).alias("proof"))


def verify_consistency(m: Column, n: Column, proof: Column, old_root: Column, new_root: Column) -> Column:
    """Does the proof show that old_root (size m) is a prefix of new_root (size n)."""
    ranges = consistency_ranges(m, n)
    # a tree that is complete at m is its own first element
    whole = F.exists(F.slice(ranges, 1, 1), lambda r: ~((r.getField("hi") == m) & r.getField("left"))) | (F.size(ranges) == 0)
    first = F.when(whole, old_root).otherwise(F.get(proof, 0))
    skip = F.when(whole, 0).otherwise(1)
    rest = F.slice(F.arrays_zip(ranges.alias("r"), proof.alias("hash")), skip + 1, 200)
    state = F.struct(first.alias("old"), first.alias("new"))

    def step(acc: Column, x: Column) -> Column:
        h, left = x.getField("hash"), x.getField("r").getField("left")
        return F.struct(
            F.when(left, node_hash(h, acc.getField("old"))).otherwise(acc.getField("old")).alias("old"),
            F.when(left, node_hash(h, acc.getField("new"))).otherwise(node_hash(acc.getField("new"), h)).alias("new"),
        )

    end = F.aggregate(rest, state, step)
    fits = F.size(ranges) == F.size(proof)
    good = (end.getField("old") == old_root) & (end.getField("new") == new_root)
    return F.coalesce(F.when(m == n, (F.size(proof) == 0) & (old_root == new_root)).otherwise(fits & good), F.lit(False))
