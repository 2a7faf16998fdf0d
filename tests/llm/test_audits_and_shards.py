"""Filter interaction, source divergence and sharding against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from episode_audit.llm import filter_audit, sharding, source_audit
from episode_audit.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (7, 1, 0), (40, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- filter audit


def failed_sets(rows):
    """Brute force: the letters that every row fails."""
    ids = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            ids[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        text = r.text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": r.doc_id is not None and any(i < r.doc_id for i in ids[text]),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def audited(rows, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    sets, parts = failed_sets(rows), defaultdict(list)
    for r, fails in zip(rows, sets, strict=True):
        parts[r.source or ""].append((r.doc_id, fails))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(members)
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                all_f = sum(f in fails for _, fails in members)
                alone = sum(fails == {f} for _, fails in members)
                out[part, "".join(order), step] = (
                    len(left), len(gone), all_f - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone)
                )
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (shapley[f],)
    return out


def audit_rows(df):
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[f] for f in fields) for r in df.collect()}


def test_filter_audit_odd_rows(spark, odd_docs, no_docs, labels):
    extra = spark.createDataFrame(
        [(31, "Same TEXT | here", "en", "a"), (30, "Same TEXT | here", "en", "b"), (30, "Same TEXT | here", "en", "b"), (None, "Same TEXT | here", "en", "b"), (40, "x y " * 300, "en", "")], DOC
    )
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    got = filter_audit.audit(docs, labels)
    assert audit_rows(got) == audited(docs.collect(), labels.collect())
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_filter_audit_hot_copies_and_other_filters(spark, labels):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("again")).otherwise(F.concat(F.lit("t#"), (F.col("id") % 2500).cast("string"))).alias("text"), F.lit("s").alias("source")
    )
    facts = filter_audit.facts_of(docs, labels, {}, "doc_id", "text", "source")
    rows, first = docs.collect(), {}
    for r in rows:
        first.setdefault(r.text, r.doc_id)
    assert sorted(r.id for r in filter_audit.repeated(facts).collect()) == sorted(r.doc_id for r in rows if first[r.text] < r.doc_id)
    two = filter_audit.audit(docs, labels, {"D": F.col("text").contains("#")})
    got = {(r.filter_order, r.step): r.removed for r in two.collect()}
    with_sign = sum("#" in r.text for r in rows)
    again = sum(first[r.text] < r.doc_id for r in rows)
    assert got["DE", 1] == with_sign and got["ED", 1] == again and got["DE", 2] == 999 and got["ED", 2] == with_sign - (again - 999)


def test_filter_audit_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = audited(rows, spark.read.parquet(f"{DATA}/labels.parquet").collect())
    assert audit_rows(QUERIES["op11_filter_audit"](spark, DATA)) == want


# --- source divergence


def diverging(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(set), Counter(), set()
    for k, r in enumerate(rows):
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        for term in TERM.findall((r.text or "").translate(LOW)):
            docs[lang, term].add(k)
            counts[lang, source, term] += 1
    out = {}
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), d in docs.items() if l == lang and len(d) >= min_docs)
        sources = sorted(s for l, s in groups if l == lang)
        shares = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x, t] for x in sources) if s is None else counts[lang, s, t] for t in kept}
            total = sum(n.values()) + 2 * len(kept)
            shares[s] = {t: 1 + 1_000_000_000 * (n[t] + 2) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(shares[s][t], shares[None][t]), t) for t in kept if counts[lang, s, t] and shares[s][t] > shares[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, rank] = (item, value)
    return out


def divergence_rows(df):
    return {(r.lang, r.source, r.part, r["rank"]): (r.item, r.value) for r in df.collect()}


def test_source_audit_odd_rows(spark, odd_docs, no_docs):
    for least in (1, 2, 3):
        got = divergence_rows(source_audit.divergence(odd_docs, min_docs=least))
        assert got == diverging(odd_docs.collect(), least)
    assert divergence_rows(source_audit.divergence(odd_docs)) == diverging(odd_docs.collect())  # no term is kept
    assert source_audit.divergence(no_docs).count() == 0


@pytest.mark.parametrize("held", [1, 50, 200_000])
def test_source_audit_terms_of_several_chunks(spark, held, monkeypatch):
    """Terms near the limit whose documents overlap between chunks; counting handed on after every few chunks."""
    rng = random.Random(held)
    forms = ["{}", "{}.", "({})", "{0}-{0}", "{}é", "X{}"]
    rows = []
    for i in range(300):
        words = [rng.choice(forms).format(rng.choice(["Ab", "ab", "cd", "e", "ef", "gh", "ij"]) + "xyz"[rng.randrange(3)] * rng.randrange(4)) for _ in range(rng.randrange(8))]
        rows.append((i, rng.choice([" ", "\n", "\t\r", " \x0b\x0c"]).join(words), rng.choice(["en", "de"]), rng.choice("pqr")))
    rows.append((301, "solo\x1cab\x85cd\xa0ef " * 3, "en", "only"))
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    monkeypatch.setattr(source_audit, "HELD", held)
    if held == 50:  # every bit is set, so all chunks slip through
        monkeypatch.setattr(source_audit, "BITS", 32768)
        full = source_audit.bitmap(spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("chunk")))
        assert full == b"\xff" * 4096
        monkeypatch.setattr(source_audit, "bitmap", lambda chunks: full)
    assert divergence_rows(source_audit.divergence(docs)) == diverging(docs.collect())


def test_source_audit_counts_beyond_double(spark):
    total = F.lit(10**16 + 7).cast("decimal(22,0)")
    p = spark.range(1).select(source_audit.share(F.lit(10**16 - 1), total).alias("p")).first().p
    assert p == 1 + 10**9 * (10**16 + 1) // (10**16 + 7)


def test_source_audit_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert divergence_rows(QUERIES["op12_source_audit"](spark, DATA)) == diverging(rows)


# --- sharding


def plain_difference(sizes, shards):
    """Karmarkar-Karp with whole member sets instead of a walk back."""
    heap = [(-s, k, [(0, ())] * (shards - 1) + [(s, (k,))]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joint = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: x[0])
        joint = [(s - joint[0][0], members) for s, members in joint]
        heapq.heappush(heap, (-joint[-1][0], made, joint))
        made += 1
    return [members for _, members in heap[0][2]]


def test_differencing_against_member_sets():
    rng = random.Random(5)
    for trial in range(60):
        sizes = sorted((rng.randrange(1, rng.choice([3, 50, 10_000])) for _ in range(rng.randrange(1, 60))), reverse=True)
        k = rng.randrange(1, 9)
        got = sharding.difference(sizes, k)
        want = plain_difference(sizes, k)
        assert [sorted(i for i, s in enumerate(got) if s == shard) for shard in range(k)] == [sorted(m) for m in want]
    assert sharding.difference([], 8) == []
    sums = lambda sizes, got: [sum(s for s, x in zip(sizes, got, strict=True) if x == k) for k in range(2)]
    assert sorted(sums([8, 7, 6, 5, 4], sharding.difference([8, 7, 6, 5, 4], 2))) == [14, 16]  # the textbook case
    # tighter than dealing the largest item to the emptiest shard
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 10**6) for _ in range(400)), reverse=True)
    got = sharding.difference(sizes, 8)
    ours = Counter()
    for s, k in zip(sizes, got, strict=True):
        ours[k] += s
    greedy = [0] * 8
    for s in sizes:
        greedy[greedy.index(min(greedy))] += s
    assert max(ours.values()) - min(ours.values()) < (max(greedy) - min(greedy)) / 4


def checked_shards(rows, shards=8):
    by_text, slots, sums = defaultdict(set), defaultdict(list), Counter({k: 0 for k in range(shards)})
    for digest, size, shard, slot in rows:
        by_text[digest].add(shard)
        slots[shard].append(slot)
        sums[shard] += size
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.id, r["size"], r.crc32) for r in got.collect()) == want
    checked_shards([(r.crc32, r["size"], r.shard, r.slot) for r in got.collect()])
    assert sharding.shard_documents(no_docs).count() == 0 and sharding.with_shard(no_docs).count() == 0
    marked = sharding.with_shard(odd_docs.withColumnRenamed("lang", "Shard"))
    assert marked.columns[-1] == "_shard" and marked.count() == odd_docs.count()
    of = {(r.id, r.crc32): r.shard for r in got.collect()}
    assert all(of[r.doc_id, zlib.crc32((r.text or "").encode())] == r._shard for r in marked.collect())


def test_sharding_hot_group_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    monkeypatch.setattr(sharding, "BUNDLES", 1024)
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 12 == 0, F.lit("hot " * 20)).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 37).cast("int"))).alias("text"),
    )
    runs = []
    for df in (docs.repartition(7), docs.repartition(3, "text")):
        rows = sharding.shard_documents(df).collect()
        sums = checked_shards([(r.crc32, r["size"], r.shard, r.slot) for r in rows])
        assert max(sums.values()) - min(sums.values()) < sum(sums.values()) / 1000
        runs.append(sorted((r.id, r.shard, r.slot) for r in rows))
    assert runs[0] == runs[1]  # however rows arrive
    hot = {r.shard for r in rows if r.id % 12 == 0}
    assert len(hot) == 1


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op13_sharding"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
    sums = checked_shards([(hashlib.sha256(docs[r.doc_id].encode()).digest(), r["size"], r.shard, r.slot) for r in rows])
    assert max(sums.values()) - min(sums.values()) <= 64
