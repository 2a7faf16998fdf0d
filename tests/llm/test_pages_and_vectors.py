"""Archives, page text and vector search; what the queries return; the pipeline."""

import hashlib
import os
import random
import struct

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from episode_audit.llm import html_text, multi_index, warc
from episode_audit.llm.queries import QUERIES

ODD_PAGES = [
    (1, "http://a.example/x", "<p>é same</p>", "r"),
    (2, "http://a.example/y\r\nX: y", "<p>é same</p>", "r"),
    (2, None, "<p>é same</p>", "r"),
    (3, None, None, "r"),
    (4, "u", "", "r"),
    (None, "u", "<p>other</p>", "r"),
    (None, "u", "<p>é same</p>", "r"),
    (5, "u", "<p>" + "long " * 40_000 + "</p>", "r"),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string, record_type string")


# --- WARC


def test_archives_round_trip(spark, odd_pages, tmp_path):
    assert warc.write_archives(odd_pages, str(tmp_path / "w")) == len(ODD_PAGES)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(rows) == len(ODD_PAGES) and all(r.problem is None for r in rows)
    first = {}
    for i, _, page, _ in ODD_PAGES:
        body = (page or "").encode()
        if i is not None:
            first[body] = min(i, first.get(body, i))
    expected = []
    for i, _, page, _ in ODD_PAGES:
        body = (page or "").encode()
        target = first.get(body)
        revisit = target is not None and target != i
        expected.append((i, "revisit" if revisit else "response", len(body), warc.b32(hashlib.sha1(body).digest()), target if revisit else None, None if revisit else body))
    got = [(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.write_archives(odd_pages.limit(0), str(tmp_path / "none")) == 0


def test_small_payloads_are_never_revisits(spark, odd_pages, tmp_path):
    warc.write_archives(odd_pages, str(tmp_path / "w"), smallest=10_000)
    assert {r.record_type for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {"response"}


def test_faults_are_named(spark, tmp_path):
    import zstandard

    words = warc.dictionary([])
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    good = warc.record(1, "u", b"payload", None)
    bad = [
        good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Day"), good[:-1], good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"),
        good.replace(b"Content-Length: 7", b"Content-Length: 6"), warc.record(2, "u", b"p", 1).replace(b"WARC-Profile", b"WARC-Other"),
    ]
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(words)) + words
    (tmp_path / "a.warc.zst").write_bytes(head + b"".join(coder.compress(r) for r in [good, *bad]))
    (tmp_path / "b.warc.zst").write_bytes(head + coder.compress(good)[:-3])
    packed = zstandard.ZstdCompressor().compress(words)
    (tmp_path / "c.warc.zst").write_bytes(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + coder.compress(good) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + coder.compress(good))
    problems = sorted(str(r.problem) for r in warc.read_archives(spark, str(tmp_path), payloads=False).collect())
    assert problems.count("None") == 3 and len(problems) == 1 + len(bad) + 1 + 2
    assert sum("cut off" in p for p in problems) == 1 and sum("digest" in p for p in problems) == 1 and sum("length" in p for p in problems) >= 2


def test_an_archive_is_cut_into_parts(spark, odd_pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100)
    warc.write_archives(odd_pages.coalesce(1), str(tmp_path / "w"))
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.zst")]) > 1
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == len(ODD_PAGES)


# --- page text


@pytest.fixture(scope="module")
def field(spark):
    return html_text.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_page_text_equals_the_article(spark, field):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in html_text.extract(pages, field).collect():
        found, labels = html_text.labelled(r.html)
        assert r.main_text == "\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def test_page_text_of_composed_pages(field):
    rng = random.Random(77)
    sentences = ["Once there was a sentence, rather long, which told of things and ended here.", "Another one follows it; this too is part of what the page is about, they say."]
    short = ["Home", "About us", "Read more", "Sign up", "A headline"]
    wrong = total = 0
    for _ in range(150):
        found, labels = html_text.composed(sentences, short, rng)
        wrong += sum(a != b for a, b in zip(field.label(found), labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_is_the_best_labelling(field):
    from itertools import product

    found, _ = html_text.composed(["A long sentence stands here, with commas, and more."], ["Menu", "x"], random.Random(3))
    found = found[:10]

    def total(labels):
        out = field.start[labels[0]] + labels[0] * field.score(found[0])
        for a, b, block in zip(labels, labels[1:], found[1:], strict=False):
            out += field.moves[a][b] + b * field.score(block)
        return out

    assert total(field.label(found)) == pytest.approx(max(map(total, product((0, 1), repeat=len(found)))))


def test_blocks_and_odd_pages(spark, field, odd_pages):
    page = "<head><title>t</title></head><body><script>a<b</script><!-- c --><div>one&nbsp;&amp;<b>two</b>\n three<p>four<p>five<br>six</div>tail &#233;<style>x</style><a title='a>b'>link</a>"
    assert [b[0] for b in html_text.blocks(page)] == ["one &two three", "four", "five six", "tail é link"]
    assert html_text.blocks("<div") == [] and [b[0] for b in html_text.blocks("a < b <!-- open")] == ["a < b"]
    rows = html_text.extract(odd_pages.withColumn("main_text", F.lit(1)), field).collect()
    assert len(rows) == len(ODD_PAGES) and all(r["_main_text"] == "" for r in rows if not r.html)
    assert html_text.extract(odd_pages.limit(0), field).count() == 0
    assert html_text.fit(odd_pages.limit(0)).text("<p>x</p>") is not None


# --- vector search


def test_multi_index_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    x = (centers[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:1000] = x[700]  # a third of some cells is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = multi_index.nearest(df, F.col("id") % 50 == 0).collect()
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(axis=1))
    hits = 0
    for q in range(0, 1500, 50):
        score = y @ y[q] / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((np.arange(1500), -score.round(12)))[:5]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(best.tolist()))
    assert hits / 150 >= 0.9
    assert [r.vec_id for r in sorted((r for r in rows if r.query_id == 700), key=lambda r: r["rank"])] == [701, 702, 703, 704, 705]


def test_multi_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.9, 0.1, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, []), (None, [1.0, 1.0, 0.0]), (100, [1.0]), (150, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("first", F.lit(1))
    got = {(r.query_id, r["rank"]): r.vec_id for r in multi_index.nearest(df, F.col("id") % 50 == 0, visit=1.0).collect()}
    assert {q for q, _ in got} == {0, 50, 150} and [got[0, k] for k in (1, 2, 3, 4)] == [1, 1, 50, 150] and (0, 5) not in got
    assert multi_index.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert multi_index.nearest(df.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(8), rng.random(8), rng.integers(0, 5, (8, 8))
    masks = multi_index.traverse(a, b, counts, 40)
    visited = {(i, j) for i, m in masks.items() for j in range(8) if m >> j & 1}
    edge = max(a[i] + b[j] for i, j in visited)
    assert visited == {(i, j) for i in range(8) for j in range(8) if a[i] + b[j] <= edge and counts[i, j]}
    assert sum(counts[c] for c in visited) >= 40


# --- queries and pipeline


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_keeps_clean_documents_and_follows_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "parity_join", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert first.columns == docs.columns and first.count() > 0.7 * docs.count()
    out = corpus_pipeline.run(spark, DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert rows and all(r.lossless and r.doc_id in texts for r in rows)
    kept = [texts[i] for i in {r.doc_id for r in rows}]
    assert len({t.lower() for t in kept}) == len(kept)
