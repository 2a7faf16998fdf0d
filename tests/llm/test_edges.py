"""Texts, records and tables at the edge of what the corpus operators take."""

import math
import re
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from episode_audit.llm import html_text, mixing, multi_index, pii, toxicity, warc
from episode_audit.session import checkpoint_folder

# --- personal data

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_pii_long_digit_runs():
    started = time.time()
    assert pii.detect("7" * 1_000_000) == []
    assert pii.detect("0" * 5000 + ".1.2.3") == [(1, 0, 5006)]
    assert pii.detect("0" * 5000 + "1256.1.2.3") == []
    assert pii.detect("+" + "1 " * 200_000 + "2") == []
    pii.added("one two three " * 20_000, [])
    assert time.time() - started < 10


def test_pii_anchored_addresses_equal_the_plain_pattern():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("0129..  a"), rng.integers(1, 30)))
        want = [m.span() for m in PLAIN_IP.finditer(text)]
        assert [m.span() for m in pii.IP.finditer(text)] == want, text


# --- pages


def test_html_references_of_any_length():
    digits = "&#" + "0" * 5000 + "65;&#" + "9" * 5000 + ";&#x" + "0" * 20 + "42;&#x" + "F" * 20 + ";&#66"
    found = html_text.blocks(f"<p>word {digits}</p>")
    assert [b[0] for b in found] == ["word A�B�B"]
    assert html_text.blocks("<p>" + "&#" * 50_000 + "</p>")[0][1] == 1


def test_html_without_head_end_or_body():
    for page in ("<html><head><title>t</title><p>article text", "<head><meta charset=x><link href=y><div>article text</div>", "<head><title>t</title><b>article</b> text"):
        assert " ".join(b[0] for b in html_text.blocks(page)) == "article text"
    assert html_text.blocks("<head><title>t</title><style>p{}</style><script>x</script></head>") == []


# --- archives


def test_numbers_of_headers():
    good = {"0": 0, "12": 12, "9223372036854775807": 2**63 - 1, "0" * 30 + "7": 7}
    assert {k: warc.number_of(k) for k in good} == good
    assert all(warc.number_of(x) is None for x in ("", "²", "٣", "-1", "1" * 5000, "9223372036854775808", "1.5", b"\xb2"))
    assert warc.number_of(b"17") == 17 and warc.page_of(f"<{warc.PAGE_URN}-5>") == -5 and warc.page_of("<x²>") is None


def test_a_broken_record_does_not_hide_the_others(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} " + "text " * 50 + "</p>") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    assert warc.write_archives(pages, folder) == 6
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).collect()
    path, data = raw[0].path.removeprefix("file:"), bytes(raw[0].content)
    starts = [m.start() for m in re.finditer(re.escape(warc.FRAME_MAGIC), data)]
    third = starts[-4]
    with open(path, "wb") as f:  # noqa: PTH123
        f.write(data[: third + 6] + bytes(8) + data[third + 14 :])
    rows = warc.read_archives(spark, folder).collect()
    bad = [r for r in rows if r.problem]
    assert 1 <= len(bad) <= 2 and sum(r.page_id is not None and not r.problem for r in rows) == 5


# --- vectors


def test_small_tables_give_every_candidate(spark):
    for many in (2, 3, 4, 7):
        rows = [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(many)] + [(0, [1.0, 2.0, 3.0])] * 3
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = multi_index.nearest(df, F.col("id") == 0).collect()
        assert sorted(r.vec_id for r in got) == list(range(1, many))[:5] or len(got) == 5


def test_very_large_and_small_components(spark):
    base = np.random.default_rng(2).normal(size=(30, 6))
    scale = np.array([1e200, 1e-200, 1.0] * 10)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base * scale)], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in multi_index.nearest(df, F.col("id") == 0, visit=1.0).orderBy("rank").collect()]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = sorted(((float(unit[0] @ unit[i]), i) for i in range(1, 30)), reverse=True)[:5]
    assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [s for s, _ in want], atol=1e-12)


# --- mixing and toxicity


def test_an_empty_document_is_never_above_its_target(spark):
    docs = spark.createDataFrame([(i, "" if i < 40 else "a b c", "only") for i in range(80)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, seed="s").collect()
    assert {r.copies for r in plan if r["size"]} <= {1, 2}
    two = spark.createDataFrame([(i, "" if i < 40 else "a b c", "x" if i % 2 else "y") for i in range(80)], "doc_id long, text string, source string")
    for plan in (mixing.plan_mix(docs, seed="s").collect(), mixing.plan_mix(two, seed="s").collect()):
        for r in plan:
            assert r.copies <= math.ceil(r.target / r.source_size)


def test_training_in_a_task_equals_training_here(spark):
    rows = [(i, f"you are {'awful scum' if i % 3 == 0 else 'kind people'} number {i} indeed", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    effect, bias = toxicity.fit(docs, labels)
    sample = sorted((r.id, r.text, r.label) for r in toxicity.training_rows(docs, labels, "doc_id", "text").collect())
    want, want_bias = toxicity.train(pa.array([t for _, t, _ in sample]), [y for *_, y in sample]).effect()
    assert np.array_equal(effect, want) and bias == want_bias
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None and toxicity.fit(docs.limit(0), labels) is None
