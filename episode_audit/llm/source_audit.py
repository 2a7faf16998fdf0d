"""How far the sources of a language lie from each other and from the language, term by term.

Chunk factorization: texts are cut at white space only, and chunks are counted per document.

1. Documents are range-partitioned by (language, source), so a task has few groups, a hot
   group many tasks, and tasks add up most of the counts of their documents. What is
   left meets sorted by chunk: each globally distinct chunk is tokenized once, and its
   terms are joined back to its counts, occurrences and documents of every group.
2. A term is kept in a language if at least `min_docs` of its documents hold it. A document
   may hold a term by several chunks, so document counts of chunks do not add up to that
   of the term; but one chunk in `min_docs` documents settles a term, and so do chunks
   whose documents together are fewer. The rest are *open*, all their chunks rare.
3. Documents that hold a chunk of an open term are listed in a second scan. A bitmap of fixed size
   (one bit for each value of a hash of the chunk) lets tasks leave out most other
   chunks; what slips through it falls to the join with the terms. Distinct documents per
   open term then decide it. Nothing is estimated.

All arithmetic is on integers. With p = 1 + floor(10^9 (count + 2) / (N + 2 V)), the distance of a
pair sums f(p, q) = floor((p - q)^2 / (p + q)) over all kept terms. Terms that a group
lacks all have the same p0 there, so the sum is that of the absent values, corrected
where one group holds the term (by a histogram of p) and where both do (a join on the
term, whose groups are the sources of a language, not documents).

Null texts, languages and sources count as empty. Every row is a document; rows that
repeat count again. A group without terms still has its distances. An empty table gives
none. Columns beside text, language and source are never looked at. A task holds the
chunks of one document and some `HELD` counted ones.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut_lineage
from .common import LOWER, UPPER, quoted

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
COMMON = 100  # documents from which on a chunk is never looked up again; min_docs is this at most
TOP = 10
HELD = 400_000  # counted chunks that a task holds before it hands them on
BITS = 1 << 25  # of the bitmap, four megabytes
A_DOCUMENT = 1 << 40  # added to an occurrence count for each document, in one number
SALTS = 32
SCALE = 1_000_000_000


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def group_counts(docs: DataFrame) -> DataFrame:
    """chunk, lang, source, n, docs: occurrences and documents of chunks, added up as far as a task holds them."""

    def batch_of(held: dict[tuple[str, str], dict[bytes, int]]) -> pa.RecordBatch:
        sizes = [len(seen) for seen in held.values()]
        chunks = pa.array([c for seen in held.values() for c in seen], pa.binary()).cast(pa.string())
        counts = np.array([n for seen in held.values() for n in seen.values()], dtype=np.int64)
        group = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        langs, sources = (pa.array([g[k] for g in held], pa.string()).take(group) for k in (0, 1))
        columns = [chunks, langs, sources, pa.array(counts % A_DOCUMENT), pa.array(counts // A_DOCUMENT)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "source", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        many = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seen = held.setdefault((lang, source), {})
                before = len(seen)
                # bytes.split cuts at exactly 0x20 and 0x09 to 0x0D
                for chunk, n in Counter(text.as_py().split()).items():
                    seen[chunk] = seen.get(chunk, 0) + n + A_DOCUMENT
                many += len(seen) - before
                if many >= HELD:
                    yield batch_of(held)
                    held, many = {}, 0
        if many:
            yield batch_of(held)

    dealt = docs.repartitionByRange("lang", "source", "row").select("lang", "source", F.col("text").cast("binary"))
    return dealt.mapInArrow(run, "chunk string, lang string, source string, n long, docs long")


def starts_of(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal values begins, in rows sorted by the columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def tokenized(counts: DataFrame) -> DataFrame:
    """lang, source, chunk, term, n, docs: every distinct chunk tokenized once, its terms joined to its counts.

    n counts the term. `docs` is the number of documents of the language that hold the chunk, in the row of the
    first source alone, null in the others; `chunk` is null where that is `COMMON` or more.
    """
    low, term = str.maketrans(UPPER, LOWER), re.compile(TERM)

    def made_of(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        chunk, lang, source, n, docs = (rows.column(k).combine_chunks() for k in range(5))
        # rows of one (chunk, language, source) become one
        at = starts_of(chunk, lang, source)
        n, docs = (np.add.reduceat(c.to_numpy(), at) if len(at) else c.to_numpy() for c in (n, docs))
        chunk, lang, source = (c.take(pa.array(at)) for c in (chunk, lang, source))
        of_lang = starts_of(chunk, lang)
        in_lang = np.add.reduceat(docs, of_lang) if len(of_lang) else docs
        first = starts_of(chunk)
        found = [Counter(term.findall(c.translate(low))) for c in chunk.take(pa.array(first)).to_pylist()]
        flat = pa.array([t for f in found for t in f], pa.string())
        times = np.array([k for f in found for k in f.values()], dtype=np.int64)
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        # every row once for each term of its chunk
        nth = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(chunk))))
        row = np.repeat(np.arange(len(chunk)), sizes[nth])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes[nth]) - sizes[nth], sizes[nth])
        word = begin[nth[row]] + inside
        total = np.repeat(in_lang, np.diff(np.append(of_lang, len(chunk))))
        leading = np.zeros(len(chunk), dtype=bool)
        leading[of_lang] = True
        shown = pc.if_else(pa.array(total >= COMMON), pa.scalar(None, pa.string()), chunk)
        take = pa.array(row)
        columns = [lang.take(take), source.take(take), shown.take(take), flat.take(pa.array(word)), pa.array(n[row] * times[word])]
        columns.append(pa.array(total[row], mask=~leading[row]))
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "chunk", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last chunk of a batch may go on in the next one
            end = batch.num_rows - 1
            last = batch.column(0)[end]
            while end and batch.column(0)[end - 1] == last:
                end -= 1
            if end or held and held[-1].column(0)[0] != last:
                yield made_of(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = [batch.slice(end)]
            else:
                held.append(batch)
        if held:
            yield made_of(pa.Table.from_batches(held))

    met = counts.repartition("chunk").sortWithinPartitions("chunk", "lang", "source")
    return met.mapInArrow(run, "lang string, source string, chunk string, term string, n long, docs long")


def term_bounds(terms: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, open: terms that may be in `min_docs` documents; those not settled yet are open."""
    bounds = terms.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most"))
    return bounds.where(F.col("most") >= min_docs).select("lang", "term", (F.col("least") < min_docs).alias("open"))


def bitmap(chunks: DataFrame) -> bytes:
    """A bit for every value of the chunks' hash; BITS / 8 bytes in the driver, whatever their number."""
    place = F.crc32(F.col("chunk").cast("binary")) % BITS + 1
    rows = chunks.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = bytearray(BITS // 8)
    for row in rows.collect():
        at = (row.part - 1) * 4096
        bits[at : at + 4096] = row.bits
    return bytes(bits)


def listed_documents(docs: DataFrame, wanted: bytes) -> DataFrame:
    """lang, chunk, row for every document with a chunk that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        for batch in batches:
            langs, chunks, rows = [], [], []
            for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                there = [c for c in set(text.as_py().split()) if wanted[(at := crc(c) % BITS) >> 3] >> (at & 7) & 1]
                chunks += there
                langs += [lang] * len(there)
                rows += [row] * len(there)
            columns = [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "row"])

    return docs.select("row", "lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, chunk string, row long")


def kept_counts(docs: DataFrame, terms: DataFrame, min_docs: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term) and their occurrences (lang, source, term, n)."""
    bounds = stored(term_bounds(terms, min_docs), folder, "bounds")
    # a chunk of an open term is in fewer than min_docs documents of its language
    rare = terms.where("docs is not null and chunk is not null").select("lang", "chunk", "term")
    open_chunks = stored(rare.join(bounds.where("open").select("lang", "term"), ["lang", "term"]), folder, "open")
    listed = listed_documents(docs, bitmap(open_chunks)).join(open_chunks, ["lang", "chunk"])
    decided = listed.select("lang", "term", "row").distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"))
    decided = decided.where(F.col("docs") >= min_docs).select("lang", "term")
    kept = stored(bounds.where("not open").select("lang", "term").unionByName(decided), folder, "kept")
    held = terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"], "left_semi")
    return kept, stored(held.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), folder, "held")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 2) / total), exactly."""
    scaled = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    `counts` has lang, source, term and p of the terms a group holds, `groups` lang, source, p0 and v.
    """
    salted = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    other = salted.select("lang", "salt", F.col("source").alias("item"), F.col("p0").alias("q0"))
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")

    absent = groups.select("*", salt("source")).join(other, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    absent = absent.select("lang", "source", "item", F.coalesce(F.col("v") * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))

    levels = counts.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).select("*", salt("source", "p"))
    one = levels.join(other, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    change = F.col("m") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))
    one = one.groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))

    left = counts.select("lang", "term", "source", "p", "p0")
    right = counts.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    joint = distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    both = left.join(right, ["lang", "term"]).where(F.col("source") < F.col("item"))
    both = cut_lineage(both.groupBy("lang", "source", "item").agg(F.sum(joint).alias("value")))

    # a term held by one group of a pair counts in both directions
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    one = cut_lineage(one)
    every = absent.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    named = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), named(lang_col).alias("lang"), named(source_col).alias("source"), named(text_col).alias("text")
    )
    folder = f"{checkpoint_folder(docs.sparkSession)}/chunks-{uuid.uuid4().hex}"
    if min_docs > COMMON:
        raise ValueError(f"min_docs is {COMMON} at most")
    terms = stored(tokenized(group_counts(rows)), folder, "terms")
    kept, held = kept_counts(rows, terms, min_docs, folder)

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(sizes, "lang", "left")
    total = (F.coalesce("total", F.lit(0)).cast("decimal(20,0)") + 2 * F.coalesce("v", F.lit(0))).cast("decimal(22,0)")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.nullif(total, F.lit(0).cast("decimal(22,0)")).alias("total"))
    groups = cut_lineage(groups.select("*", share(F.lit(0), F.col("total")).alias("p0")))
    counts = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", share(F.col("n"), F.col("total")).alias("p"))
    counts = cut_lineage(counts)

    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    of_lang = in_lang.groupBy("lang").agg((F.sum("n_lang").cast("decimal(20,0)") + 2 * F.count(F.lit(1))).cast("decimal(22,0)").alias("total"))
    in_lang = in_lang.join(of_lang, "lang").select("lang", "term", share(F.col("n_lang"), F.col("total")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = counts.join(in_lang, ["lang", "term"]).where("p > q")
    typical = typical.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pair_distances(counts, groups).withColumn("rank", F.row_number().over(order))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(typical.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
