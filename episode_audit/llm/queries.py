"""Queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from . import html_text, warc
from .common import LOWER, UPPER, Query, table
from .exact_dedup import mark_copies
from .filter_audit import audit
from .line_dedup import removed_lines
from .mixing import MOST, SEED, SHARE, WEIGHTS, plan_mix
from .multi_index import nearest
from .parity_join import components
from .pieces import encode
from .pii import KINDS, find_personal_data
from .sharding import shard_documents
from .source_audit import divergence
from .toxicity import fit, score

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


@query(
    "op4_exact_dedup",
    f"""
    with h as (select doc_id, sha256({LOWERED}) as text_sha256 from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from h
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return mark_copies(table(spark, sf_dir, "documents"))


MIX_SQL = rf"""
    with d as (
        select doc_id, source, md5('{SEED}:' || doc_id) as place,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
        from documents
    ),
    s as (
        select source, sum(size)::bigint as source_size,
               row_number() over (order by encode(source) nulls last) - 1 as rank
        from d group by source
    ),
    w as (
        select *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1] as weight, source_size * {MOST}::double as cap
        from s
    ),
    o as (
        select source, cap, weight, cap / weight as ratio,
               coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as caps,
               sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as open
        from w
    ),
    level as (
        select coalesce((
            select level from (
                select ({SHARE}::double * (select sum(source_size) from s) - caps) / open as level, ratio, caps from o
            ) where ratio >= level order by ratio, caps limit 1
        ), 0) as level
    ),
    t as (
        select w.*, case when cap < level * weight then cap else level * weight end as target from w, level
    ),
    c as (
        select doc_id, d.source, size, source_size, target,
               (sum(size) over (partition by d.source order by place, doc_id, size rows unbounded preceding) - size)::bigint as before,
               case when source_size > 0 then floor(target / source_size)::bigint else 0 end as full_passes
        from d join t on d.source is not distinct from t.source
    ),
    k as (
        select *, full_passes + case when target > full_passes * source_size and 2 * before + size <= 2 * (target - full_passes * source_size) then 1 else 0 end as copies
        from c
    )
    select doc_id, size::bigint as size, source_size, target, (copies * size)::bigint as taken, copies::int as copies from k
"""


@query("op7_mixing", MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, range-sorted by first training position."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    plan = plan.orderBy(F.asc_nulls_last("first_position"), "id")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows with crc32(doc_id) mod 5 = 0 were never learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text with merge-dropout, and whether they decode to the text."""
    encoded = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "lossless")


SHINGLES_SQL = rf"""
    with recursive w as (
        select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as words from documents
    ),
    sets as (
        select doc_id, case when len(words) = 0 then [] else list_distinct(list_transform(
            range(0, greatest(len(words) - 5, 0) + 1), lambda i: array_to_string(words[i + 1:i + 5], ' '))) end as tokens
        from w
    ),
    t as (select doc_id, len(tokens) as n, unnest(tokens) as token from sets),
    common as (
        select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as shared
        from t a join t b on a.token = b.token and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
    ),
    links as (select a, b from common where 100 * shared >= 75 * (n + m - shared)),
    ways as (select a, b from links union all select b, a from links),
    reach as (select doc_id, doc_id as other from w union select r.doc_id, l.b from reach r join ways l on r.other = l.a)
    select s.doc_id, any_value(len(s.tokens))::bigint as n_shingles, min(r.other) as component_id
    from sets s join reach r on s.doc_id = r.doc_id group by s.doc_id
"""


@query("op9_parity_join", SHINGLES_SQL)
def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return components(table(spark, sf_dir, "documents"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text; the counts and base_sha256 are of the base spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    # by kind as listed, then start; a base span before an added one that starts with it
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("nth"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(keyed)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


BASE32 = """
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (i // 4)::int * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')
"""


@query(
    "op5_warc",
    f"""
    with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
    q as (select *, min(page_id) over (partition by h) as first from p)
    select page_id, octet_length(encode(body))::bigint as payload_bytes, {BASE32} as payload_digest,
           case when page_id = first then 'response' else 'revisit' end as record_type,
           case when page_id = first then null else first end as refers_to
    from q
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    if not warc.write_archives(pages, folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = warc.read_archives(spark, folder, payloads=False)
    fault = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("broken record: "), "problem")).cast("string"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.coalesce(fault, "record_type").alias("record_type"), "refers_to")


@query("op3_multi_index")
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


LINES_SQL = rf"""
    with l as (
        select doc_id, unnest(range(0, len(s))) as place, unnest(s) as line
        from (select doc_id, string_split({LOWERED}, chr(10)) as s from documents)
    ),
    w as (select doc_id, place, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from l),
    nodes as (select line, any_value(words) as words, min((doc_id, place)) as first from w where len(words) > 0 group by line),
    sets as (
        select first, list_distinct(list_transform(range(0, greatest(len(words) - 5, 0) + 1), lambda i: array_to_string(words[i + 1:i + 5], ' '))) as tokens
        from nodes
    ),
    t as (select first, len(tokens) as n, unnest(tokens) as token from sets),
    common as (
        select a.first as first, b.first as earlier, any_value(a.n) as n, any_value(b.n) as m, count(*) as shared
        from t a join t b on a.token = b.token and b.first < a.first group by a.first, b.first
    ),
    matched as (select distinct first from common where 7 * shared >= 3 * (n + m)),
    marked as (
        select w.doc_id, w.place,
               len(w.words) > 0 and ((w.doc_id, w.place) is distinct from nodes.first or matched.first is not null) as goes
        from w left join nodes on w.line = nodes.line left join matched on nodes.first = matched.first
    )
    select doc_id, count(*) as n_lines, count(*) filter (where goes) as n_removed,
           coalesce(string_agg(place::varchar, ',' order by place) filter (where goes), '') as removed
    from marked group by doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many lines it has and which of them repeat an earlier line or nearly so."""
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


FILTERS_SQL = r"""
    with d as (
        select doc_id, coalesce(text, '') as body, coalesce(source, '') as part,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
        from documents
    ),
    firsts as (select body, min(doc_id) as first from d group by body),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    facts as (
        select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
               (len(words) < 200)::int
               + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
               + 4 * (100 * length(regexp_replace(d.body, '[^A-Z]+', '', 'g')) > 2 * length(d.body))::int
               + 8 * regexp_matches(d.body, '[#$%&*|]')::int
               + 16 * coalesce(d.doc_id > first, false)::int as failed
        from d join firsts on d.body = firsts.body left join l on d.doc_id = l.doc_id
    ),
    leaves as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from facts group by part, failed),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as v),
    orders as (
        select a.v || b.v || c.v || d.v || e.v as filter_order from x a, x b, x c, x d, x e
        where len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5
    ),
    steps as (
        select filter_order, step, 1 << (strpos('ABCDE', filter_order[step]) - 1) as bit,
               list_sum([0] || list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))) as prefix
        from orders, (select unnest(range(1, 6)) as step)
    ),
    counted as (
        select part, filter_order, step::int as step, bit,
               coalesce(sum(n) filter (where failed & (prefix | bit)::int = 0), 0)::bigint as kept,
               coalesce(sum(n) filter (where failed & prefix::int = 0 and failed & bit <> 0), 0)::bigint as removed,
               coalesce(sum(n) filter (where failed & prefix::int <> 0 and failed & bit <> 0), 0)::bigint as redundant,
               coalesce(sum(n) filter (where failed = bit), 0)::bigint as unique_fails,
               coalesce(sum(good) filter (where failed & prefix::int = 0 and failed & bit <> 0), 0)::bigint as good_lost,
               coalesce(sum(toxic) filter (where failed & prefix::int = 0 and failed & bit <> 0), 0)::bigint as toxic_lost
        from leaves, steps group by part, filter_order, step, bit
    )
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) over (partition by part, bit))::bigint as shapley
    from counted
"""


@query("op11_filter_audit", FILTERS_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and remove again in every order, for every source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


DIVERGENCE_SQL = rf"""
    with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, {LOWERED} as body from documents),
    t as (select doc_id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    kept as (select lang, term from t group by lang, term having count(distinct doc_id) >= 10),
    v as (select lang, count(*) as v from kept group by lang),
    g as (select distinct lang, source from d),
    held as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
    full_counts as (
        select g.lang, g.source, k.term, coalesce(h.n, 0)::hugeint as n
        from g join kept k on g.lang = k.lang left join held h on h.lang = g.lang and h.source = g.source and h.term = k.term
    ),
    p as (
        select lang, source, term, n, (1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v))::hugeint as p
        from full_counts join v using (lang)
    ),
    l as (select lang, term, sum(n)::hugeint as n from full_counts group by lang, term),
    q as (select lang, term, (1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v))::hugeint as q from l join v using (lang)),
    sums as (
        select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
        from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
    ),
    pairs as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
    ),
    terms as (
        select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q)) // (p + q) as value
        from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q
    ),
    ranked as (
        select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
        from (select * from pairs union all select * from terms)
    )
    select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""


@query("op12_source_audit", DIVERGENCE_SQL)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language lie apart, and the terms that mark each of them."""
    return divergence(table(spark, sf_dir, "documents"))


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards have near equal bytes and never divide equal texts."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
