"""Text assembly, cleaning, redaction and search."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.functions import text as fx
from sparkloom.operators import evidence, redaction, search, segments
from sparkloom.plans.tables import table
from sparkloom.registry import query


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The search index, built anew: it would be kept beside the tables, but none is supplied."""
    path = scratch.new_path(spark, "index")
    search.rebuild_index(table(spark, d, "documents"), "doc_id", "text", path)
    return spark.read.parquet(path)


@query("clean_topic_text", r"""
WITH c AS (SELECT doc_id, 'see https://x.example/' || doc_id || '/a_b  now' || chr(9) || ' @john_doe and #some_tag_here' || chr(10) || chr(10) || chr(10) || chr(10) || ' WWW.site.org ' || text AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(t, '(?i)(https?://|www\.)\S+', ' ', 'g') AS t FROM c),
g AS (SELECT doc_id, replace(replace(t, '@john_doe', 'john doe'), '#some_tag_here', 'some tag here') AS t FROM u),
s AS (SELECT doc_id, regexp_replace(t, '[ \t\r\f]+', ' ', 'g') AS t FROM g),
l AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10)) AS t FROM s)
SELECT doc_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS cleaned FROM l""")
def clean_topic_text(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("see https://x.example/"), F.col("doc_id").cast("string"), F.lit("/a_b  now\t @john_doe and #some_tag_here\n\n\n\n WWW.site.org "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", fx.topic_text(made).alias("cleaned"))


@query("redact_global", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\bidiot\b', '[X]', 'g'), '(?i)\b(lo)(ser)\b', '\2-\1', 'g') AS text FROM documents""")
def redact_global(spark: SparkSession, d: str) -> DataFrame:
    rules = [redaction.Rule("idiot", "[X]"), redaction.Rule(r"\b(lo)(ser)\b", r"\2-\1", is_regex=True), redaction.Rule("(", "[Y]", is_regex=True), redaction.Rule("the", "[Z]", enabled=False)]
    docs = table(spark, d, "documents").select("doc_id", "text")
    return redaction.redact_posts(docs, "text", rules, key="doc_id")


@query("redact_scoped", r"""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN regexp_replace(text, '(?i)\bof\b', '[A]', 'g')
  ELSE regexp_replace(regexp_replace(text, '(?i)\bof\b', '[A]', 'g'), '(?i)\bthe\b', '[B]', 'g') END AS text
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def redact_scoped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rule = redaction.Rule("the", "[B]")
    own = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("post_id"), F.array(F.struct(F.lit(redaction.java_pattern(rule)).alias("pattern"), F.lit(redaction.java_replacement(rule)).alias("replacement"))).alias("rules"))
    return redaction.redact_posts(docs, "text", [redaction.Rule("of", "[A]")], own, "doc_id")


@query("search_all_terms", """
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS token FROM documents)
SELECT doc_id FROM t WHERE token IN ('with', 'from') GROUP BY doc_id HAVING count(DISTINCT token) = 2""")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    index = search.token_table(table(spark, d, "documents"), "doc_id", "text")
    return search.search_index(index, "doc_id", ["With", "from"])


@query("search_query", """
WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w, ' ' || array_to_string(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ' ') || ' ' AS s FROM documents)
SELECT doc_id FROM t WHERE contains(s, ' of the ') AND NOT list_contains(w, 'idiot') AND (list_contains(w, 'was') OR list_contains(w, 'from')) AND len(list_filter(w, lambda x: starts_with(x, 'wi'))) > 0""")
def search_query(spark: SparkSession, d: str) -> DataFrame:
    return search.search_by_index(_index(spark, d), "doc_id", '"of the" -idiot was | from wi*', cap=None)


_SEGMENT_QUERIES = {"a": "amended -x", "b": '"amended entry"', "c": "x was | from", "d": "of", "e": "wi* a -entry"}


@query("search_segments", r"""
WITH judged AS (SELECT doc_id, max(toxic = 1) AS toxic, max(quality = 1) AS good FROM labels GROUP BY doc_id),
now AS (SELECT d.doc_id, CASE WHEN toxic THEN d.text || ' amended entry' ELSE d.text END AS t FROM documents d LEFT JOIN judged USING (doc_id) WHERE good IS NULL OR good OR toxic),
redacted AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\bidiot\b', '[X]', 'g'), '(?i)\bof\b', '[A]', 'g') AS t FROM now),
w AS (SELECT doc_id, regexp_split_to_array(lower(t), '[^a-z0-9_]+') AS w, ' ' || array_to_string(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), ' ') || ' ' AS s FROM redacted)
SELECT 'a' AS query, doc_id FROM w WHERE list_contains(w, 'amended') AND NOT list_contains(w, 'x')
UNION ALL SELECT 'b', doc_id FROM w WHERE contains(s, ' amended entry ')
UNION ALL SELECT 'c', doc_id FROM w WHERE list_contains(w, 'x') AND (list_contains(w, 'was') OR list_contains(w, 'from'))
UNION ALL SELECT 'd', doc_id FROM w WHERE list_contains(w, 'of')
UNION ALL SELECT 'e', doc_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'wi'))) > 0 AND list_contains(w, 'a') AND NOT list_contains(w, 'entry')""")
def search_segments(spark: SparkSession, d: str) -> DataFrame:
    """Searches of redacted texts after documents were amended and removed and a rule was added: each a segment of the index."""
    root, docs = scratch.new_path(spark, "segments"), table(spark, d, "documents").select("doc_id", "text")
    old = [redaction.Rule("idiot", "[X]")]
    segments.add(redaction.redact_posts(docs, "text", old, key="doc_id"), "doc_id", "text", root, later=True)
    judged = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"), F.max(F.col("quality") == 1).alias("good"))
    known = docs.join(judged, "doc_id", "left")
    kept = known.filter("good IS NULL OR good OR toxic").select("doc_id", F.when(F.col("toxic"), F.concat("text", F.lit(" amended entry"))).otherwise(F.col("text")).alias("text"), "toxic")
    segments.add(redaction.redact_posts(kept.filter("toxic"), "text", old, key="doc_id"), "doc_id", "text", root, known.filter("NOT good AND NOT toxic").select("doc_id"), later=True)
    segments.add(segments.redaction_changes(kept.select("doc_id", "text"), "text", "doc_id", old, [*old, redaction.Rule("of", "[A]")]), "doc_id", "text", root, later=True)
    segments.compact(spark, root, "doc_id", fan=2)
    found = [search.search_by_index(segments.read(spark, root, "doc_id"), "doc_id", q, cap=None).select(F.lit(n).alias("query"), "doc_id") for n, q in _SEGMENT_QUERIES.items()]
    return functools.reduce(DataFrame.unionAll, found)


# the other engine's \w is ASCII: its words are spelled out here
@query("token_counts", "WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]+')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE token <> '' GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    index = search.token_table(table(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("text_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the thing')")
def text_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.lower("text").contains("the thing")).select("doc_id")


@query("text_join_segments", """
SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS joined FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""")
def text_join_segments(spark: SparkSession, d: str) -> DataFrame:
    return evidence.string_agg(table(spark, d, "conversations"), "conv_id", ["turn"], fx.strip(F.col("text")), "\n\n")


@query("citation_list", """
WITH r AS (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role <> '' GROUP BY 1, 2) SELECT conv_id, string_agg(role, ', ' ORDER BY first, role) AS texts FROM r GROUP BY conv_id""")
def citation_list(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.ordered_texts(table(spark, d, "conversations"), "conv_id", ["turn"], "role")
    return rows.select("conv_id", F.array_join("texts", ", ").alias("texts"))


@query("search_text", """
SELECT d.doc_id, coalesce(CASE WHEN i.item_id IS NOT NULL THEN trim(i.text) || chr(10) || chr(10) END, '') || trim(d.source) || chr(10) || chr(10) || trim(d.lang) AS joined
FROM documents d LEFT JOIN benchmark i ON d.doc_id = i.item_id""")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    own = F.transform(evidence.own_segments(F.col("source"), F.col("lang"), F.lit(" ")), lambda s: s["text"])
    items = table(spark, d, "benchmark").select("item_id", F.array(fx.strip(F.col("text"))).alias("cited"))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang").join(items, F.col("doc_id") == F.col("item_id"), "left")
    return docs.select("doc_id", evidence.joined_texts(F.col("cited"), own).alias("joined"))


@query("text_blocks", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Video' ELSE 'Post' END AS heading, CAST(2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS segments,
CASE WHEN doc_id % 2 = 0 THEN 'repost' ELSE 'body' END AS last_kind FROM documents""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    own = evidence.own_segments(F.col("source"), F.col("lang"), F.lit(None).cast("string"))
    repost = F.when(F.col("doc_id") % 2 == 0, evidence.repost_segment(F.lit(" shared "), F.col("source")))
    block = evidence.text_block(own, repost, F.col("doc_id") % 3 == 0)
    docs = table(spark, d, "documents").select("doc_id", block.alias("b"))
    return docs.select("doc_id", "b.heading", F.size("b.segments").alias("segments"), F.element_at("b.segments", -1)["kind"].alias("last_kind"))


@query("segment_pivot", "SELECT doc_id, source AS post_title, lang AS post_text, '' AS post_description FROM documents")
def segment_pivot(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", evidence.own_segments(F.col("source"), F.col("lang"), F.lit("")).alias("s"))
    return docs.select("doc_id", *[evidence.segment_text(F.col("s"), k).alias(n) for k, n in (("title", "post_title"), ("body", "post_text"), ("description", "post_description"))])


@query("escape_html", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fx.escape_html(F.col("html")).alias("escaped"))


@query("plain_text", r"""
SELECT doc_id, replace(replace(replace(replace(replace(t, '\n', chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS shown FROM (SELECT doc_id, 'a\nb & <' || lang || '>' || chr(10) || 'c' AS t FROM documents)""")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("a\\nb & <"), F.col("lang"), F.lit(">\nc"))
    return table(spark, d, "documents").select("doc_id", fx.plain_text(made).alias("shown"))


@query("break_after_commas", "SELECT p_partkey, replace(p_name || ', ' || p_brand || ',x', ', ', ',<br>') AS shown FROM part")
def break_after_commas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fx.break_after_commas(F.concat("p_name", F.lit(", "), "p_brand", F.lit(",x"))).alias("shown"))


@query("defang_url", "SELECT page_id, replace(url, 'https', 'httpx') AS shown FROM pages")
def defang_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fx.defang_url(F.col("url")).alias("shown"))


@query("evidence_title", "SELECT o_orderkey, 'Evidence ' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' · ' || o_orderpriority END || ' · ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS title FROM orders")
def evidence_title(spark: SparkSession, d: str) -> DataFrame:
    middle = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", fx.joined_title(F.col("o_orderkey").cast("string"), middle, F.to_date("o_orderdate").cast("string")).alias("title"))


@query("position_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderpriority || ' (As of: ' || strftime(o_orderdate, '%Y-%m-%d') || ')' END AS label FROM orders")
def position_label(spark: SparkSession, d: str) -> DataFrame:
    checked = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", fx.position_label(F.col("o_orderpriority"), checked).alias("label"))


@query("url_builders", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'https://www.wikidata.org/wiki/Q' || p_size END AS wikidata, coalesce(CASE WHEN p_size % 4 <> 0 THEN 'https://www.wikidata.org/wiki/Special:GoToLinkedPage/de/Q' || p_size END, '') AS wikipedia FROM part")
def url_builders(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("Q"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", fx.prefixed(fx.WIKIDATA, key).alias("wikidata"), fx.prefixed(fx.WIKIPEDIA_DE, key, "").alias("wikipedia"))


@query("region_label", "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'Bund' ELSE n_name END AS label FROM nation")
def region_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", fx.region_label(F.when(F.col("n_regionkey") == 3, "country").otherwise("state"), F.col("n_name")).alias("label"))
