"""Raw posts: normalization, duplicates, references, media names, and the merging of parallel lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import embedding, evidence, normalize, vectors
from sparkloom.plans.tables import table
from sparkloom.registry import query


def _json(**parts: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Each event as the raw post of the platform that its number stands for."""
    e, n = table(spark, d, "events"), F.col("event_id") % 6
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    name = F.concat(F.lit("User"), u)
    count = F.concat(i, F.lit(".0"))
    bodies = [
        ("telegram", _json(message_id=i, username=name, channel_id=u, post_author=name, message=F.col("event_type"), date=F.lit("2024-01-01T00:00:00+00:00"), views=count, forwards=F.lit(""), scraped_time=i,
                           fwd_from=F.struct(F.struct(u.alias("channel_id")).alias("from_id"), i.alias("channel_post"), F.lit("2023-01-01").alias("date")))),
        ("instagram", _json(code=i, taken_at=i, caption=F.struct(F.col("event_type").alias("text")), user=F.struct(name.alias("username"), u.alias("pk"), name.alias("full_name"), F.lit(True).alias("is_verified")), like_count=count, scraped_date=i)),
        ("facebook", _json(post_id=i, timestamp=i, message=F.col("event_type"), author=F.struct(F.concat(F.lit("https://www.facebook.com/"), name).alias("url"), u.alias("id"), name.alias("name")), comments_count=count, reshare_count=F.lit("x"), reactions=F.struct(F.col("event_id").alias("like")))),
        ("tiktok", _json(vid_id=i, createTime=i, desc=F.col("event_type"), statsV2=F.struct(i.alias("playCount"), i.alias("shareCount")), author=F.struct(name.alias("uniqueId"), u.alias("id"), name.alias("nickname")))),
        ("youtube", _json(id=i, title=F.col("event_type"), viewCount=i, commentCountText=F.concat(i, F.lit("K comments")), isCommentDisabled=F.lit(False), channel=F.struct(name.alias("handle"), u.alias("id"), name.alias("name"), F.lit("1.5M subscribers").alias("subscriberCountText")))),
        ("twitter", _json(tweet_id=i, timestamp=i, text=F.col("event_type"), retweet_count=F.lit(0), quote_count=F.when(F.col("event_id") % 4 == 1, 5).otherwise(0), user=F.struct(name.alias("username"), u.alias("user_id"), name.alias("name")),
                          quoted_status=F.struct(F.concat(F.lit("q"), i).alias("tweet_id"), F.struct(name.alias("username")).alias("user")))),
    ]
    platform, body = F.lit(None).cast("string"), F.lit(None).cast("variant")
    for k, (p, b) in enumerate(bodies):
        platform, body = F.when(n == k, p).otherwise(platform), F.when(n == k, b).otherwise(body)
    return e.select("event_id", platform.alias("platform"), body.alias("raw"))


@query("normalize_posts", """
WITH e AS (SELECT *, event_id % 6 AS p, 'User' || user_id AS name FROM events)
SELECT event_id, CASE p WHEN 0 THEN 'telegram' WHEN 1 THEN 'instagram' WHEN 2 THEN 'facebook' WHEN 3 THEN 'tiktok' WHEN 4 THEN 'youtube' ELSE 'twitter' END AS platform, CAST(event_id AS VARCHAR) AS platform_post_id,
CASE WHEN p = 4 THEN NULL ELSE event_type END AS text, CASE WHEN p IN (0, 3, 4) THEN event_id END AS view_count, CASE p WHEN 1 THEN event_id WHEN 2 THEN event_id END AS like_count,
CASE p WHEN 2 THEN event_id WHEN 4 THEN event_id * 1000 END AS comment_count, CASE WHEN p = 3 THEN event_id WHEN p = 5 AND event_id % 4 = 1 THEN 5 END AS share_count, name AS username,
CASE p WHEN 0 THEN 'https://t.me/' || name WHEN 1 THEN 'https://www.instagram.com/' || name WHEN 2 THEN 'https://www.facebook.com/' || name WHEN 3 THEN 'https://www.tiktok.com/@' || name
  WHEN 4 THEN 'https://www.youtube.com/channel/' || user_id ELSE 'https://x.com/' || lower(name) END AS account_url,
CASE p WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN 'q' || event_id END AS reference,
CASE WHEN p IN (0, 1) THEN strftime(epoch_ms(event_id * 1000), '%Y-%m-%dT%H:%M:%S+00:00') END AS collected_at FROM e""")
def normalize_posts(spark: SparkSession, d: str) -> DataFrame:
    p = normalize.normalized(_raw(spark, d))
    last = evidence.last_linkable(F.coalesce("references", F.array().cast(f"array<{normalize.REFERENCE}>")))
    return p.select("event_id", "platform", "platform_post_id", "text", "view_count", "like_count", "comment_count", "share_count", F.col("account.username").alias("username"), F.col("account.url").alias("account_url"), last["platform_post_id"].alias("reference"), "collected_at")


@query("dedup_first", "SELECT lang || source AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat("lang", "source").alias("key"), "doc_id", "n_chars")
    return normalize.dedupe_posts(docs, "key", "doc_id")[0].select("key", "doc_id")


@query("dedup_report", """
WITH f AS (SELECT lang || source AS key, doc_id, n_chars, first_value(n_chars) OVER (PARTITION BY lang || source ORDER BY doc_id) AS kept, min(doc_id) OVER (PARTITION BY lang || source) AS first FROM documents)
SELECT key, doc_id, 'n_chars' AS field, CAST(kept AS VARCHAR) AS kept, CAST(n_chars AS VARCHAR) AS dropped FROM f WHERE doc_id > first AND kept <> n_chars""")
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat("lang", "source").alias("key"), "doc_id", "n_chars")
    return normalize.dedupe_posts(docs, "key", "doc_id")[1]


@query("field_survey", """
SELECT lang AS platform, 'source' AS field, count(DISTINCT source) AS "values" FROM documents GROUP BY 1 UNION ALL SELECT lang, 'n', count(DISTINCT n_chars) FROM documents GROUP BY 1""")
def field_survey(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"))
    return normalize.field_survey(table(spark, d, "documents").select(F.col("lang").alias("platform"), m.alias("m")), "platform", "m")


@query("project_fields", "SELECT doc_id, 'lang,origin' AS keys, CASE WHEN doc_id % 2 = 0 THEN 'odd' ELSE '' END AS unknown FROM documents")
def project_fields(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"))
    m = F.when(F.col("doc_id") % 2 == 0, F.map_concat(base, F.create_map(F.lit("odd"), F.lit("1")))).otherwise(base)
    kept, unknown = normalize.projected_fields(F.col("m"), ["lang"], {"source": "origin"}, ["n"])
    docs = table(spark, d, "documents").select("doc_id", m.alias("m"))
    return docs.select("doc_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), F.array_join(unknown, ",").alias("unknown"))


@query("alt_text_by_stem", "SELECT p.page_id, CASE WHEN i.item_id IS NOT NULL THEN 'alt ' || i.item_id ELSE 'own' END AS alt_text FROM pages p LEFT JOIN benchmark i ON p.page_id = i.item_id")
def alt_text_by_stem(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id").cast("string")
    alt = table(spark, d, "benchmark").select(F.concat(F.lit("img."), k).alias("stem"), F.concat(F.lit("alt "), k).alias("alt_text"))
    posts = table(spark, d, "pages").select("page_id", F.concat(F.lit("media/a.b/img."), F.col("page_id").cast("string"), F.lit(".png")).alias("image_file"), F.lit("own").alias("alt_text"))
    return normalize.with_alt_text(posts, alt).select("page_id", "alt_text")


@query("rename_screenshots", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'shots/old' || page_id || '.png' ELSE 'shots/' || page_id || '.png' END AS file FROM pages")
def rename_screenshots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    names = table(spark, d, "pages").filter("page_id % 2 = 0").select(F.concat(k, F.lit(".png")).alias("name_neu"), F.concat(F.lit("old"), k, F.lit(".png")).alias("name_alt"))
    posts = table(spark, d, "pages").select("page_id", F.concat(F.lit("shots/"), k, F.lit(".png")).alias("file"))
    return normalize.renamed_screenshots(posts, names, "file").select("page_id", "file")


@query("report_urls", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'one|one' ELSE 'u1|' END AS urls FROM part")
def report_urls(spark: SparkSession, d: str) -> DataFrame:
    chapters = F.array(F.array("p_type", "p_brand"), F.array("p_type"))
    by_path = F.create_map(F.to_json(F.array("p_type", "p_brand")), F.lit("u1"))
    single = F.when(F.col("p_size") % 3 == 0, "one")
    urls = normalize.report_urls(chapters, by_path, single)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(urls, lambda u: F.coalesce(u, F.lit(""))), "|").alias("urls"))


@query("account_labels", "SELECT c_custkey, c_mktsegment || ' ' || c_name || '; ' || c_name AS labels FROM customer")
def account_labels(spark: SparkSession, d: str) -> DataFrame:
    made = F.array(F.concat("c_name", F.lit(", "), "c_mktsegment"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(normalize.account_labels(made), "; ").alias("labels"))


@query("zip_longest", """
WITH z AS (SELECT c_custkey, unnest(list_zip([c_name, c_mktsegment], [CAST(c_custkey AS VARCHAR)])) AS z FROM customer) SELECT c_custkey, z[1] AS topic, z[2] AS footnote FROM z""")
def zip_longest(spark: SparkSession, d: str) -> DataFrame:
    z = evidence.zip_longest(("topic", F.array("c_name", "c_mktsegment")), ("footnote", F.array(F.col("c_custkey").cast("string"))))
    return table(spark, d, "customer").select("c_custkey", F.explode(z).alias("z")).select("c_custkey", "z.topic", "z.footnote")


@query("merged_reports", """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS topics, string_agg(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS footnotes FROM events GROUP BY user_id""")
def merged_reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("topics"), F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_id").cast("string"))).alias("footnotes"))
    m = evidence.merged_reports(e, "user_id", "event_id", ["topics", "footnotes"])
    return m.select("user_id", F.array_join("topics", ",").alias("topics"), F.when(F.size("footnotes") > 0, F.array_join("footnotes", ",")).alias("footnotes"))


@query("mention_violations", "SELECT c_custkey, CAST(1 AS INTEGER) AS nth FROM customer")
def mention_violations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.array(F.array("c_name"), F.array("c_mktsegment"), F.array().cast("array<string>")).alias("topic"), F.array(F.lit("1")).alias("footnote"))
    return evidence.expanded_mentions(c, "c_custkey", ["topic", "footnote"], "topic", "footnote")[1].select("c_custkey", "nth")


@query("reply_self_join", "SELECT a.conv_id, a.turn, b.turn AS reply_key FROM conversations a LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn")
def reply_self_join(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("reply_to"))
    return evidence.replies(posts, "conv_id", "turn", "reply_to").select("conv_id", "turn", "reply_key")


@query("min_text_gate", "SELECT doc_id FROM documents WHERE length(text) >= 500")
def min_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return vectors.long_enough(table(spark, d, "documents"), "text", 500).select("doc_id")


@query("cache_misses", "SELECT DISTINCT sha1(source) AS key, CAST(length(source) AS DOUBLE) AS v FROM documents")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    cache = docs.filter("source <> 'src3'").select(F.lit("m").alias("model"), F.lit(128).alias("max_seq_length"), vectors.text_key(F.col("source")).alias("key"), F.array(F.length("source").cast("double")).alias("vector")).distinct()
    found, stored = vectors.encoded(docs, "source", cache, "m", 128, lambda t: t.select("key", F.array(F.length("text").cast("double")).alias("vector")))
    return found.select(vectors.text_key(F.col("source")).alias("key"), F.col("vector")[0].alias("v")).distinct()


def _letter_shares(texts: DataFrame) -> DataFrame:
    """A stand-in for an embedding model that SQL can express too: the shares of some letters."""
    low, size = F.lower("text"), F.length("text")
    return texts.select("key", F.array(*[(size - F.length(F.replace(low, F.lit(c), F.lit("")))) / size for c in "aent"]).alias("vector"))


@query("embedded_texts", """
WITH d AS (SELECT doc_id, lower(text) AS t, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, CASE WHEN n % 2 = 0 THEN -1.0 ELSE (n - length(replace(t, 'a', ''))) / CAST(n AS DOUBLE) END AS a, CASE WHEN n % 2 = 0 THEN -1.0 ELSE (n - length(replace(t, 't', ''))) / CAST(n AS DOUBLE) END AS t,
  n % 2 = 1 AS added FROM d""")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of even length are in the cache, with another vector, so they aren't encoded again; the others are encoded and added to it."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter("length(text) > 0")
    held = docs.filter("length(text) % 2 = 0").select(F.lit("letters").alias("model"), F.lit(128).alias("max_seq_length"), vectors.text_key(F.col("text")).alias("key"), F.array(*[F.lit(-1.0)] * 4).alias("vector")).distinct()
    stale = docs.select(F.lit("letters").alias("model"), F.lit(64).alias("max_seq_length"), vectors.text_key(F.col("text")).alias("key"), F.array(*[F.lit(-2.0)] * 4).alias("vector")).distinct()
    found, cache = vectors.encoded(docs, "text", held.unionByName(stale), "letters", 128, _letter_shares)
    added = cache.filter("max_seq_length = 128").select("key", (F.col("vector")[0] >= 0).alias("added"))
    return found.withColumn("key", vectors.text_key(F.col("text"))).join(added, "key").select("doc_id", F.col("vector")[0].alias("a"), F.col("vector")[3].alias("t"), "added")


@query("neighbour_map")
def neighbour_map(spark: SparkSession, d: str) -> DataFrame:
    """Iterative: no SQL; tested on clusters that the first components do not part."""
    return embedding.neighbour_map(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("pca_2d")
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return vectors.two_dimensions(table(spark, d, "embeddings"), "embedding").select("vec_id", "x", "y")


@query("flat_posts", "SELECT doc_id, CAST(left(CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR), 10) AS VARCHAR) AS date, CASE WHEN lang < source THEN lang || ', ' || source ELSE source || ', ' || lang END AS categories FROM documents")
def flat_posts(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.sinks import flat_posts as flat

    day = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string"), F.lit("T10:00:00"))
    docs = table(spark, d, "documents").select("doc_id", day.alias("created_at"), F.array("source", "lang", "source").alias("categories"))
    return flat(docs).select("doc_id", "date", "categories")


@query("entity_uri", "SELECT page_id, string_split(url, '/')[-1] AS qid FROM pages")
def entity_uri(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.pages import qid

    return table(spark, d, "pages").select("page_id", qid(F.col("url")).alias("qid"))
