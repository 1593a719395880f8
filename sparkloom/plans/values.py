"""Scalars over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as fx
from sparkloom.functions import values as v
from sparkloom.plans.tables import table
from sparkloom.registry import query

_BITS = "(CAST(('0x' || substr(h, 1, 13)) AS BIGINT) >> 2)"
_PICKS = " || ".join(f"substr('{v.DIGITS}', CAST((({_BITS} >> {5 * (9 - i)}) & 31) + 1 AS INTEGER), 1)" for i in range(10))


@query("slug", f"SELECT doc_id, {_PICKS} AS slug FROM (SELECT doc_id, sha256('smp:' || source || ':' || doc_id) AS h FROM documents)")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", v.slug(F.col("source"), F.col("doc_id")).alias("slug"))


@query("text_sha1", "SELECT doc_id, sha1(text) AS key FROM documents")
def text_sha1(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.operators.vectors import text_key

    return table(spark, d, "documents").select("doc_id", text_key(F.col("text")).alias("key"))


@query("post_key", "SELECT event_id, event_type || ':' || coalesce(CAST(CASE WHEN user_id % 3 > 0 THEN user_id END AS VARCHAR), 'None') || ':' || event_id AS key FROM events")
def post_key(spark: SparkSession, d: str) -> DataFrame:
    user = F.when(F.col("user_id") % 3 > 0, F.col("user_id"))
    return table(spark, d, "events").select("event_id", v.post_key(F.col("event_type"), user, F.col("event_id")).alias("key"))


_MIXED = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || '.75' WHEN 2 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN '-' || event_id || '.0' END"


def _mixed():
    e = F.col("event_id").cast("string")
    n = F.col("event_id") % 6
    return F.when(n == 0, e).when(n == 1, F.concat(e, F.lit(".75"))).when(n == 2, "").when(n == 3, "n/a").when(n == 4, F.concat(F.lit("-"), e, F.lit(".0")))


@query("coerce_int", f"SELECT event_id, CAST(trunc(TRY_CAST(x AS DOUBLE)) AS BIGINT) AS n FROM (SELECT event_id, {_MIXED} AS x FROM events)")
def coerce_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", v.coerce_int(_mixed()).alias("n"))


@query("parse_epoch", f"SELECT event_id, epoch_ms(CAST(trunc(TRY_CAST(x AS DOUBLE)) AS BIGINT) * 1000) AS at FROM (SELECT event_id, {_MIXED} AS x FROM events)")
def parse_epoch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", v.parse_epoch(_mixed()).cast("timestamp_ntz").alias("at"))


@query("collected_at", """
SELECT event_id, epoch_ms(CAST(CASE WHEN event_id % 2 = 0 THEN event_id * 1000 WHEN event_id % 3 = 0 THEN event_id END AS BIGINT) * 1000) AS at FROM events""")
def collected_at(spark: SparkSession, d: str) -> DataFrame:
    time = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 1000).cast("string")).otherwise("")
    date = F.when(F.col("event_id") % 3 == 0, F.col("event_id"))
    return table(spark, d, "events").select("event_id", v.collected_at(time, date).cast("timestamp_ntz").alias("at"))


@query("count_text", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(trunc((event_id + 0.5) * 1000.0) AS BIGINT) WHEN 1 THEN CAST(trunc((event_id + 0.25) * 1000000.0) AS BIGINT) WHEN 2 THEN event_id * 1000 + 5 END AS n FROM events""")
def count_text(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    x = F.when(n == 0, F.concat(e, F.lit(".5K subscribers"))).when(n == 1, F.concat(F.lit("about "), e, F.lit(".25 m views"))).when(n == 2, F.concat(e, F.lit(",005 comments"))).otherwise("none")
    return table(spark, d, "events").select("event_id", v.parse_count_text(x).alias("n"))


@query("compact_number", """
SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n >= 1000000 THEN regexp_replace(printf('%.1f', n / 1000000.0::DOUBLE), '\\.0$', '') || 'M' ELSE regexp_replace(printf('%.1f', n / 1000.0::DOUBLE), '\\.0$', '') || 'K' END AS shown
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 13) AS n FROM orders)""")
def compact_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fx.compact_number(F.floor("o_totalprice") * (F.col("o_orderkey") % 13)).alias("shown"))


@query("stats_line", """
SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderkey % 7 > 0 THEN 'likes ' || o_orderkey % 7 END, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 THEN 'views ' || o_orderkey % 5 END) AS line FROM orders""")
def stats_line(spark: SparkSession, d: str) -> DataFrame:
    views = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5)
    return table(spark, d, "orders").select("o_orderkey", fx.stats_line([("likes", F.col("o_orderkey") % 7), ("views", views)]).alias("line"))


@query("parse_duration", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 3600 + 125 WHEN 1 THEN event_id * 60 + 7 END AS seconds FROM events")
def parse_duration(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    x = F.when(n == 0, F.concat(e, F.lit(":02:05"))).when(n == 1, F.concat(e, F.lit(":07"))).when(n == 2, F.concat(e, F.lit(":x")))
    return table(spark, d, "events").select("event_id", v.parse_duration(x).alias("seconds"))


@query("print_duration", """
SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || CASE WHEN s // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END || printf('%d:%02d:%02d', (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS shown FROM (SELECT event_id, event_id * 37 AS s FROM events)""")
def print_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", v.print_duration(F.col("event_id") * 37).alias("shown"))


@query("future_date", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1996-06-30' THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def future_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", v.not_future(F.to_date("o_orderdate"), F.lit("1996-06-30").cast("date")).alias("day"))


@query("date_mirror", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, o_orderpriority) AS day FROM orders")
def date_mirror(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", v.date_or_text(day, F.col("o_orderpriority")).alias("day"))


@query("typed_equality", "SELECT o_orderkey, o_orderkey % 3 = 0 AS equal FROM orders")
def typed_equality(spark: SparkSession, d: str) -> DataFrame:
    day, n = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(n == 0, day.cast("string")).when(n == 1, "not a day")
    return table(spark, d, "orders").select("o_orderkey", v.same(day, text, "date").alias("equal"))


@query("merged_flag", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN NULL ELSE (event_id % 3 = 1) OR (event_id % 10 = 0) END AS flag FROM events")
def merged_flag(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", v.merged_flag(F.when(e % 3 != 0, e % 3 == 1), F.when(e % 5 == 0, e % 10 == 0)).alias("flag"))


@query("clean_path", "SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ' > ' || p_brand || ' > ' || p_type END AS path FROM part")
def clean_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), "p_type"), F.lit(""), F.col("p_type"), F.lit(" "), F.col("p_brand"), F.col("p_brand"), F.concat("p_type", F.lit("\u00a0")))
    return table(spark, d, "part").select("p_partkey", F.array_join(v.clean_path(raw), " > ").alias("path"))


@query("single_value", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS file FROM events")
def single_value(spark: SparkSession, d: str) -> DataFrame:
    files = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", v.first_only(files).alias("file"))


@query("chapter_display", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || ' > ' || p_brand WHEN 1 THEN p_name ELSE '' END AS shown FROM part")
def chapter_display(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    path = F.when(n == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", fx.chapter_display(path, F.when(n == 1, F.col("p_name"))).alias("shown"))


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
