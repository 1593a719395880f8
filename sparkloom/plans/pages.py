"""Detail, profile and table rows, alignment plans, media, and the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import align, display, layout, media
from sparkloom.plans.tables import table
from sparkloom.registry import query


@query("mention_rows", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_shipmode ELSE l_returnflag || ' › ' || l_linestatus END AS category,
CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN '0:00:00 – 0:01:0' || l_linenumber ELSE '0:00:0' || l_linenumber END AS excerpt, CASE WHEN l_quantity > 25 THEN l_linestatus ELSE '' END AS shown_citation
FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)""")
def mention_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    path = F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>")).otherwise(F.array("l_returnflag", "l_linestatus"))
    m = table(spark, d, "lineitem").select("l_orderkey", n, path.alias("path"), F.col("l_returnflag").alias("label"), F.when(n % 3 == 2, n).alias("s"), F.when(n % 3 == 1, n + 60).alias("e"), F.col("l_linestatus").alias("c"), (F.col("l_quantity") > 25).alias("v"))
    return display.mention_rows(m, "path", "label", "s", "e", "c", "v").select("l_orderkey", "l_linenumber", "category", "excerpt", "shown_citation")


@query("table_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted, CASE WHEN o_orderkey % 4 = 0 THEN '–' ELSE o_orderpriority END AS platform FROM orders")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("posted"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("platform"))
    return display.table_rows(o, "posted", ["platform"])


@query("profile_total", "SELECT count(*) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5)")
def profile_total(spark: SparkSession, d: str) -> DataFrame:
    bridge = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("actor")).withColumnRenamed("l_orderkey", "o_orderkey")
    return display.profile(table(spark, d, "orders"), bridge, 5, "o_orderdate", "o_orderkey")[1]


@query("interaction_counters", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS shown FROM orders")
def interaction_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", display.counter(F.col("o_orderkey") % 5).alias("shown"))


@query("organisation_plan", """
SELECT 'rename' AS category, s_name AS name, 'Canonical ' || s_suppkey AS target, CAST(NULL AS VARCHAR) AS level FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT CASE WHEN n_nationkey % 3 = 2 THEN 'review' ELSE 'create' END, CASE n_nationkey % 3 WHEN 0 THEN 'Kreisverband ' WHEN 1 THEN 'Ortsverband ' ELSE 'Jugend ' END || n_name, NULL, CASE n_nationkey % 3 WHEN 0 THEN 'Kreis' WHEN 1 THEN 'Ort' END FROM nation""")
def organisation_plan(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    kind = F.element_at(F.array(F.lit("Kreisverband "), F.lit("Ortsverband "), F.lit("Jugend ")), F.col("n_nationkey") % 3 + 1)
    overrides = s.filter("s_suppkey % 4 = 0").select(F.col("s_name").alias("rule"), F.concat(F.lit("Canonical "), F.col("s_suppkey").cast("string")).alias("value"))
    prefix = spark.createDataFrame([("Kreisverband", "Kreis"), ("Ortsverband", "Ort"), ("Jugend", "REVIEW")], "rule string, value string")
    labels = n.select(F.concat(kind, "n_name").alias("label")).union(s.select("s_name"))
    return align.organisation_plan(s.select(F.col("s_name").alias("name")), labels, overrides, prefix.limit(0), prefix)


@query("person_plan", """
SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'rename' ELSE 'create' END AS category, CASE WHEN n_nationkey % 2 = 0 THEN 'Anna ' ELSE 'Neu ' END || n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS BIGINT) END AS person FROM nation WHERE n_name NOT LIKE '% %'""")
def person_plan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_name NOT LIKE '% %'")
    labels = n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Anna ").otherwise("Neu "), "n_name").alias("label"))
    people = n.select(F.col("n_nationkey").cast("long").alias("person"), F.lit("Anna Maria").alias("first_name"), F.col("n_name").alias("last_name"))
    return align.person_plan(people, labels)


@query("plan_summary", "SELECT CASE WHEN n_nationkey % 3 = 2 THEN 'review' ELSE 'create' END AS category, count(*) AS n FROM nation GROUP BY 1")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return align.summary(organisation_plan(spark, d).filter("category <> 'rename'"))


@query("media_unreferenced", "SELECT 'shot/' || page_id AS path FROM pages WHERE page_id % 3 <> 0")
def media_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("shot/"), F.col("page_id").cast("string")).alias("path"))
    posts = files.filter("page_id % 3 = 0").select(F.col("path").alias("screenshot_file"))
    return media.unreferenced(files.select("path"), posts)


@query("media_backfill", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own' WHEN page_id % 3 = 0 THEN 'new' END AS screenshot_file FROM pages")
def media_backfill(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    posts = p.select("page_id", F.when(F.col("page_id") % 2 == 0, "own").otherwise("").alias("screenshot_file"))
    return media.backfilled(posts, p.filter("page_id % 3 = 0").select("page_id", F.lit("new").alias("screenshot_file")), "page_id")


# dots at one place part by a hash of their ids, which SQL does not have: the compared tables hold none
@query("relax_step", """
WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 1000 AS DOUBLE) AS x, c_acctbal % 600 AS y FROM customer),
p AS (SELECT a.id AS a, b.id AS b, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS far FROM c a JOIN c b ON a.id < b.id AND abs(a.x - b.x) < 12 AND abs(a.y - b.y) < 12),
m AS (SELECT a, b, dx / far * (12 - far) / 2 AS dx, dy / far * (12 - far) / 2 AS dy FROM p WHERE far < 12 AND far > 0),
s AS (SELECT id, sum(dx) AS dx, sum(dy) AS dy FROM (SELECT a AS id, dx, dy FROM m UNION ALL SELECT b, -dx, -dy FROM m) GROUP BY id)
SELECT c.id, round(x + coalesce(dx, 0), 6) AS x, round(y + coalesce(dy, 0), 6) AS y FROM c LEFT JOIN s ON c.id = s.id""")
def relax_step(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1000).cast("double").alias("x"), (F.col("c_acctbal") % 600).alias("y"))
    moved = layout.relax_step(c.withColumn("home_x", F.col("x")).withColumn("home_y", F.col("y")), 12.0)
    return moved.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("highlight_membership", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7")
def highlight_membership(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.plans.browse import id_string_agg

    return id_string_agg(spark, d).filter(F.array_contains(F.split("joined", " "), "7")).select("l_orderkey")
