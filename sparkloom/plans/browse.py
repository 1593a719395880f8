"""Filters, joins, facets, orders and caps of the browse and profile pages, and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.names import folded
from sparkloom.functions.text import or_empty
from sparkloom.operators import browse as b
from sparkloom.operators import evidence
from sparkloom.plans.tables import table
from sparkloom.registry import query

_DAY = "CAST(o_orderdate AS DATE)"


@query("actor_filter_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def actor_filter_semi(spark: SparkSession, d: str) -> DataFrame:
    return b.having(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", F.col("l_suppkey") == 3).select("o_orderkey", "o_custkey")


@query("position_same_row", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def position_same_row(spark: SparkSession, d: str) -> DataFrame:
    both = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return b.having(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", both).select("o_orderkey")


@query("verband_or", """
SELECT n.n_nationkey, n.n_name FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)""")
def verband_or(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    groups = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return b.pinned_first(b.options(table(spark, d, "nation"), "n_nationkey", people.union(groups).distinct(), "k", "n_name"), "n_name", "GERMANY").select("n_nationkey", "n_name")


@query("date_range", f"SELECT o_orderkey, {_DAY} AS day FROM orders WHERE {_DAY} BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(b.in_dates(F.col("o_orderdate"), "1995-03-01", "1996-02-29")).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("platform_filter", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def platform_filter(spark: SparkSession, d: str) -> DataFrame:
    return b.facet(table(spark, d, "documents"), {"source": "src1"}).select("doc_id", "lang")


@query("facet_search", "SELECT p_partkey, p_name FROM part WHERE p_size = 5 AND (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a'))")
def facet_search(spark: SparkSession, d: str) -> DataFrame:
    return b.facet(table(spark, d, "part"), {"p_size": 5}, "A", ("p_name", "p_brand")).select("p_partkey", "p_name")


@query("fitted_gate", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL")
def fitted_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("fit", F.nullif("o_orderstatus", F.lit("O"))).filter(F.col("fit").isNotNull()).select("o_orderkey")


@query("year_bounds", "SELECT CAST(year(min(o_orderdate)) AS INTEGER) AS first_year, CAST(year(max(o_orderdate)) AS INTEGER) AS last_year FROM orders")
def year_bounds(spark: SparkSession, d: str) -> DataFrame:
    return b.year_bounds(table(spark, d, "orders"), "o_orderdate")


@query("extents", "SELECT min(c_custkey) AS x_min, max(c_custkey) AS x_max, min(c_acctbal) AS y_min, max(c_acctbal) AS y_max FROM customer")
def extents(spark: SparkSession, d: str) -> DataFrame:
    return b.extents(table(spark, d, "customer"), "c_custkey", "c_acctbal")


@query("canvas_projection", """
WITH e AS (SELECT min(c_custkey) x0, max(c_custkey) x1, min(c_acctbal) y0, max(c_acctbal) y1 FROM customer)
SELECT c_custkey, round((c_custkey - x0) / coalesce(nullif(x1 - x0, 0), 1) * 968 + 16, 1) AS px, round(600 - ((c_acctbal - y0) / coalesce(nullif(y1 - y0, 0), 1) * 568 + 16), 1) AS py FROM customer, e""")
def canvas_projection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return b.on_canvas(c, b.extents(c, "c_custkey", "c_acctbal"), "c_custkey", "c_acctbal").select("c_custkey", "px", "py")


@query("actors_in_view", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_suppkey")
def actors_in_view(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return b.actors_in_view(table(spark, d, "lineitem"), seen, "l_orderkey", "l_suppkey")


@query("actors_in_view_ordered", """
SELECT s_suppkey, s_name, n FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey ORDER BY n DESC, lower(s_name), s_suppkey LIMIT 25""")
def actors_in_view_ordered(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    n = line.select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"))
    return table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "n").orderBy(F.desc("n"), F.lower("s_name"), "s_suppkey").limit(25)


@query("actor_options", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def actor_options(spark: SparkSession, d: str) -> DataFrame:
    return b.options(table(spark, d, "supplier"), "s_suppkey", table(spark, d, "lineitem").filter("l_quantity > 49"), "l_suppkey", "s_name").select("s_suppkey", "s_name")


@query("profile_top20", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 10 = 1 ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 20")
def profile_top20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_custkey % 10 = 1").withColumn("t", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return b.newest_first(rows, "t", "o_orderkey", undated_first=False).limit(b.NEWEST).select("o_orderkey", "o_orderdate")


@query("cloud_order_cap", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_orderkey DESC LIMIT 5000")
def cloud_order_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("t", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return b.newest_first(rows, "t", "o_orderkey", undated_first=True).limit(b.ROWS).select("o_orderkey")


@query("cap_plus_one", "SELECT least(count(*), 5000) AS shown, count(*) > 5000 AS truncated FROM orders")
def cap_plus_one(spark: SparkSession, d: str) -> DataFrame:
    probe = table(spark, d, "orders").select("o_orderkey").limit(b.ROWS + 1)
    return probe.agg(F.least(F.count("*"), F.lit(b.ROWS).cast("long")).alias("shown"), (F.count("*") > b.ROWS).alias("truncated"))


@query("outline_hidden", "SELECT greatest(count(*) - 100, 0) AS hidden FROM orders WHERE o_orderstatus = 'F'")
def outline_hidden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").agg(F.greatest(F.count("*") - b.OUTLINE, F.lit(0).cast("long")).alias("hidden"))


@query("name_sort_rank", "SELECT n_name, CAST(row_number() OVER (ORDER BY replace(lower(n_name), 'ß', 'ss'), n_nationkey) AS INTEGER) AS nth FROM nation")
def name_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(folded(F.col("n_name")), "n_nationkey")).alias("nth"))


@query("mention_expand_left", "SELECT o_orderkey, coalesce(CAST(l_linenumber AS VARCHAR), '') AS footnote, coalesce(l_returnflag, '') AS flag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def mention_expand_left(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("footnote"), F.col("l_returnflag").alias("flag"))
    return evidence.export_rows(table(spark, d, "orders").select("o_orderkey"), m, "o_orderkey", ["footnote", "flag"])


@query("export_rows", """
SELECT o_orderkey AS slug, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS post_date, coalesce(c_name, '') AS posted_by, coalesce(n_name, '') AS verband,
       coalesce(CAST(l_linenumber AS VARCHAR), '') AS footnote, coalesce(s_name, '') AS originator, coalesce(p_type || ' > ' || p_brand, '') AS chapter
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON o_orderkey = l_orderkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    e = e.select(F.col("o_orderkey").alias("slug"), F.to_date("o_orderdate").cast("string").alias("post_date"), or_empty(F.col("c_name")).alias("posted_by"), or_empty(F.col("n_name")).alias("verband"))
    m = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    m = m.select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("footnote"), F.col("s_name").alias("originator"), F.concat("p_type", F.lit(" > "), "p_brand").alias("chapter"))
    return evidence.export_rows(e, m, "slug", ["footnote", "originator", "chapter"])


@query("id_string_agg", "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_suppkey) AS joined FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1")
def id_string_agg(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return evidence.string_agg(rows, "l_orderkey", ["l_suppkey"], F.col("l_suppkey").cast("string"), " ")


@query("originators_with_verband", """
SELECT l_orderkey, string_agg(s_name || ' (' || n_name || ')', ', ' ORDER BY l_suppkey) AS joined
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def originators_with_verband(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return evidence.string_agg(rows, "l_orderkey", ["l_suppkey"], F.concat("s_name", F.lit(" ("), "n_name", F.lit(")")))


@query("chapters_distinct_agg", """
WITH r AS (SELECT l_orderkey, p_type, min(l_linenumber) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_orderkey, string_agg(p_type, ', ' ORDER BY first, p_type) AS joined FROM r GROUP BY 1""")
def chapters_distinct_agg(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type")
    rows = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return evidence.string_agg(rows, "l_orderkey", ["l_linenumber"], F.col("p_type"), distinct=True)


@query("posts_per_platform", "SELECT coalesce(source, 'all') AS platform, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def posts_per_platform(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("platform"), "n")


@query("evidence_count", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def evidence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"))


@query("neighbour_pairs", """
SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey
AND b.c_custkey - a.c_custkey < 30 AND sqrt((a.c_custkey - b.c_custkey) * (a.c_custkey - b.c_custkey) + (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal)) < 30""")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    return b.neighbour_pairs(table(spark, d, "customer"), "c_custkey", "c_custkey", "c_acctbal", 30.0).select("a", "b")


@query("fit_box", """
WITH e AS (SELECT min(p_size) x0, max(p_size) x1, min(p_size) y0, max(p_size) y1 FROM part),
s AS (SELECT *, least(greatest(greatest(x1 - x0 + 80.0, 120.0), greatest(y1 - y0 + 80.0, 72.0) * 1000 / 600), 1000.0) AS width FROM e),
h AS (SELECT *, width * 600 / 1000 AS height FROM s)
SELECT round(greatest(0.0, least((x0 + x1 - width) / 2, 1000 - width)), 6) AS left_, round(greatest(0.0, least((y0 + y1 - height) / 2, 600 - height)), 6) AS top_,
CAST(round(width, 6) AS DOUBLE) AS width, CAST(round(height, 6) AS DOUBLE) AS height FROM h""")
def fit_box(spark: SparkSession, d: str) -> DataFrame:
    box = b.fit_box(table(spark, d, "part").select(F.col("p_size").cast("double").alias("v")), "v", "v")
    return box.select(F.round("left", 6).alias("left_"), F.round("top", 6).alias("top_"), F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query("circle_diff", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'remove' ELSE 'keep' END AS action
FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k""")
def circle_diff(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return b.circle_diff(k.filter("k % 3 <> 0"), k.filter("k % 5 <> 0"), "k")


@query("in_bulk_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def in_bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.operators.checks import orphans, require

    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    require(orphans(orders, "o_custkey", customers, "c_custkey"), "missing customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("cloud_request", """
WITH e AS (SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH' AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'
  AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = o_orderkey AND n_nationkey = 7)
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_type = (SELECT min(p_type) FROM part)))
SELECT id FROM e ORDER BY o_orderdate DESC NULLS FIRST, id DESC LIMIT 5001""")
def cloud_request(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.plans.topics import members

    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    e = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("posted_at"), F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("text"),
                      F.col("o_totalprice").alias("x"), F.col("o_totalprice").alias("y"), F.nullif("o_orderstatus", F.lit("P")).alias("fit_at"))
    tables = b.Tables(
        e, line.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("actor")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("actor"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("verband")),
        line.select(F.col("l_suppkey").alias("actor"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("level")), members(spark, d).select(F.col("item").alias("id"), "path"),
    )
    chapter = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return b.TopicCloud(tables, {"platform": "2-HIGH", "date_from": "1995-01-01", "date_to": "bad", "verband": "7"}, [chapter]).run()["rows"].select("id")
