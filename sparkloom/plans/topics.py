"""Topic trees over part (root p_type, leaf p_brand) and lineitem (members l_orderkey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import tree
from sparkloom.plans.tables import table
from sparkloom.registry import query


def members(spark: SparkSession, d: str) -> DataFrame:
    """item, path: each order's topics."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.array("p_type", "p_brand").alias("path"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), "l_partkey").join(part, "l_partkey").select("item", "path")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Types and brands are main topics here."""
    part = table(spark, d, "part")
    return tree.build(part.select(F.array("p_type", "p_brand").alias("path")).union(part.select(F.array("p_type").alias("path"))).distinct())


def text_path(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, " > "))
    return df


_NODES = "WITH n AS (SELECT DISTINCT unnest([p_type, p_type || ' > ' || p_brand]) AS path FROM part), "
_COVER = _NODES + """
m AS (SELECT l_orderkey AS item, unnest([p_type, p_type || ' > ' || p_brand]) AS path FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT path, count(DISTINCT item) AS covered FROM m GROUP BY path) """


@query("topic_coverage", _COVER + "SELECT path, covered FROM c")
def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    return text_path(tree.coverage(members(spark, d), nodes(spark, d), "item"), "path")


@query("tree_build", """
WITH n AS (SELECT DISTINCT p_type AS path, p_type AS label, 1 AS depth, CAST(NULL AS VARCHAR) AS parent, false AS is_main FROM part
UNION ALL SELECT DISTINCT p_type || ' > ' || p_brand, p_brand, 2, p_type, true FROM part) SELECT path, label, CAST(depth AS INTEGER) AS depth, parent, is_main FROM n""")
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    return text_path(tree.build(table(spark, d, "part").select(F.array("p_type", "p_brand").alias("path"))), "path", "parent")


@query("main_ancestors", _NODES + """
a AS (SELECT path, path AS ancestor, 0 AS distance FROM n UNION ALL SELECT path, split_part(path, ' > ', 1), 1 FROM n WHERE path LIKE '% > %')
SELECT path, ancestor, CAST(distance AS INTEGER) AS distance FROM a""")
def main_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return text_path(tree.main_ancestors(nodes(spark, d)), "path", "ancestor").select("path", "ancestor", "distance")


@query("condensed_parent", _COVER + "SELECT path, CASE WHEN path LIKE '% > %' THEN split_part(path, ' > ', 1) END AS parent FROM c")
def condensed_parent(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return text_path(tree.condensed_parents(n, tree.coverage(members(spark, d), n, "item")), "path", "parent")


@query("tree_preorder", _COVER + """,
k AS (SELECT c.path, c.covered, CASE WHEN c.path LIKE '% > %' THEN 2 ELSE 1 END AS depth, r.covered AS rc, r.path AS root, split_part(c.path, ' > ', -1) AS label
      FROM c JOIN c r ON r.path = split_part(c.path, ' > ', 1))
SELECT path, label, covered, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY rc DESC, root, depth, covered DESC, label) AS INTEGER) AS nth FROM k""")
def tree_preorder(spark: SparkSession, d: str) -> DataFrame:
    n, m = nodes(spark, d), members(spark, d)
    c = tree.coverage(m, n, "item")
    return text_path(tree.preorder(n, tree.condensed_parents(n, c), c), "path").select("path", "label", "covered", "depth", "nth")


@query("main_topic_tree", _COVER + """,
s AS (SELECT min(p_type) AS t FROM part)
SELECT path, covered, path NOT LIKE '% > %' AS has_children, path = t AS expanded, path NOT LIKE '% > %' OR split_part(path, ' > ', 1) = t AS visible, path = t AS selected FROM c, s""")
def main_topic_tree(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    rows = tree.main_topic_tree(members(spark, d), nodes(spark, d), "item", [chosen])
    return text_path(rows, "path").select("path", "covered", "has_children", "expanded", "visible", "selected")


@query("subtree_members", "SELECT DISTINCT l_orderkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = (SELECT max(p_type) FROM part)")
def subtree_members(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "part").agg(F.max("p_type")).first()[0]
    return tree.subtree_members(members(spark, d), F.array(F.lit(chosen)), "item")


@query("sibling_rank_path", """
WITH n AS (SELECT DISTINCT p_type, p_brand FROM part),
r AS (SELECT p_type, p_brand, dense_rank() OVER (ORDER BY p_type) AS a, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) AS b FROM n)
SELECT p_type AS path, printf('%04d', a) AS rank_path FROM r GROUP BY ALL UNION ALL SELECT p_type || ' > ' || p_brand, printf('%04d%04d', a, b) FROM r""")
def sibling_rank_path(spark: SparkSession, d: str) -> DataFrame:
    return text_path(tree.sibling_rank_path(nodes(spark, d)), "path")


@query("indented_labels", """
SELECT DISTINCT p_type AS path, p_type AS shown FROM part UNION SELECT DISTINCT p_type || ' > ' || p_brand, '— ' || p_brand FROM part""")
def indented_labels(spark: SparkSession, d: str) -> DataFrame:
    return text_path(nodes(spark, d).select("path", tree.indented(F.col("label"), F.col("depth")).alias("shown")), "path")


@query("toggled_topics", """
WITH r AS (SELECT min(r_name) AS shut FROM region), o AS (SELECT max(r_name) AS opened FROM region),
t AS (SELECT r_name AS path, 1 AS depth, r_name AS root FROM region UNION ALL SELECT r_name || ' > ' || n_name, 2, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || ' > ' || n_name || ' > ' || s_name, 3, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path, CASE WHEN root = shut THEN false WHEN root = opened THEN depth = 1 ELSE depth < 3 END AS expanded, CASE WHEN root = shut THEN depth = 1 WHEN root = opened THEN depth < 3 ELSE true END AS visible FROM t, r, o""")
def toggled_topics(spark: SparkSession, d: str) -> DataFrame:
    """A tree with all nodes expanded: one root is clicked once, another one twice."""
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    two = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    three = supplier.join(two, F.col("s_nationkey") == F.col("n_nationkey"))
    paths = region.select(F.array("r_name").alias("path")).union(two.select(F.array("r_name", "n_name"))).union(three.select(F.array("r_name", "n_name", "s_name")))
    size = F.size("path")
    rows = paths.select("path", F.when(size > 1, F.slice("path", F.lit(1), size - 1)).alias("parent"), (size < 3).alias("expanded"), F.lit(True).alias("visible"))
    shut, opened = region.agg(F.min("r_name"), F.max("r_name")).first()
    for click in ([shut], [opened], [opened]):
        rows = tree.toggled(rows, click)
    return text_path(rows.select("path", "expanded", "visible"), "path")
