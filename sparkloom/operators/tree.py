"""Hierarchies of label paths. A node is its path; ancestors are prefixes, so no operator here walks or recurses.

Exploded prefixes meet other tables by equality, never by ``startswith``, which would plan as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkloom.scratch import written


def prefixes(path: Column) -> Column:
    """All prefixes of a path, root first, itself last; none of an empty path."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def build(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, label, depth, parent, is_main of every node on the paths; ends of paths are main topics."""
    p = F.explode(prefixes(F.col(path)))
    nodes = paths.select(p.alias("node"), F.col(path).alias("leaf")).groupBy("node").agg(F.max(F.col("node") == F.col("leaf")).alias("is_main"))
    n = F.col("node")
    return nodes.select(n.alias("path"), F.element_at(n, -1).alias("label"), F.size(n).alias("depth"), F.when(F.size(n) > 1, F.slice(n, 1, F.size(n) - 1)).alias("parent"), "is_main")


def coverage(members: DataFrame, nodes: DataFrame, item: str, path: str = "path") -> DataFrame:
    """path, covered: distinct items at each main node or below it.

    Items that are integers become bitmaps where they are, a bit each, combined before the shuffle; what is multiplied by its depth and
    rolled up are bitmaps of 32,768 items, not members. Other items are made distinct row by row."""
    main = nodes.filter("is_main").select("path")
    if isinstance(members.schema[item].dataType, IntegralType):
        at = F.col(item).cast("long")
        own = members.groupBy(F.col(path).alias("leaf"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        each = own.select("bucket", "bits", F.explode(prefixes(F.col("leaf"))).alias("path")).join(main, "path", "left_semi")
        return each.groupBy("path", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("path").agg(F.sum("n").alias("covered"))
    each = members.select(F.col(item), F.explode(prefixes(F.col(path))).alias("path")).distinct()
    return each.join(main, "path", "left_semi").groupBy("path").agg(F.count(item).alias("covered"))


def main_ancestors(nodes: DataFrame) -> DataFrame:
    """path, ancestor, distance: the main nodes on each node's way to the root, nearest first by distance, itself 0."""
    ways = nodes.select("path", F.explode(prefixes(F.col("path"))).alias("ancestor"))
    main = nodes.filter("is_main").select(F.col("path").alias("ancestor"))
    return ways.join(main, "ancestor", "left_semi").withColumn("distance", F.size("path") - F.size("ancestor"))


def condensed_parents(nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """path, parent: for covered main nodes, the nearest covered main strict ancestor (null at the top)."""
    kept = nodes.filter("is_main").join(covered.select("path"), "path", "left_semi").select("path")
    ways = kept.select("path", F.explode(prefixes(F.col("path"))).alias("ancestor")).filter(F.size("ancestor") < F.size("path"))
    near = ways.join(kept.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").groupBy("path").agg(F.max_by("ancestor", F.size("ancestor")).alias("parent"))
    return kept.join(near, "path", "left")


def preorder(nodes: DataFrame, parents: DataFrame, covered: DataFrame) -> DataFrame:
    """path, parent, label, covered, depth, nth: covered main nodes in pre-order, siblings by coverage descending, then label.

    A subtree's size is the number of nodes that have its root on their condensed way. A node's number is then the sum, along its way, of
    one and the sizes of the subtrees of earlier siblings: no order over all nodes is needed, only one among the children of each.
    """
    main = parents.join(covered, "path").join(nodes.select("path", "label"), "path")
    ways = main.select("path", F.explode(prefixes(F.col("path"))).alias("ancestor"))
    sizes = ways.join(main.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").groupBy(F.col("ancestor").alias("path")).agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("parent").orderBy(F.desc("covered"), "label", "path").rowsBetween(Window.unboundedPreceding, -1)
    own = main.join(sizes, "path").select(F.col("path").alias("ancestor"), (F.coalesce(F.sum("size").over(earlier), F.lit(0)) + 1).alias("step"))
    numbers = ways.join(own, "ancestor").groupBy("path").agg(F.count("*").cast("int").alias("depth"), F.sum("step").cast("int").alias("nth"))
    return main.join(numbers, "path").select("path", "parent", "label", "covered", "depth", "nth")


def main_topic_tree(members: DataFrame, nodes: DataFrame, item: str, selected: list[str] | None = None) -> DataFrame:
    """The tree as shown: pre-order rows with has_children, expanded, visible, selected. A selection of a node that is not
    shown selects nothing; ancestors of the selection are expanded, and a node is visible below expanded ones."""
    # read several times below: written, so that nothing stays in the executors' memory
    nodes = written(nodes, "nodes")
    covered = written(coverage(members, nodes, item), "covered")
    parents = written(condensed_parents(nodes, covered), "parents")
    rows = preorder(nodes, parents, covered)
    chosen = F.array(*[F.lit(x) for x in selected]) if selected else F.lit(None).cast("array<string>")
    valid = rows.select((F.col("path") == chosen).alias("hit")).agg(F.coalesce(F.max("hit"), F.lit(False)).alias("valid"))
    rows = rows.crossJoin(F.broadcast(valid))  # one row
    above = F.col("valid") & (F.slice(chosen, 1, F.size("path")) == F.col("path"))
    children = parents.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    open_parent = F.col("parent").isNull() | (F.col("valid") & (F.slice(chosen, 1, F.size("parent")) == F.col("parent")))
    return rows.join(children, "path", "left").select(
        "nth", "path", "parent", "label", "covered", "depth", F.coalesce("has_children", F.lit(False)).alias("has_children"), F.coalesce(above, F.lit(False)).alias("expanded"),
        F.coalesce(open_parent, F.lit(True)).alias("visible"), F.coalesce(F.col("valid") & (F.col("path") == chosen), F.lit(False)).alias("selected"),
    )


def toggled(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """``rows`` (path, parent, expanded, visible, any others) after a click on the node at ``chosen``: an expanded one is collapsed,
    which hides and collapses all below it; another one is expanded, which shows its children alone."""
    node = F.array(*[F.lit(x) for x in chosen])
    state = rows.select((F.when(F.col("path") == node, F.col("expanded"))).alias("open")).agg(F.max("open").alias("__open"))
    rows = rows.crossJoin(F.broadcast(state))  # one row
    itself, below = F.col("path") == node, (F.size("path") > len(chosen)) & (F.slice("path", 1, len(chosen)) == node)
    closes, opens = F.coalesce("__open", F.lit(False)), ~F.coalesce("__open", F.lit(True))
    child = F.coalesce(F.col("parent") == node, F.lit(False))
    expanded = F.when(itself & F.col("__open").isNotNull(), ~F.col("__open")).when(closes & below, False).otherwise(F.col("expanded"))
    visible = F.when(closes & below, False).when(opens & child, True).otherwise(F.col("visible"))
    return rows.withColumns({"expanded": expanded, "visible": visible}).drop("__open")


def subtree_members(members: DataFrame, selected: Column, item: str, path: str = "path") -> DataFrame:
    """The distinct items at a node or below it."""
    return members.filter(F.slice(F.col(path), 1, F.size(selected)) == selected).select(item).distinct()


def sibling_rank_path(nodes: DataFrame, width: int = 4) -> DataFrame:
    """path, rank_path: zero-padded ranks among siblings by label, concatenated from the root; sorts in tree order."""
    ranks = nodes.withColumn("rank", F.dense_rank().over(Window.partitionBy("parent").orderBy("label")))
    own = ranks.select(F.col("path").alias("ancestor"), F.lpad(F.col("rank").cast("string"), width, "0").alias("digits"))
    ways = nodes.select("path", F.explode(prefixes(F.col("path"))).alias("ancestor")).join(own, "ancestor")
    return ways.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.size("ancestor").alias("d"), "digits"))), lambda s: s["digits"]), "").alias("rank_path"))


def indented(label: Column, depth: Column) -> Column:
    return F.concat(F.repeat(F.lit("— "), depth - 1), label)
