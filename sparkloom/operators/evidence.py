"""Evidence rows: text segments, mentions, export rows, and the operators that assemble them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import or_empty, strip
from sparkloom.scratch import written

_SEGMENT = "struct<kind:string,text:string,attribution:string>"


def own_segments(title: Column, text: Column, description: Column) -> Column:
    """The post's texts by kind, stripped, empty ones left out."""
    parts = [F.struct(F.lit(k).alias("kind"), strip(or_empty(x)).alias("text"), F.lit(None).cast("string").alias("attribution")) for k, x in (("title", title), ("body", text), ("description", description))]
    return F.filter(F.array(*parts), lambda s: s["text"] != "")


def repost_segment(text: Column, account: Column) -> Column:
    body = strip(or_empty(text))
    return F.when(body != "", F.struct(F.lit("repost").alias("kind"), body.alias("text"), account.alias("attribution")))


def text_block(own: Column, repost: Column, is_video: Column) -> Column:
    """Heading and segments; null without any."""
    segments = F.concat(own, F.when(repost.isNull(), F.array().cast(f"array<{_SEGMENT}>")).otherwise(F.array(repost).cast(f"array<{_SEGMENT}>")))
    return F.when(F.size(segments) > 0, F.struct(F.when(is_video, "Video").otherwise("Post").alias("heading"), segments.alias("segments")))


def ordered_texts(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, texts: the stripped, non-empty, first-seen distinct texts of each key in order."""
    each = rows.select(key, F.struct(*order, strip(or_empty(F.col(text))).alias("t")).alias("s")).filter("s.t <> ''")
    return each.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"])).alias("texts"))


def joined_texts(citations: Column, own: Column) -> Column:
    """Citations, then the post's texts, parted by empty lines; what both hold stays twice."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(citations, empty), F.coalesce(own, empty)), "\n\n")


def string_agg(rows: DataFrame, key: str, order: list[str], text: Column, separator: str = ", ", distinct: bool = False) -> DataFrame:
    """key, joined: the texts of each key in order; null and empty ones are skipped."""
    each = rows.select(key, F.struct(*order, text.alias("t")).alias("s")).filter("s.t IS NOT NULL AND s.t <> ''")
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"])
    return each.groupBy(key).agg(F.array_join(F.array_distinct(listed) if distinct else listed, separator).alias("joined"))


def zip_longest(*lists: tuple[str, Column]) -> Column:
    """Lists side by side, short ones padded with nulls, null ones taken as empty."""
    return F.arrays_zip(*[F.coalesce(x, F.array()).alias(name) for name, x in lists])


def merged_reports(rows: DataFrame, key: str, ordinal: str, lists: list[str]) -> DataFrame:
    """The row-parallel lists of all occurrences of a post, concatenated list by list without padding, in order."""
    gathered = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.coalesce(F.col(c), F.array()).alias("x")))), lambda s: s["x"])).alias(c) for c in lists]
    return rows.groupBy(key).agg(*gathered)


def expanded_mentions(rows: DataFrame, key: str, lists: list[str], topic: str, footnote: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each topic, the topic rows without footnote, which abort an import)."""
    each = rows.select(key, F.posexplode_outer(zip_longest(*[(c, F.col(c)) for c in lists])).alias("nth", "m")).select(key, "nth", *[F.col(f"m.{c}").alias(c) for c in lists])
    has_topic = F.col(topic).isNotNull() & (F.size(topic) > 0)
    found = each.filter(has_topic)
    return found, found.filter(F.col(footnote).isNull() | (F.col(footnote) == ""))


def export_rows(evidence: DataFrame, mentions: DataFrame, key: str, blanks: list[str]) -> DataFrame:
    """A row for each mention; evidence without any keeps one, with empty texts."""
    joined = evidence.join(mentions, key, "left")
    return joined.select(*evidence.columns, *[or_empty(F.col(c).cast("string")).alias(c) for c in blanks])


def segment_text(segments: Column, kind: str) -> Column:
    return or_empty(F.get(F.filter(segments, lambda s: s["kind"] == kind), 0)["text"])


def last_linkable(references: Column) -> Column:
    """The last reference that has an id; of those without, the first is kept apart, verbatim."""
    return F.try_element_at(F.filter(references, lambda r: r["platform_post_id"].isNotNull()), F.lit(-1))


def first_unlinkable(references: Column) -> Column:
    return F.try_element_at(F.filter(references, lambda r: r["platform_post_id"].isNull()), F.lit(1))


def replies(posts: DataFrame, account: str, post_id: str, reply_to: str) -> DataFrame:
    """``posts`` with reply_key: the id of the post answered, if the same account has it among them."""
    targets = posts.select(F.col(account).alias("__a"), F.col(post_id).alias("__p")).distinct()
    joined = posts.join(targets, (F.col(account) == F.col("__a")) & (F.col(reply_to) == F.col("__p")), "left")
    return joined.withColumn("reply_key", F.col("__p")).drop("__a", "__p")


def shards(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """Contiguous balanced shards: the first ``n mod k`` get one row more; sizes come from a count, and positions from
    offsets of range partitions, so no task sorts everything."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as ranges are cut by a sample: a second run of the plan could cut them elsewhere
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    nth = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = nth.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    at = nth.join(F.broadcast(offsets), "__part").withColumn("__at", F.col("__before") + F.col("__nth") - 1)
    big, rest = F.floor(F.col("__all") / k) + 1, F.col("__all") % k
    shard = F.when(F.col("__at") < rest * big, F.floor(F.col("__at") / big)).otherwise(rest + F.floor((F.col("__at") - rest * big) / F.greatest(big - 1, F.lit(1))))
    return at.withColumn("shard", (shard + 1).cast("int")).drop("__part", "__nth", "__before", "__all", "__at")
