"""Contiguous shards of equal byte size: global prefix sums of document sizes from per-partition totals, cut at equal
targets. DataFrame functions only.

Rows are ordered by (doc_id, size, checksum), nulls first. Each row's global prefix sum is its partition's offset, the
running total of the partitions before it (one row for each partition), plus the running sum inside its partition, so no
task ever sees more than a partition of the order. A row belongs to the shard in whose byte interval it starts;
shard sizes differ from the target by less than one document.

Defined cases: a null text has no bytes and size 1; repeated rows each take a place of their own, next to each other;
an empty table gives no rows; columns other than doc_id and text are ignored. Groups of equal texts get no special
treatment: the law is ``bytes`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stage

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # the last key parts repeated rows, which are interchangeable, so that a hot document is split as well
    order = ["doc_id", "size", "text_crc32", "apart"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("apart", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "sized")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.sum("bytes").alias("whole"))
    # one row for each partition of the order: a bound of the plan, not of the data
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)})
        .join(F.broadcast(offsets.crossJoin(whole)), "part")
        .withColumn("start", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast((cast(start as decimal(38,0)) * {int(shards)}) div whole as int)"))
    )
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

