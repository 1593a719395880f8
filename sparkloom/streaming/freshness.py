"""Snapshots that arrive in files are merged into a published table, batch by batch.

The freshness rule makes a batch that is applied twice harmless: a row that is as old as the stored one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import bucketed
from sparkloom.operators.upsert import Policy, freshest, matched, new_state
from sparkloom.sources.sinks import current, publish


def apply_snapshots(state: DataFrame, batch: DataFrame, key: list[str], time: str) -> DataFrame:
    """The state after a batch of snapshots (the state's columns and any others)."""
    rows = batch.withColumn("__nth", F.monotonically_increasing_id())
    newest = freshest(rows.select(*state.columns, "__nth"), key, time, "__nth").drop("__nth")
    return new_state(matched(state, newest, key, Policy(fresh=time))).select(*state.columns)


def follow(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, key: list[str], time: str) -> StreamingQuery:
    """Follows JSON files in ``source`` until what is there has been read; each batch publishes a new version in ``root``."""
    empty = spark.createDataFrame([], schema)

    def merge(batch: DataFrame, _: int) -> None:
        state = current(spark, root)
        publish(apply_snapshots(empty if state is None else state, batch, key, time), root)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_into_buckets(spark: SparkSession, source: str, schema: str, root: str, table: str, checkpoint: str, key: list[str], time: str, buckets: int = bucketed.BUCKETS) -> StreamingQuery:
    """``follow`` for large state: a batch meets, and publishes, the buckets of its keys alone, whatever the size of the table, which is
    read by ``bucketed.read``. A batch that is run again after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        newest = freshest(batch.withColumn("__nth", F.monotonically_increasing_id()), key, time, "__nth").drop("__nth")
        bucketed.upsert(newest.select(*batch.columns), root, table, key, Policy(fresh=time), buckets)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Events in windows of time; rows later than ``late`` after the newest are left out once their window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
