"""Upserts into large state: only what a batch touches is read and written.

The rows of a table are dealt to buckets by a hash of their key; a bucket's rows stand in a folder of their own, which the numbered lists of
``sources.versions`` name. An upsert reads the buckets of the keys that come in, merges them by ``upsert.matched``, writes new folders for those that
changed, all in one job, and publishes them at once. The other buckets keep their folders. Batches of different buckets can be
merged at the same time; of two with a bucket in common the second one starts anew from what the first one left.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.upsert import Policy, matched, new_state
from sparkloom.scratch import delete, written
from sparkloom.sources import versions

#: Buckets of a new table: some 128 MB of each at its expected size is a good measure.
BUCKETS = 64
ATTEMPTS = 10


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _places(tables: dict[str, str], table: str) -> tuple[int | None, dict[int, str]]:
    """How many buckets a table has, and the places of those with rows."""
    found = {name.removeprefix(f"{table}/").split("-of-")[0]: (name, place) for name, place in tables.items() if name.startswith(f"{table}/") and "-of-" in name}
    count = {int(name.rsplit("-", 1)[1]) for name, _ in found.values()}
    return (count.pop() if count else None), {int(b): place for b, (_, place) in found.items()}


def _read(spark: SparkSession, places: Iterable[str], schema) -> DataFrame:
    places = list(places)
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, table: str, keys: DataFrame | None = None, at: tuple[int, dict[str, str]] | None = None) -> DataFrame | None:
    """The table as it was published last, or by the list ``at``; with ``keys`` only its rows of these keys, from their buckets. None if
    it has no rows."""
    count, places = _places((at or versions.versions(spark, root))[1], table)
    if not places:
        return None
    if keys is None:
        return spark.read.parquet(*places.values())
    schema = spark.read.parquet(next(iter(places.values()))).schema
    wanted = keys.distinct()
    touched = {r[0] for r in wanted.select(bucket_of(keys.columns, count)).distinct().collect()}  # at most a number for each bucket
    found = _read(spark, (p for b, p in sorted(places.items()) if b in touched), schema)
    wanted = wanted.toDF(*(f"__{c}" for c in keys.columns))
    return found.join(wanted, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys.columns], "left_semi")


def _once(batch: DataFrame, root: str, table: str, key: list[str], policy: Policy, buckets: int) -> DataFrame:
    spark = batch.sparkSession
    number, tables = versions.versions(spark, root)
    count, places = _places(tables, table)
    count = count or buckets
    numbered = batch.withColumn("__bucket", bucket_of(key, count))
    # numbers below the table's number of buckets
    touched = sorted(places) if policy.delete_missing else []
    touched = sorted({*touched, *(r[0] for r in numbered.select("__bucket").distinct().collect())})
    old = _read(spark, (places[b] for b in touched if b in places), batch.schema)
    changes = written(matched(old, batch, key, policy), "changes")
    bucket = bucket_of(key, count).alias("__bucket")
    # buckets without a change keep their folder
    moved = {r[0] for r in changes.filter("op IN ('created', 'updated', 'deleted')").select(bucket).distinct().collect()}
    folder = f"{root.rstrip('/')}/{table}/v-{uuid.uuid4().hex}"
    state = new_state(changes).withColumn("__bucket", bucket).filter(F.col("__bucket").isin(sorted(moved)))
    try:
        state.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        left = {r[0] for r in state.select("__bucket").distinct().collect()}
        listed = {f"{table}/{b}-of-{count}": f"{folder}/__bucket={b}" if b in left else None for b in moved}
        # what was only read is a reason for a conflict as well
        versions.commit(spark, listed, root, number, [f"{table}/{b}-of-{count}" for b in touched])
    except BaseException:
        delete(spark, folder)
        raise
    return changes.filter("op <> 'kept'")


def upsert(batch: DataFrame, root: str, table: str, key: list[str], policy: Policy = Policy(), buckets: int = BUCKETS) -> DataFrame:
    """Merges ``batch``, with one row for each key at most and all columns of the table, into it, and gives the rows that came in or
    went as ``upsert.matched`` does: op, the key, old and result. The first batch makes the table, of ``buckets`` buckets. A key that
    is null is a key like others."""
    batch = written(batch, "batch")
    for left in reversed(range(ATTEMPTS)):
        try:
            return _once(batch, root, table, key, policy, buckets)
        except versions.Conflict:
            if not left:
                raise
            time.sleep(random.random() * 0.1)
    raise AssertionError
