"""Review round trips: what is pending, the ledger of edits, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.upsert import first_by


def reviewable(image: Column, alt_text: Column) -> Column:
    return image.isNotNull() & (image != "") | F.coalesce(F.trim(alt_text) != "", F.lit(False))


def pending(posts: DataFrame, ledger: DataFrame, key: str, ordinal: str, include_all: bool = False) -> DataFrame:
    """One row a key, the first, of posts that the ledger does not have."""
    rows = posts if include_all else posts.join(ledger.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    return first_by(rows, [key], F.col(ordinal))


def ledger_upsert(ledger: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """key, reviewed_at, edited: an unchanged edit keeps its time; blank edits are stored too."""
    e = edits.select(F.col("key").alias("__key"), F.col("edited").alias("__edited"))
    both = ledger.join(e, F.col("key") == F.col("__key"), "full_outer")
    same = F.col("__key").isNull() | F.col("edited").eqNullSafe(F.col("__edited"))
    return both.select(F.coalesce("key", "__key").alias("key"), F.when(same & F.col("key").isNotNull(), F.col("reviewed_at")).otherwise(now).alias("reviewed_at"), F.when(F.col("__key").isNull(), F.col("edited")).otherwise(F.col("__edited")).alias("edited"))


def apply_ledger(posts: DataFrame, ledger: DataFrame, key: str, alt_text: str = "alt_text") -> DataFrame:
    """Edited texts instead of generated ones; a blank edit keeps the generated one."""
    l = ledger.select(F.col("key").alias("__key"), F.nullif(F.trim("edited"), F.lit("")).alias("__edited"))
    joined = posts.join(l, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(alt_text, F.coalesce("__edited", alt_text)).drop("__key", "__edited")


def missing_tally(posts: DataFrame, alt_text: str = "alt_text") -> DataFrame:
    return posts.agg(F.count_if(F.coalesce(F.trim(alt_text), F.lit("")) == "").alias("missing"), F.count("*").alias("total"))
