"""Media files beside the tables: what is missing, what nobody refers to any more, and attaching what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attached(posts: DataFrame, files: DataFrame, path: str = "screenshot_file") -> DataFrame:
    """``posts`` with found: whether the file is there; a path is kept even if its file is missing."""
    f = files.select(F.col("path").alias("__path")).distinct()
    return posts.join(f, F.col(path) == F.col("__path"), "left").withColumn("found", F.col("__path").isNotNull()).drop("__path")


def backfilled(posts: DataFrame, items: DataFrame, key: str, path: str = "screenshot_file") -> DataFrame:
    """Posts that have no file yet take the item's."""
    i = items.select(F.col(key).alias("__key"), F.col(path).alias("__file"))
    joined = posts.join(i, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(path, F.coalesce(F.nullif(F.col(path), F.lit("")), F.col("__file"))).drop("__key", "__file")


def unreferenced(files: DataFrame, posts: DataFrame, path: str = "screenshot_file") -> DataFrame:
    """Files that no post refers to, to be removed by a maintenance job."""
    held = posts.select(F.col(path).alias("__path")).filter("__path IS NOT NULL").distinct()
    return files.join(held, F.col("path") == F.col("__path"), "left_anti")
