"""Vectors of texts: a cache keyed by text, two-dimensional reduction, and writing coordinates back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_TEXT, LEAST_ROWS = 30, 5


def text_key(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def long_enough(rows: DataFrame, text: str, least: int = LEAST_TEXT, rows_needed: int = LEAST_ROWS) -> DataFrame:
    found = rows.filter(F.length(text) >= least)
    if found.limit(rows_needed).count() < rows_needed:
        raise ValueError("too few texts to fit")
    return found


def encoded(rows: DataFrame, text: str, cache: DataFrame, model: str, window: int, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with vector, the cache with what was missing): only texts that the cache lacks for this model and window are encoded.

    ``cache`` has model, max_seq_length, key, vector; ``encode`` maps (key, text) to (key, vector).
    """
    known = cache.filter((F.col("model") == model) & (F.col("max_seq_length") == window)).select("key", "vector")
    keyed = rows.withColumn("key", text_key(F.col(text)))
    missing = keyed.select("key", F.col(text).alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    new = encode(missing).select("key", "vector")
    every = known.unionByName(new)
    stored = new.select(F.lit(model).alias("model"), F.lit(window).alias("max_seq_length"), "key", "vector")
    return keyed.join(every, "key").drop("key"), cache.unionByName(stored)


def two_dimensions(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with x and y: the first two principal components (a stand-in for a neighbour embedding)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    prepared = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(prepared)
    out = model.transform(prepared).withColumn("__a", vector_to_array("__p"))
    return out.withColumn("x", F.col("__a")[0]).withColumn("y", F.col("__a")[1]).drop("__v", "__p", "__a")


def with_coordinates(evidence: DataFrame, fitted: DataFrame, key: str, now: Column, reset: bool = False) -> DataFrame:
    """New x, y, fit_at for fitted rows; with ``reset`` all others lose theirs."""
    f = fitted.select(F.col(key).alias("__k"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    joined = evidence.join(f, F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    rest = lambda c: F.lit(None) if reset else F.col(c)
    return joined.withColumn("x", F.when(hit, F.col("__x")).otherwise(rest("x"))).withColumn("y", F.when(hit, F.col("__y")).otherwise(rest("y"))).withColumn("fit_at", F.when(hit, now).otherwise(rest("fit_at"))).drop("__k", "__x", "__y")
