"""Constraints as DataFrames of violations; an empty one means that the constraint holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows that refer to a parent that does not exist; null refers to none."""
    keys = parents.select(F.col(parent_key).alias("__parent")).distinct()
    return rows.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def not_exactly_one(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which other than one of the columns is set."""
    return rows.filter(sum(F.col(c).isNotNull().cast("int") for c in columns) != 1)


def outside(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def collisions(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """key, entities of keys that more than one entity has."""
    return rows.select(key, entity).distinct().groupBy(key).agg(F.count("*").alias("entities")).filter("entities > 1")


def require(violations: DataFrame, message: str) -> None:
    """Raises with one example if there is a violation."""
    if found := violations.head(1):
        raise ValueError(f"{message}: {found[0].asDict()}")
