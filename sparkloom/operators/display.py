"""Rows as detail, profile and table pages show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import blank, compact_number, or_empty
from sparkloom.functions.values import print_duration
from sparkloom.operators.browse import NEWEST, newest_first

DASH, UNDATED = "–", "undated"


def counter(n: Column) -> Column:
    """A counter as shown; zero and null are hidden."""
    return F.when(F.coalesce(n, F.lit(0)) > 0, compact_number(n)).otherwise("")


def mention_rows(mentions: DataFrame, path: str, label: str, start: str, end: str, citation: str, is_video: str) -> DataFrame:
    """``mentions`` with category, excerpt and shown_citation: a start is 0:00:00 where there is only an end, and citations are shown
    for videos only."""
    category = F.coalesce(F.nullif(F.array_join(path, " › "), F.lit("")), F.col(label), F.lit(""))
    begin = F.when(F.col(start).isNull() & F.col(end).isNotNull(), F.lit(0)).otherwise(F.col(start))
    excerpt = F.concat_ws(" – ", F.nullif(print_duration(begin.cast("long")), F.lit("")), F.nullif(print_duration(F.col(end).cast("long")), F.lit("")))
    return mentions.withColumns({"category": category, "excerpt": excerpt, "shown_citation": F.when(F.col(is_video), or_empty(F.col(citation))).otherwise("")})


def table_rows(rows: DataFrame, posted: str, columns: list[str]) -> DataFrame:
    """Blanks as a dash, missing dates as undated."""
    shown = [F.when(blank(F.col(c)), DASH).otherwise(F.col(c)).alias(c) for c in columns]
    others = [c for c in rows.columns if c not in columns and c != posted]
    return rows.select(*others, F.coalesce(F.date_format(posted, "yyyy-MM-dd"), F.lit(UNDATED)).alias(posted), *shown)


def profile(evidence: DataFrame, bridge: DataFrame, actor: object, posted: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(an actor's newest evidence, undated last; the count of all of it)."""
    own = bridge.filter(F.col("actor") == F.lit(actor)).select(F.col(key).alias("__key"))
    rows = evidence.join(own, F.col(key) == F.col("__key"), "left_semi")
    return newest_first(rows, posted, key, undated_first=False).limit(NEWEST), rows.agg(F.count("*").alias("total"))
