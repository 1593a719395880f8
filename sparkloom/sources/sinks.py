"""Writers: exports and run logs; versions of tables are published by ``versions``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import sheets
from sparkloom.sources.versions import current, publish, publish_all, versions  # noqa: F401  part of this interface

FORMATS = ("csv", "xlsx")


def file_name(fmt: str, actor: int | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not supported")
    return f"export{'' if actor is None else f'_{actor}'}.{fmt}"


def export(rows: DataFrame, path: str, fmt: str) -> None:
    """CSV with a header, in parts; or one workbook, streamed through the driver a partition at a time."""
    file_name(fmt)
    texts = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    if fmt == "csv":
        texts.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        sheets.write(path, texts.columns, (tuple(r) for r in texts.toLocalIterator()))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def ledger_text(rows: dict[str, dict]) -> str:
    """A ledger with sorted keys, small by nature."""
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True)


def ledger(rows: dict[str, dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(ledger_text(rows))


def log_run(spark: SparkSession, path: str, operation: str, source: str, success: bool, changes: dict | None = None, notes: str = "") -> None:
    """Appends a row to the table of runs."""
    row = [(operation, source, success, json.dumps(changes, ensure_ascii=False) if changes is not None else None, notes)]
    frame = spark.createDataFrame(row, "operation string, source string, success boolean, changes string, notes string")
    frame.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(path)


def flat_posts(posts: DataFrame) -> DataFrame:
    """The flat export of posts: date from the first ten signs, categories distinct and sorted."""
    return posts.withColumn("date", F.substring("created_at", 1, 10)).withColumn("categories", F.array_join(F.array_sort(F.array_distinct(F.coalesce("categories", F.array().cast("array<string>")))), ", "))
