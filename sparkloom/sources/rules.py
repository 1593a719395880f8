"""Rule files: CSV with comment lines, small by nature, read on the driver."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _lines(path: str) -> list[str]:
    """The lines of a file on the driver's disk, or anywhere Spark reads; an absent file has none."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).read_text(encoding="utf-8").splitlines(keepends=True) if Path(path).exists() else []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{Path(path).resolve()}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return []
    return spark.read.text(place.toString(), wholetext=True).first()["value"].splitlines(keepends=True)


def rows(path: str, required: tuple[str, ...] = ()) -> list[dict[str, str]]:
    """The rows below the header, without lines whose first sign is #, and without rows that lack a required value; an absent file has none."""
    lines = [line for line in _lines(path) if not line.lstrip().startswith("#")]
    return [r for r in csv.DictReader(lines) if all((r.get(c) or "").strip() for c in required)]


def label_rules(path: str) -> tuple[dict[str, str], dict[str, str]]:
    """(whole labels, first words) to their replacements; of several the last."""
    exact: dict[str, str] = {}
    prefix: dict[str, str] = {}
    for r in rows(path, ("wrong", "correct")):
        {"exact": exact, "prefix": prefix}.get(r.get("kind", ""), {})[r["wrong"]] = r["correct"]
    return exact, prefix


def level_rules(path: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(whole labels, prefixes by falling length) to levels; REVIEW marks what is undecided."""
    exact: dict[str, str] = {}
    prefix: list[tuple[str, str]] = []
    for r in rows(path, ("key", "level")):
        if r.get("kind") == "exact":
            exact[r["key"]] = r["level"]
        elif r.get("kind") == "prefix":
            prefix.append((r["key"], r["level"]))
    return exact, sorted(prefix, key=lambda p: -len(p[0]))


def person_overrides(path: str) -> dict[str, tuple[str, str, str | None]]:
    return {r["label"]: (r["first_name"], r["last_name"], r.get("sync_uuid") or None) for r in rows(path, ("label", "last_name"))}


def organisation_overrides(path: str) -> dict[str, str]:
    return {r["current_name"]: r["canonical_name"] for r in rows(path, ("current_name", "canonical_name"))}


def name_map(path: str) -> dict[str, str]:
    return {r["name_neu"]: r["name_alt"] for r in rows(path, ("name_neu", "name_alt"))}


def frame(spark: SparkSession, rules: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """rule, value."""
    pairs = list(rules.items()) if isinstance(rules, dict) else rules
    return spark.createDataFrame(pairs, "rule string, value string")
