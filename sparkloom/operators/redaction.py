"""Read-time redaction: ordered rules, global ones for every text, scoped ones for single posts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    placeholder: str
    is_regex: bool = False
    enabled: bool = True


def java_pattern(rule: Rule) -> str | None:
    """The rule's pattern for the JVM, without regard to case; None for an empty or invalid one, which is skipped."""
    if not rule.pattern:
        return None
    try:
        re.compile(rule.pattern if rule.is_regex else re.escape(rule.pattern))
    except re.error:
        return None
    if not rule.is_regex:
        quoted = re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", rule.pattern)
        return rf"(?iuU)\b{quoted}\b"
    return "(?iuU)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", rule.pattern).replace(r"\Z", r"\z")


def java_replacement(rule: Rule) -> str:
    """Python's group references for the JVM; everything else literal."""
    out, i, text = [], 0, rule.placeholder
    while i < len(text):
        if m := re.match(r"\\g<(\w+)>|\\(\d{1,2})", text[i:]):
            name = m[1] or m[2]
            out.append("${" + name + "}" if not name.isdigit() else "$" + name)
            i += m.end()
        else:
            out.append("\\" + text[i] if text[i] in "$\\" else text[i])
            i += 1
    return "".join(out)


def redacted(text: Column, rules: list[Rule]) -> Column:
    """The global rules in turn, in order of their patterns."""
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: r.pattern):
        if pattern := java_pattern(rule):
            text = F.regexp_replace(text, pattern, java_replacement(rule))
    return text


def scoped(text: Column, rules: Column) -> Column:
    """A row's own rules (list of structs pattern, replacement, both for the JVM) in turn."""
    return F.aggregate(F.coalesce(rules, F.array().cast("array<struct<pattern:string,replacement:string>>")), text, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"]))


def rules_of_posts(spark, links: list[tuple[int, Rule]]) -> DataFrame:
    """post_id, rules: each post's enabled scoped rules in order of pattern."""
    rows = [(post, r.pattern, java_pattern(r), java_replacement(r)) for post, r in links if r.enabled and java_pattern(r)]
    frame = spark.createDataFrame(rows, "post_id long, own string, pattern string, replacement string")
    ordered = F.array_sort(F.collect_list(F.struct("own", "pattern", "replacement")))
    return frame.groupBy("post_id").agg(F.transform(ordered, lambda r: F.struct(r["pattern"], r["replacement"])).alias("rules"))


def redact_posts(posts: DataFrame, column: str, rules: list[Rule], own: DataFrame | None = None, key: str = "post_id") -> DataFrame:
    """``posts`` with ``column`` redacted: global rules first, then each post's own."""
    found = posts.withColumn(column, redacted(F.col(column), rules))
    if own is None:
        return found
    held = own.select(F.col("post_id").alias("__post"), F.col("rules").alias("__rules"))
    return found.join(held, F.col(key) == F.col("__post"), "left").withColumn(column, scoped(F.col(column), F.col("__rules"))).drop("__post", "__rules")
