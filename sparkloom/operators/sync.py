"""Synchronisation with a paged API: row builders, insert-missing, fill-empty, and checked creation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import not_future
from sparkloom.operators.checks import orphans, require
from sparkloom.operators.upsert import Policy, insert_missing, matched, new_state


def parliament_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("aw_id"), F.col("label_external_long").alias("name"))


def election_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("aw_id"), F.col("label").alias("name"), F.col("parliament.id").alias("parliament_id"), F.col("start_date_period").alias("start_date"), F.col("end_date_period").alias("end_date"), F.col("election_date").alias("date"))


def period_rows(raw: DataFrame, elections: dict[int, int] | None = None) -> DataFrame:
    """Legislative periods; the election is the previous period's id, corrected by a map where there is a previous period."""
    previous = F.col("previous_period.id")
    fixed = F.create_map(*[F.lit(x) for pair in (elections or {-1: -1}).items() for x in pair])
    election = F.when(previous.isNotNull(), F.coalesce(F.element_at(fixed, F.col("id")), previous))
    return raw.select(F.col("id").alias("aw_id"), F.col("label").alias("name"), F.col("parliament.id").alias("parliament_id"), F.col("start_date_period").alias("start_date"), F.col("end_date_period").alias("end_date"), election.alias("election_id"))


def person_rows(raw: DataFrame, excluded: list[int] | None = None) -> DataFrame:
    rows = raw.select(F.col("id").alias("aw_id"), "first_name", "last_name", F.col("qid_wikidata").alias("wikidata_id"), F.col("field_title").alias("title"))
    return rows.filter(~F.col("aw_id").isin(excluded)) if excluded else rows


def affiliation_rows(raw: DataFrame, periods: DataFrame, today: Column) -> DataFrame:
    """Mandates with dates of their own or of their period; an end in the future is open."""
    p = periods.select(F.col("aw_id").alias("__p"), F.col("start_date").alias("__s"), F.col("end_date").alias("__e"))
    joined = raw.join(p, F.col("parliament_period.id") == F.col("__p"), "left")
    end = not_future(F.coalesce("end_date", "__e"), today)
    return joined.select(F.col("id").alias("aw_id"), F.col("politician.id").alias("person_id"), F.col("parliament_period.id").alias("period_id"), F.coalesce("start_date", "__s").alias("start_date"), end.alias("end_date"), F.coalesce("info", F.lit("")).alias("comment"))


def create_missing(old: DataFrame, new: DataFrame, key: str, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``old`` and the rows it lacks; a row that refers to a missing parent aborts."""
    for column, (table, parent_key) in (parents or {}).items():
        require(orphans(new, column, table, parent_key), f"missing {column}")
    return insert_missing(old, new, [key])


def fill_empty(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only empty stored fields take the incoming value; rows without a counterpart are added."""
    return new_state(matched(old, new, [key], Policy(fill_empty=frozenset(fields))))


def assign_ids(people: DataFrame, found: DataFrame) -> DataFrame:
    """``people`` (aw_id, wikidata_id) with ids of ``found`` (aw_id, qid) where they have none; an id that someone else holds aborts."""
    f = found.select(F.col("aw_id").alias("__aw"), "qid").distinct()
    held = people.filter("wikidata_id IS NOT NULL").select(F.col("wikidata_id").alias("__held"), F.col("aw_id").alias("__by"))
    clash = f.join(held, (F.col("qid") == F.col("__held")) & ~F.col("__aw").eqNullSafe(F.col("__by")))
    require(clash, "the id is taken")
    joined = people.join(f, people["aw_id"] == F.col("__aw"), "left")
    return joined.withColumn("wikidata_id", F.coalesce("wikidata_id", "qid")).drop("__aw", "qid")
