"""Upserts without MERGE: old state joined fully with what comes in gives the new state and one change row a key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.values import falsy

#: Columns that no diff looks at.
UNTRACKED = ("created_at", "updated_at", "user_snapshot")


@dataclass(frozen=True)
class Policy:
    """How each field takes an incoming value where both sides have the key: replace (default); keep the old one where the incoming one is null
    (``fill_null``); take it only where the old one is empty (``fill_empty``); never (``frozen``); union of lists (``add``)."""

    fill_null: frozenset[str] = frozenset()
    fill_empty: frozenset[str] = frozenset()
    frozen: frozenset[str] = frozenset()
    add: frozenset[str] = frozenset()
    #: a column of times: rows that are older than the stored one change nothing; undated ones only undated ones
    fresh: str | None = None
    #: keys that are not among the incoming ones are deleted
    delete_missing: bool = False
    extra: dict = field(default_factory=dict)


def _taken(name: str, kind: str, policy: Policy) -> Column:
    old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
    if name in policy.frozen:
        return old
    if name in policy.fill_empty:
        return F.when(falsy(old, kind), new).otherwise(old)
    if name in policy.fill_null:
        return F.coalesce(new, old)
    if name in policy.add:
        return F.array_union(F.coalesce(old, F.array().cast(kind)), F.coalesce(new, F.array().cast(kind)))
    return new


def matched(old: DataFrame, new: DataFrame, key: list[str], policy: Policy = Policy()) -> DataFrame:
    """One row a key: op (created, updated, unchanged, deleted, kept), the key, old and result as structs."""
    fields = [c for c in old.columns if c not in key]
    kinds = dict(old.dtypes)
    left = old.select(*key, F.struct(*fields).alias("old"), F.lit(True).alias("had"))
    right = new.select(*[F.col(k).alias(f"k_{k}") for k in key], F.struct(*fields).alias("new"), F.lit(True).alias("came"))
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    both = left.join(right, on, "full_outer")
    fresh = F.lit(True)
    if policy.fresh:
        a, b = F.col(f"new.{policy.fresh}"), F.col(f"old.{policy.fresh}")
        fresh = F.when(a.isNull(), b.isNull()).otherwise(b.isNull() | (a >= b))
    result = F.struct(*[F.when(F.col("had").isNull(), F.col(f"new.{c}")).when(F.col("came").isNull() | ~fresh, F.col(f"old.{c}")).otherwise(_taken(c, kinds[c], policy)).alias(c) for c in fields])
    keys = [F.when(F.col("had").isNull(), F.col(f"k_{k}")).otherwise(F.col(k)).alias(k) for k in key]
    found = both.select(*keys, "old", result.alias("result"), "had", "came")
    tracked = [c for c in fields if c not in UNTRACKED]
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"result.{c}"))
    op = F.when(F.col("had").isNull(), "created").when(F.col("came").isNull(), "deleted" if policy.delete_missing else "kept").when(differs, "updated").otherwise("unchanged")
    return found.select(*key, op.alias("op"), "old", "result")


def new_state(changes: DataFrame) -> DataFrame:
    key = [c for c in changes.columns if c not in ("op", "old", "result")]
    return changes.filter("op <> 'deleted'").select(*key, "result.*")


def field_changes(changes: DataFrame) -> DataFrame:
    """key, field, old, new of each updated row's changed fields, as text."""
    key = [c for c in changes.columns if c not in ("op", "old", "result")]
    fields = [c for c in changes.schema["result"].dataType.fieldNames() if c not in UNTRACKED]
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").cast("string").alias("old"), F.col(f"result.{c}").cast("string").alias("new")) for c in fields])
    diffs = F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return changes.filter("op = 'updated'").select(*key, F.explode(diffs).alias("d")).select(*key, "d.field", "d.old", "d.new")


def counters(changes: DataFrame, table: str) -> DataFrame:
    """table, created, updated, deleted, skipped."""
    n = lambda op: F.count_if(F.col("op") == op)
    return changes.agg(n("created").alias("created"), n("updated").alias("updated"), n("deleted").alias("deleted")).select(F.lit(table).alias("table"), "created", "updated", "deleted")


def change_log(logs: dict[str, DataFrame], key: str) -> DataFrame:
    """table, changes: a JSON object with the created, updated and deleted ids of each table that was touched."""
    found = None
    for table, changes in logs.items():
        one = changes.filter("op IN ('created', 'updated', 'deleted')").select(F.lit(table).alias("table"), "op", F.col(key).cast("string").alias("id"))
        found = one if found is None else found.unionByName(one)
    ids = lambda op: F.array_sort(F.collect_list(F.when(F.col("op") == op, F.col("id")))).alias(op)
    return found.groupBy("table").agg(ids("created"), ids("updated"), ids("deleted")).select("table", F.to_json(F.struct("created", "updated", "deleted")).alias("changes"))


def freshest(snapshots: DataFrame, key: list[str], time: str, ordinal: str) -> DataFrame:
    """The newest row of each key; undated ones last; of equal times the first. A max over a struct, combined before the
    shuffle, so a key with very many snapshots is one row a task."""
    others = [c for c in snapshots.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(F.col(time).isNotNull().alias("dated"), F.col(time).alias("time"), (-F.col(ordinal)).alias("first")))
    return snapshots.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def first_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__nth = 1").drop("__nth")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks (null-safe); existing rows never change."""
    right = old.select(*[F.col(k).alias(f"k_{k}") for k in key])
    missing = new.join(right, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key], "left_anti")
    return old.unionByName(missing, allowMissingColumns=True)
