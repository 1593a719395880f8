"""Upserts, change logs, reviews and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.operators import bucketed, reviews, sync, upsert
from sparkloom.operators.evidence import shards
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.sources import pages

_OLD = "SELECT * FROM (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events WHERE event_id % 3 <> 0) WHERE nth = 1"
_NEW = "SELECT * FROM (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events WHERE event_id % 3 = 0) WHERE nth = 1"


def _snapshots(spark: SparkSession, d: str, new: bool) -> DataFrame:
    e = table(spark, d, "events").filter("event_id % 3 = 0" if new else "event_id % 3 <> 0").select("event_id", "user_id", "event_type", "value", "ts")
    return upsert.freshest(e, ["user_id"], "ts", "event_id").select("user_id", "event_type", "value", "ts")


@query("freshest_snapshot", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS nth FROM events) WHERE nth = 1")
def freshest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return upsert.freshest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts")


_UPSERTED = f"""
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL OR n.ts >= o.ts THEN n.event_type ELSE o.event_type END AS event_type,
CASE WHEN o.user_id IS NULL OR n.ts >= o.ts THEN n.value ELSE o.value END AS value FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.user_id = n.user_id"""


@query("upsert_state", _UPSERTED)
def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    changes = upsert.matched(_snapshots(spark, d, False), _snapshots(spark, d, True), ["user_id"], upsert.Policy(fresh="ts"))
    return upsert.new_state(changes).select("user_id", "event_type", "value")


@query("upsert_buckets", _UPSERTED)
def upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same by state in buckets: a first load, a batch, and one user's rows again, which change nothing."""
    root, policy = scratch.new_path(spark, "buckets"), upsert.Policy(fresh="ts")
    old, new = _snapshots(spark, d, False), _snapshots(spark, d, True)
    for batch in (old, new, new.filter(F.col("user_id") == F.lit(new.agg(F.min("user_id")).first()[0]))):
        bucketed.upsert(batch, root, "users", ["user_id"], policy, buckets=16)
    return bucketed.read(spark, root, "users").select("user_id", "event_type", "value")


@query("change_operations", f"""
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'created' WHEN n.user_id IS NULL THEN 'kept'
WHEN n.ts >= o.ts AND (o.event_type <> n.event_type OR o.value <> n.value OR o.ts <> n.ts) THEN 'updated' ELSE 'unchanged' END AS op FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.user_id = n.user_id""")
def change_operations(spark: SparkSession, d: str) -> DataFrame:
    return upsert.matched(_snapshots(spark, d, False), _snapshots(spark, d, True), ["user_id"], upsert.Policy(fresh="ts")).select("user_id", "op")


@query("field_changes", f"""
SELECT o.user_id, 'event_type' AS field, o.event_type AS old, n.event_type AS new FROM ({_OLD}) o JOIN ({_NEW}) n ON o.user_id = n.user_id WHERE n.ts >= o.ts AND o.event_type <> n.event_type""")
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = upsert.matched(_snapshots(spark, d, False), _snapshots(spark, d, True), ["user_id"], upsert.Policy(fresh="ts"))
    return upsert.field_changes(changes).filter("field = 'event_type'")


@query("change_counters", f"""
SELECT 'account' AS "table", count(*) FILTER (WHERE o.user_id IS NULL) AS created, count(*) FILTER (WHERE n.ts >= o.ts AND (o.event_type <> n.event_type OR o.value <> n.value OR o.ts <> n.ts)) AS updated,
count(*) FILTER (WHERE n.user_id IS NULL) AS deleted FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.user_id = n.user_id""")
def change_counters(spark: SparkSession, d: str) -> DataFrame:
    changes = upsert.matched(_snapshots(spark, d, False), _snapshots(spark, d, True), ["user_id"], upsert.Policy(fresh="ts", delete_missing=True))
    return upsert.counters(changes, "account")


@query("mention_sync", """
WITH o AS (SELECT DISTINCT l_orderkey AS e, l_linenumber AS f FROM lineitem WHERE l_quantity < 40), n AS (SELECT DISTINCT l_orderkey AS e, l_linenumber AS f FROM lineitem WHERE l_quantity > 10)
SELECT coalesce(o.e, n.e) AS e, coalesce(o.f, n.f) AS f, CASE WHEN o.e IS NULL THEN 'created' WHEN n.e IS NULL THEN 'deleted' ELSE 'unchanged' END AS op
FROM o FULL JOIN n ON o.e = n.e AND o.f = n.f WHERE coalesce(o.e, n.e) IN (SELECT e FROM n)""")
def mention_sync(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("f"), "l_quantity")
    old = line.filter("l_quantity < 40").select("e", "f", F.lit(1).alias("held")).distinct()
    new = line.filter("l_quantity > 10").select("e", "f", F.lit(1).alias("held")).distinct()
    # an item without any data leaves its old mentions alone
    touched = new.select(F.col("e").alias("k")).distinct()
    old = old.join(touched, F.col("e") == F.col("k"), "left_semi")
    return upsert.matched(old, new, ["e", "f"], upsert.Policy(delete_missing=True)).select("e", "f", "op")


@query("stub_insert", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'stub' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def stub_insert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", "c_name")
    stubs = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("stub").alias("c_name")).distinct()
    return upsert.insert_missing(old, stubs, ["c_custkey"])


@query("fill_empty", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS label, CASE WHEN c_nationkey = 0 THEN 99 ELSE c_nationkey END AS n FROM customer")
def fill_empty(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("label"), F.col("c_nationkey").alias("n"))
    new = c.select("c_custkey", F.col("c_name").alias("label"), F.lit(99).alias("n"))
    return sync.fill_empty(old, new, "c_custkey", ["label", "n"])


@query("null_safe_insert", "SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS role, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey END AS level FROM customer")
def null_safe_insert(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("role"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey")).alias("level")).distinct()
    return upsert.insert_missing(tags.filter("role IS NULL"), tags, ["role", "level"])


@query("verband_kept", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, -1) AS verband FROM customer")
def verband_kept(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.select("c_custkey", F.lit(-1).alias("verband"))
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("verband"))
    return upsert.new_state(upsert.matched(old, new, ["c_custkey"], upsert.Policy(fill_null=frozenset(["verband"]))))


@query("originators_add_only", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity < 30 OR l_quantity > 45")
def originators_add_only(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.filter("l_quantity < 30").select("l_orderkey", "l_suppkey").union(line.filter("l_quantity > 45").select("l_orderkey", "l_suppkey")).distinct()


@query("aliases_added", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ',old' ELSE s_name END AS aliases FROM supplier")
def aliases_added(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    old = s.select("s_suppkey", F.array("s_name").alias("aliases"))
    new = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("old"), F.col("s_name"))).otherwise(F.array("s_name")).alias("aliases"))
    changes = upsert.matched(old, new, ["s_suppkey"], upsert.Policy(add=frozenset(["aliases"])))
    return upsert.new_state(changes).select("s_suppkey", F.array_join("aliases", ",").alias("aliases"))


@query("set_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return table(spark, d, "orders").join(keys, F.col("o_orderkey") == F.col("k"), "left_anti").select("o_orderkey")


@query("multiset_diff", "(SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) EXCEPT ALL (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter("o_orderkey % 2 = 0").select("o_orderpriority", "o_orderstatus").exceptAll(o.filter("o_orderkey % 3 = 0").select("o_orderpriority", "o_orderstatus"))


@query("reset_stale", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) END AS x FROM orders")
def reset_stale(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.operators.vectors import with_coordinates

    o = table(spark, d, "orders")
    e = o.select("o_orderkey", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit("2020-01-01").cast("timestamp").alias("fit_at"))
    fitted = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return with_coordinates(e, fitted, "o_orderkey", F.lit("2024-01-01").cast("timestamp"), reset=True).select("o_orderkey", "x")


@query("pending_review", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_review(spark: SparkSession, d: str) -> DataFrame:
    return reviews.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id")


@query("ledger_override", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'edited' END, d.lang) AS alt_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def ledger_override(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "edited").otherwise("  ").alias("edited"))
    return reviews.apply_ledger(table(spark, d, "documents").select("doc_id", F.col("lang").alias("alt_text")), ledger, "doc_id")


@query("ledger_upsert", """
SELECT coalesce(l.doc_id, d.doc_id) AS key, CASE WHEN l.doc_id IS NOT NULL AND (d.doc_id IS NULL OR l.quality = 1) THEN 'then' ELSE 'now' END AS reviewed_at FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d ON l.doc_id = d.doc_id""")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit("then").alias("reviewed_at"), F.col("quality").cast("string").alias("edited"))
    edits = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.lit("1").alias("edited"))
    return reviews.ledger_upsert(ledger, edits, F.lit("now")).select("key", "reviewed_at")


@query("missing_tally", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missing_tally(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.lit("x").alias("alt_text"))
    return reviews.missing_tally(table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("k"), "left"))


@query("balanced_shards", "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INTEGER) AS shard FROM documents")
def balanced_shards(spark: SparkSession, d: str) -> DataFrame:
    return shards(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@query("affiliation_dates", """
SELECT o_orderkey AS aw_id, CAST(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, TIMESTAMP '1992-01-01') AS DATE) AS start_date,
CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1996-01-01' THEN CAST(o_orderdate AS DATE) END ELSE DATE '1995-12-31' END AS end_date, '' AS comment FROM orders""")
def affiliation_dates(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    raw = table(spark, d, "orders").select(k.alias("id"), F.struct(F.col("o_custkey").alias("id")).alias("politician"), F.struct(F.lit(1).alias("id")).alias("parliament_period"),
                                           F.when(k % 2 == 0, day).alias("start_date"), F.when(k % 3 == 0, day).alias("end_date"), F.lit(None).cast("string").alias("info"))
    periods = spark.createDataFrame([(1, "1992-01-01", "1995-12-31")], "aw_id int, s string, e string").select("aw_id", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))
    return sync.affiliation_rows(raw, periods, F.lit("1996-01-01").cast("date")).select("aw_id", "start_date", "end_date", "comment")


@query("election_fixup", "SELECT p_partkey AS aw_id, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey = 7 THEN 777 ELSE p_size END END AS election_id FROM part")
def election_fixup(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.lit("x").alias("label"), F.struct(F.lit(1).alias("id")).alias("parliament"), F.lit(None).cast("date").alias("start_date_period"),
                                         F.lit(None).cast("date").alias("end_date_period"), F.struct(F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("id")).alias("previous_period"))
    return sync.period_rows(raw, {7: 777}).select(F.col("aw_id").cast("long").alias("aw_id"), "election_id")


@query("assign_ids", "SELECT c_custkey AS aw_id, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey END AS wikidata_id FROM customer")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, d, "customer").select(k.alias("aw_id"), F.when(k % 2 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata_id"))
    found = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(k.alias("aw_id"), F.concat(F.lit("N"), k.cast("string")).alias("qid"))
    return sync.assign_ids(people, found)


@query("excluded_ids", "SELECT c_custkey AS aw_id FROM customer WHERE c_custkey NOT IN (3, 5, 8)")
def excluded_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"), F.col("c_name").alias("last_name"), F.lit(None).cast("string").alias("qid_wikidata"), F.lit("").alias("field_title"))
    return sync.person_rows(raw, [3, 5, 8]).select("aw_id")


@query("sparql_batches", "SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS batch, c_custkey FROM customer")
def sparql_batches(spark: SparkSession, d: str) -> DataFrame:
    return pages.batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)
