from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import bucketed, upsert
from sparkloom.operators.upsert import Policy
from sparkloom.sources import versions

SCHEMA = "id long, part string, text string, n long, tags array<string>, at timestamp"
OLD = "SELECT id, IF(id % 7 = 0, NULL, 'p') AS part, IF(id % 3 = 0, '', concat('t', id)) AS text, IF(id % 4 = 0, NULL, id) AS n, array('a', string(id % 2)) AS tags, IF(id % 5 = 0, NULL, timestamp_seconds(id * 100)) AS at FROM range(0, 60)"
NEW = "SELECT id, IF(id % 7 = 0, NULL, 'p') AS part, IF(id % 6 = 0, NULL, concat('u', id)) AS text, IF(id % 5 = 0, NULL, id + id % 2) AS n, array('b') AS tags, IF(id % 9 = 0, NULL, timestamp_seconds(4000)) AS at FROM range(30, 75, 5)"
POLICIES = [
    Policy(), Policy(fill_null=frozenset({"text", "n"})), Policy(fill_empty=frozenset({"text"}), frozen=frozenset({"n"})), Policy(add=frozenset({"tags"})),
    Policy(fresh="at"), Policy(delete_missing=True),
]
KEY = ["id", "part"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(POLICIES.index(p)))
def test_like_a_full_join(spark, tmp_path, policy):
    root, old, new = str(tmp_path), spark.sql(OLD), spark.sql(NEW)
    bucketed.upsert(old, root, "t", KEY, buckets=8)
    first = versions.versions(spark, root)[1]
    changes = bucketed.upsert(new, root, "t", KEY, policy)
    want = upsert.matched(old, new, KEY, policy)
    columns = [*KEY, "text", "n", "tags", "at"]
    assert rows(bucketed.read(spark, root, "t"), *columns) == rows(upsert.new_state(want), *columns)
    assert rows(changes, "id", "op") == rows(want.filter("op <> 'kept'"), "id", "op")
    moved = {r[0] for r in want.filter("op NOT IN ('kept', 'unchanged')").select(bucketed.bucket_of(KEY, 8)).distinct().collect()}
    # the other buckets keep their folders
    now = versions.versions(spark, root)[1]
    assert {n for n in first if now.get(n) != first[n]} <= {f"t/{b}-of-8" for b in moved}


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), []
    bucketed.upsert(spark.sql(OLD), root, "t", KEY, buckets=16)
    full = upsert.matched
    monkeypatch.setattr(bucketed, "matched", lambda old, *args: seen.extend(old.inputFiles()) or full(old, *args))
    one = spark.sql(NEW).filter("id = 35")
    bucketed.upsert(one, root, "t", KEY)
    bucket = one.select(bucketed.bucket_of(KEY, 16)).first()[0]
    assert seen and all(f"__bucket={bucket}/" in f for f in seen)
    found = bucketed.read(spark, root, "t", one.select("id", "part"))
    assert [r.text for r in found.collect()] == ["u35"] and all(f"__bucket={bucket}/" in f for f in found.inputFiles())
    # a batch that changes nothing publishes no bucket
    before = versions.versions(spark, root)[1]
    assert [r.op for r in bucketed.upsert(one, root, "t", KEY).collect()] == ["unchanged"] and versions.versions(spark, root)[1] == before


def test_batches_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    bucketed.upsert(spark.sql(OLD), root, "t", KEY, buckets=4)
    batches = [spark.sql(OLD).filter(F.col("id") % 3 == i).withColumn("text", F.lit(f"batch{i}")) for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda b: bucketed.upsert(b, root, "t", KEY), batches))
    assert {(r.id, r.text) for r in bucketed.read(spark, root, "t").collect()} == {(i, f"batch{i % 3}") for i in range(60)}


def test_empty(spark, tmp_path):
    root, none = str(tmp_path), spark.sql(OLD).limit(0)
    assert bucketed.upsert(none, root, "t", KEY).count() == 0 and bucketed.read(spark, root, "t") is None
    bucketed.upsert(spark.sql(OLD), root, "t", KEY, buckets=4)
    assert bucketed.upsert(none, root, "t", KEY, Policy(delete_missing=True)).filter("op = 'deleted'").count() == 60
    assert bucketed.read(spark, root, "t") is None
