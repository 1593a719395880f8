import json

from sparkloom.operators import bucketed, upsert
from sparkloom.sources import versions
from sparkloom.streaming import freshness

SCHEMA = "k long, at timestamp, v string"
BATCHES = [
    [(1, "2024-01-02", "a"), (2, None, "undated"), (3, "2024-01-01", "c"), (3, "2024-01-05", "c2"), (9, None, "x")],
    [(1, "2024-01-01", "late"), (2, None, "undated again"), (3, "2024-01-05", "c2"), (4, "2024-01-01", "new")],
    [(2, "2023-01-01", "dated"), (1, None, "undated"), (9, None, "y")],
]


def test_batches_into_buckets(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    source.mkdir()
    state, changed = spark.createDataFrame([], SCHEMA), []
    for i, rows in enumerate(BATCHES):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "at": t and f"{t}T00:00:00Z", "v": v}) for k, t, v in rows))
        before = versions.versions(spark, root)[1]
        # each start goes on from the checkpoint of the one before
        freshness.follow_into_buckets(spark, str(source), SCHEMA, root, "t", checkpoint, ["k"], "at", buckets=32).awaitTermination()
        after = versions.versions(spark, root)[1]
        changed.append(sum(before.get(n) != p for n, p in after.items()))
        batch = spark.read.schema(SCHEMA).json(str(source / f"{i}.json"))
        state = spark.createDataFrame(freshness.apply_snapshots(state, batch, ["k"], "at").collect(), SCHEMA)
        assert sorted(map(str, bucketed.read(spark, root, "t").select("k", "at", "v").collect())) == sorted(map(str, state.collect()))
    assert {(r.k, r.v) for r in state.collect()} == {(1, "a"), (2, "dated"), (3, "c2"), (4, "new"), (9, "y")}
    # the second batch brings one key and changes another one, the third changes two
    assert changed[1] <= 2 and changed[2] <= 2
    # the same rows again publish no bucket
    last = versions.versions(spark, root)[1]
    bucketed.upsert(state, root, "t", ["k"], upsert.Policy(fresh="at"))
    assert versions.versions(spark, root)[1] == last
