import random
import zlib

from sparkloom.llm.sharding import SHARDS, byte_shards

SCHEMA = "doc_id long, text string, size string"


def test_against_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(0, 300), "x") for i in rng.sample(range(10_000), 500)]
    rows += [(None, "a", "x"), (None, None, "x"), (77_777, None, "x")] + [(20_000, "same", "x")] * 300 + [(30_000, "z" * 20_000, "x")]
    got = byte_shards(spark.createDataFrame(rows, SCHEMA)).collect()
    size = lambda t: len((t or "").encode()) + 1
    ordered = sorted(((d is not None, d or 0, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows))
    total, at, want = sum(s for _, _, s, _ in ordered), 0, []
    for some, d, s, c in ordered:
        want.append((d if some else None, s, c, at * SHARDS // total))
        at += s
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard) for r in got), key=str) == sorted(want, key=str)
    for shard in range(SHARDS):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(w[3] == shard for w in want)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_empty_and_single(spark):
    assert byte_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r.shard, r.slot) for r in byte_shards(spark.createDataFrame([(1, None, "x")], SCHEMA)).collect()] == [(0, 0)]
