import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import redaction, search, segments, triggers
from sparkloom.operators.redaction import Rule
from sparkloom.sources import versions

SCHEMA = "id long, text string"
QUERIES = ["quick", '"brown fox"', "-quick", "x | lazy dog", "f*", '"x jumps"']
WORDS = ["quick", "brown", "fox", "jumps", "lazy", "dog", "fool", "of"]


def answers(index):
    return {q: sorted(r.id for r in search.search_by_index(index, "id", q, cap=None).collect()) for q in QUERIES}


def test_like_a_fresh_index(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "index")
    state, rules = {}, [Rule("fool", "x")]

    def frame(rows):
        return spark.createDataFrame(sorted(rows.items()), SCHEMA)

    def redacted(rows):
        return redaction.redact_posts(frame(rows), "text", rules, key="id")

    assert segments.read(spark, root, "id") is None
    for step in range(5):
        came = {rng.randrange(60): " ".join(rng.choices(WORDS, k=rng.randrange(0, 7))) for _ in range([60, 8, 5, 3, 2][step])}
        gone = rng.sample(sorted(state), 6) if state else []
        state = {k: v for k, v in state.items() if k not in gone} | came
        segments.add(redacted(came), "id", "text", root, frame(dict.fromkeys(gone, "")))
        if step == 2:
            after = [*rules, Rule("of", "quick")]
            changed = segments.redaction_changes(frame(state), "text", "id", rules, after)
            assert sorted(r.id for r in changed.select("id").collect()) == sorted(k for k, v in state.items() if "of" in v.split())
            segments.add(changed, "id", "text", root)
            rules = after
        if step in (2, 4):
            fresh = answers(search.token_table(redacted(state), "id", "text"))
            assert answers(segments.read(spark, root, "id")) == fresh
    before = len(segments.segments(versions.versions(spark, root)[1]))
    assert segments.compact(spark, root, "id", fan=3) > 0
    held = segments.segments(versions.versions(spark, root)[1])
    assert len(held) < before and answers(segments.read(spark, root, "id")) == fresh
    # one segment is left: nothing dead and no key that went
    segments.compact(spark, root, "id", fan=2)
    segments.compact(spark, root, "id", fan=2)
    whole = segments.read(spark, root, "id")
    assert answers(whole) == fresh and "Join" not in whole._jdf.queryExecution().toString()
    assert versions.vacuum(spark, root) and answers(segments.read(spark, root, "id")) == fresh


def test_tiers():
    assert segments._run([], 4) == segments._run([1000, 5, 5, 5], 4) == segments._run([1000, 900], 4) == 0
    assert segments._run([1000, 5, 6, 4, 7], 4) == 4 and segments._run([1000, 900, 800, 700, 1], 4) == 5
    assert segments._run([1000, 1, 1, 1, 1, 30], 4) == 5 and segments._run([1000, 0, 0, 0, 0], 4) == 4


def test_a_segment_added_during_a_merge_stays(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    for i in range(3):
        segments.add(spark.createDataFrame([(i, "quick")], SCHEMA), "id", "text", root)
    write, done = segments._write, []

    def interrupted(*args):
        places = write(*args)
        if not done:
            done.append(1)
            segments.add(spark.createDataFrame([(1, "brown")], SCHEMA), "id", "text", root)
        return places

    monkeypatch.setattr(segments, "_write", interrupted)
    assert segments.compact(spark, root, "id", fan=3) >= 1
    assert sorted((r.id, r.token) for r in segments.read(spark, root, "id").collect()) == [(0, "quick"), (1, "brown"), (2, "quick")]


def test_by_the_change_log(spark, tmp_path):
    root = str(tmp_path / "index")
    hooks = triggers.Triggers()
    hooks.add("posts", ["id"], segments.hook("id", "text", root))
    one = spark.createDataFrame([(1, "quick"), (2, "brown fox"), (3, "lazy")], SCHEMA)
    two = spark.createDataFrame([(1, "quick"), (2, "quick dog"), (4, "x")], SCHEMA)
    hooks.fire({}, {"posts": one})
    hooks.fire({"posts": one}, {"posts": two})
    hooks.fire({"posts": two}, {"posts": two})
    assert len(segments.segments(versions.versions(spark, root)[1])) == 2
    assert answers(segments.read(spark, root, "id")) == answers(search.token_table(two, "id", "text"))


def test_a_text_is_taken_apart_once(spark, tmp_path):
    root, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = spark.range(40).select("id", F.udf(read, "string")(F.concat(F.lit("quick brown "), "id")).alias("text"))
    segments.add(docs, "id", "text", root)
    assert seen.value == 40 and segments.read(spark, root, "id").count() == 120


@pytest.mark.parametrize("fan", [2, 9])
def test_tokens_left_to_the_merge(spark, tmp_path, fan, monkeypatch):
    root, texts = str(tmp_path / "index"), {1: "quick brown fox", 2: "", 3: None, 4: "x jumps", 5: "\u017fool  of -- \u0130x"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), SCHEMA)
    written, real = [], segments.write_sorted
    monkeypatch.setattr(segments, "write_sorted", lambda rows, path: (written.append(path), real(rows, path)))
    segments.add(frame(texts), "id", "text", root, later=True)
    segments.add(frame({4: "lazy dog"}), "id", "text", root, frame({1: ""}).select("id"), later=True)
    segments.add(frame({2: "quick"}), "id", "text", root, later=True)
    want = answers(search.token_table(frame({2: "quick", 3: None, 4: "lazy dog", 5: texts[5]}), "id", "text"))
    assert not written and answers(segments.read(spark, root, "id")) == want
    segments.compact(spark, root, "id", fan=fan)
    held = segments.segments(versions.versions(spark, root)[1])
    assert len(written) >= len(held) and all(tokens for tokens, _, _ in held.values()) and answers(segments.read(spark, root, "id")) == want
    assert {(r.id, r.token, r.pos) for r in segments.read(spark, root, "id").collect()} == {(r.id, r.token, r.pos) for r in search.token_table(frame({2: "quick", 3: None, 4: "lazy dog", 5: texts[5]}), "id", "text").collect()}
