import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import dumps, objects

ODD = ["}", "{", "\\", '"', "\\\"}", "é", "日本", "😀", "a}b", "],[", "\n", "\\u007d", ",", ":", "", "\t{", "x" * 40, "\\\\"]


def some_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 4)
    if kind == 4:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {"".join(rng.choices(ODD, k=2)) + str(i): some_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [rng.randrange(1000), None, True, "".join(rng.choices(ODD, k=rng.randrange(6)))][kind]


def some_object(rng, n):
    return {f"{i}" + "".join(rng.choices(ODD, k=2)): some_value(rng) for i in range(n)}


@pytest.fixture
def cut(spark):
    """Sets the size of ranges in bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def at(size):
        spark.conf.set(names[0], f"{size}b")
        spark.conf.set(names[1], "1b")

    yield at
    for n, v in before.items():
        spark.conf.set(n, v)


def found(df):
    return sorted((r.k, r.v) for r in df.select(F.col("entry_id").alias("k"), F.to_json("entry").alias("v")).collect())


def whole(spark, path):
    """The same by reading a file at once."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,variant>").alias("m"))
    return found(one.select(F.explode("m").alias("entry_id", "entry")))


@pytest.mark.parametrize("size,n", [(9, 4), (60, 12), (700, 60), (10_000_000, 60)])
def test_like_reading_at_once(spark, tmp_path, cut, size, n):
    rng = random.Random(size)
    rows = some_object(rng, n)
    for name, told in {"a": dict(ensure_ascii=False), "b": dict(indent=2)}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({name + k: v for k, v in rows.items()}, **told), encoding="utf-8")
    want = whole(spark, str(tmp_path))
    assert len(want) == 2 * len(rows)
    cut(size)
    assert found(objects.entries(spark, str(tmp_path))) == want


def test_order_and_members_across_ranges(spark, tmp_path, cut):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({f"k{i}": {"a": [{"b": "}" * 20}] * 4} for i in range(5)}))
    cut(100)
    rows = objects.members(spark, str(path)).orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(1, 6))
    assert [json.loads("{" + r.text + "}") for r in rows] == [{f"k{i}": {"a": [{"b": "}" * 20}] * 4}} for i in range(5)]


def test_edges(spark, tmp_path, cut):
    texts = ["", "{}", " { } \n", "[1, {}]", '{"a": 1}\n{"b": {"c": 2}}\n', '{"d": 1, "d": 2}', '\n{"e": "}"}   \n\n', "no json", '{"f": {"g": 1']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    for size in (3, 1000):
        cut(size)
        got = found(objects.entries(spark, str(tmp_path)))
        assert got == [("a", "1"), ("b", '{"c":2}'), ("d", "1"), ("d", "2"), ("e", '"}"'), ("f", '{"g":1}')]


def test_summaries_combine(monkeypatch):
    """However a text is cut, the combined summaries of its parts are that of the whole."""
    rng = random.Random(4)
    data = json.dumps(some_object(rng, 60), ensure_ascii=False).encode()
    once = objects.Summary()
    once.read(data)
    for _ in range(100):
        cuts = sorted(rng.sample(range(len(data)), 20))
        parts = objects.Summary()
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            parts.read(data[a:b])
        assert (parts.ends[0], parts.rises[0], parts.members[0]) == (once.ends[0], once.rises[0], once.members[0])
    assert (once.ends[0], once.rises[0], once.members[0][1]) == (objects.OUTSIDE, 0, 60)


def test_small_slices(spark, tmp_path, monkeypatch):
    rows = some_object(random.Random(6), 50)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    data = path.read_bytes()
    monkeypatch.setattr(objects, "SLICE", 5)
    cutter, out = objects.Cutter(objects.OUTSIDE, 0, 0), []
    for some in objects._joined([data[i : i + 5] for i in range(0, len(data), 5)]):
        out += cutter.read(some)
    assert not list(cutter.finish())
    assert [m for m, _, _ in out] == list(range(1, 51)) and all(w for _, w, _ in out)
    assert {k: v for _, _, t in out for k, v in json.loads(b"{" + t + b"}").items()} == rows


def test_dump_of_one_object(spark, tmp_path, cut):
    path = tmp_path / "dump.json"
    path.write_text(json.dumps({f"e{i}": {"label": f"L{i}", "social_media": {"x": [{"a": j} for j in range(i % 3)]}} for i in range(50)}))
    cut(200)
    assert dumps.raw_posts(dumps.entries(spark, str(path))).count() == sum(i % 3 for i in range(50))


def test_written_objects(spark, tmp_path, cut):
    rows = spark.range(0, 200, 1, 3).selectExpr("concat('k\"', id) AS entry_id", "to_json(struct(id, repeat('}', int(id % 5)) AS t)) AS entry")
    objects.write(rows, str(tmp_path / "dump"))
    files = list((tmp_path / "dump").glob("part-*"))
    assert len(files) == 3 and sum(len(json.loads(f.read_text())) for f in files) == 200
    cut(900)
    assert found(objects.entries(spark, str(tmp_path / "dump"))) == sorted((f'k"{i}', json.dumps({"id": i, "t": "}" * (i % 5)}, separators=(",", ":"))) for i in range(200))
    objects.write(rows.limit(0), str(tmp_path / "none"))
    assert objects.entries(spark, str(tmp_path / "none")).count() == 0
