import csv
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import dumps, pages, rules, sheets, sinks
from sparkloom.streaming import freshness


def test_dump(spark, tmp_path):
    dump = {"e1": {"Label": "Muster, Max", "ent_type": "p", "social_media": {"twitter": [{"tweet_id": "1"}, {"tweet_id": "2"}], "x": []}}, "e2": {"label": "Verband", "ent_type": "o"}}
    (tmp_path / "d.json").write_text(json.dumps(dump))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"entry_id": k, "entry": v}) for k, v in dump.items()))
    for name in ("d.json", "d.jsonl"):
        entries = dumps.entries(spark, str(tmp_path / name))
        posts = dumps.raw_posts(entries).orderBy("ordinal").collect()
        assert [(p.entry_id, p.label, p.platform, p.ordinal) for p in posts] == [("e1", "Muster, Max", "twitter", 0), ("e1", "Muster, Max", "twitter", 1)]
        assert [r.label for r in dumps.labels_of(entries, "o").collect()] == ["Verband"]


def test_side_inputs(spark, tmp_path):
    assert dumps.ledger(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "l.json").write_text('{"a": {"reviewed_at": "t", "alt_text_edited": "x"}}')
    assert [tuple(r) for r in dumps.ledger(spark, str(tmp_path / "l.json")).collect()] == [("a", "t", "x")]
    (tmp_path / "a.json").write_text(json.dumps([{"id": "i", "status": "OK", "alt_text": "one"}, {"id": "i", "status": "OK", "alt_text": "two"}, {"id": "j", "status": "ERROR", "alt_text": "x"}, {"id": "k", "status": "OK", "alt_text": " "}]))
    assert [tuple(r) for r in dumps.alt_texts(spark, str(tmp_path / "a.json")).collect()] == [("i", "two")]
    (tmp_path / "r.json").write_text(json.dumps([{"FdS_links": "f", "capitle_structur": [["A"], ["B", "C"]], "urls_zur_webseite": ["u", "v", "w"]}, {"FdS_links": "g", "capitle_structur": [["A"], ["B"]], "urls_zur_webseite": ["one"]}]))
    got = {r.fds_link: (r.single, r.by_path) for r in dumps.report_addresses(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"f": (None, {'["A"]': "u", '["B","C"]': "v"}), "g": ("one", None)}


def test_rules(tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("# why\nkind,wrong,correct,note\nprefix,KV,Kreisverband,\nexact,a,b,\nexact,a,c,\nexact,,x,\n")
    assert rules.label_rules(str(path)) == ({"a": "c"}, {"KV": "Kreisverband"}) and rules.label_rules("/none") == ({}, {})
    path.write_text("kind,key,level\nprefix,Kreis,K\nprefix,Kreisverband,REVIEW\nexact,X,L\n")
    assert rules.level_rules(str(path)) == ({"X": "L"}, [("Kreisverband", "REVIEW"), ("Kreis", "K")])


def test_pages(spark, tmp_path):
    for at in (0, 2):
        data = [{"id": at + i, "label": f"r{at + i}"} for i in range(2)]
        (tmp_path / f"{at}.json").write_text(json.dumps({"meta": {"result": {"total": 4}}, "data": data}))
    pages.register(spark)
    df = spark.read.format("paged").option("url", f"file://{tmp_path}").option("page_size", 2).load()
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3] and df.rdd.getNumPartitions() == 2
    assert [r.id for r in df.filter(F.col("id").isin(1, 3)).orderBy("id").collect()] == [1, 3]


def test_sheets_and_exports(spark, tmp_path):
    sheets.write(str(tmp_path / "a.xlsx"), ["id", "alt_text_edited", "x"], [["k1", "new <text> & ü", 1], ["k2", None, 2]])
    assert list(sheets.review_rows(str(tmp_path))) == [{"id": "k1", "alt_text_edited": "new <text> & ü"}, {"id": "k2", "alt_text_edited": ""}]
    with pytest.raises(ValueError):
        list(sheets.read(str(tmp_path / "a.xlsx"), ["absent"]))
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "n int, t string")
    sinks.export(df.orderBy("n"), str(tmp_path / "e.xlsx"), "xlsx")
    assert list(sheets.read(str(tmp_path / "e.xlsx"), ["n", "t"])) == [{"n": "1", "t": 'a,"b"'}, {"n": "2", "t": ""}]
    sinks.export(df.coalesce(1), str(tmp_path / "e.csv"), "csv")
    (part,) = (tmp_path / "e.csv").glob("part-*.csv")
    assert list(csv.reader(part.open())) == [["n", "t"], ["1", 'a,"b"'], ["2", ""]]
    assert sinks.file_name("csv", 3) == "export_3.csv"
    with pytest.raises(ValueError):
        sinks.file_name("pdf")


def test_publish_and_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "id int, name string, at timestamp"
    for i, lines in enumerate((['{"id":1,"name":"a","at":"2024-01-02T00:00:00"}'], ['{"id":1,"name":"old","at":"2024-01-01T00:00:00"}', '{"id":2,"name":"b","at":"2024-01-01T00:00:00"}'], ['{"id":2,"name":"c","at":"2024-01-03T00:00:00"}'])):
        (source / f"{i}.json").write_text("\n".join(lines))
        freshness.follow(spark, str(source), schema, root, str(tmp_path / "cp"), ["id"], "at").awaitTermination()
    assert sorted((r.id, r.name) for r in sinks.current(spark, root).collect()) == [(1, "a"), (2, "c")]
