"""Queries that take whole tables and whole texts, against plain versions on small tables."""

import html
import re

import duckdb

from sparkloom import registry


def made(spark, folder, name, tables):
    """The rows of a query on given tables."""
    for t, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{t}.parquet")
    return sorted(tuple(r) for r in registry.queries()[name](spark, str(folder)).collect())


def both(spark, folder, name, tables):
    """The rows of a query by Spark and by its SQL, on given tables."""
    con = duckdb.connect()
    got = made(spark, folder, name, tables)
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in cursor.description]
    columns = registry.queries()[name](spark, str(folder)).columns
    return got, sorted(tuple(r[at.index(c)] for c in columns) for r in cursor.fetchall())


def test_escape_whole_pages(spark, tmp_path):
    rows = [(1, "u", "<p class='a'>" + "x & \"y\" " * 200 + "</p>"), (2, "u", "short < text"), (3, "u", "")]
    got, sql = both(spark, tmp_path, "escape_html", {"pages": (rows, "page_id long, url string, html string")})
    assert got == sql == [(i, html.escape(x)) for i, _, x in rows]


def topic(x):
    x = re.sub(r"(?i)(?:https?://|www\.)\S+", " ", x)
    x = re.sub(r"(?<!\w)[@#](\w+)", lambda m: m[1].replace("_", " "), x)
    x = "\n".join(line.strip() for line in re.sub(r"[^\S\n]+", " ", x).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", x).strip()


def test_topic_text_of_whole_texts(spark, tmp_path):
    rows = [(1, "word " * 30 + "the  end\n\n\n\nhttp://a.example/b_c last"), (2, "short"), (3, "words_of a@b_c kept " * 40)]
    got, sql = both(spark, tmp_path, "clean_topic_text", {"documents": ([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string")})
    head = "see https://x.example/{}/a_b  now\t @john_doe and #some_tag_here\n\n\n\n WWW.site.org "
    assert got == sql == [(i, topic(head.format(i) + x)) for i, x in rows]


def test_tags_of_any_length(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import text as fx

    rows = ["@" + "ab_" * 150 + "c_d plain_word", "_@a_b", "#_a__b_ x_y", "a@b_c_d #e_f@g_h", "@ä_ö_ü_ #_", "_a @@b_c", "a\n_b\n@c_d_\n_e"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", fx.topic_text(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [topic(x) for x in rows]


def test_sync_of_every_order(spark, tmp_path):
    # order 1: one line of each kind; 5: only an old one, so it is not touched; 7: both
    line = [(1, 1, 5.0), (1, 2, 20.0), (1, 3, 45.0), (5, 1, 5.0), (7, 1, 20.0), (7, 1, 20.0)]
    got, sql = both(spark, tmp_path, "mention_sync", {"lineitem": (line, "l_orderkey long, l_linenumber int, l_quantity double")})
    assert got == sql == [(1, 1, "deleted"), (1, 2, "unchanged"), (1, 3, "created"), (7, 1, "unchanged")]


def test_orphans_of_every_id(spark, tmp_path):
    tables = {"labels": ([(1, 1, 0), (7, 1, 0), (8, 0, 1), (14, 0, 1)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, "a"), (14, "b")], "item_id long, text string")}
    got, sql = both(spark, tmp_path, "check_orphans", tables)
    assert got == sql == [(7,), (8,)]


TEXTS = [
    "Idiot of the Loser, with it from", "Ärger of Öl: idiot, IDIOT, éidiot idioté; Loserä loser", "ofé of the éthe thé THE x", "was of the Wié with from", "vous from withé", "sin with ñ from", "of the idiot was wing",
    "été of the été from wiße", "1² naïve_x ÄRGER", "",
]
LANGS = ["en", "de", "fr", "es", None]
DOCUMENTS = ([(i, x, LANGS[i // len(TEXTS)]) for i, x in enumerate(TEXTS * 5)], "doc_id long, text string, lang string")
TOXIC = {1, 2, 13, 24}


# the SQL of these has ASCII word borders, so plain Python is what they are compared with here
def test_redaction_in_every_language(spark, tmp_path):
    clean = lambda x: re.sub(r"(?i)\b(lo)(ser)\b", r"\2-\1", re.sub(r"(?i)\bidiot\b", "[X]", x))
    assert made(spark, tmp_path, "redact_global", {"documents": DOCUMENTS}) == [(i, clean(x)) for i, x, _ in DOCUMENTS[0]]


def test_scoped_redaction_in_every_language(spark, tmp_path):
    labels = ([(i, 1, int(i in TOXIC)) for i in range(0, 40)], "doc_id long, quality int, toxic int")
    first = {i: re.sub(r"(?i)\bof\b", "[A]", x) for i, x, _ in DOCUMENTS[0]}
    want = [(i, re.sub(r"(?i)\bthe\b", "[B]", x) if i in TOXIC else x) for i, x in first.items()]
    assert made(spark, tmp_path, "redact_scoped", {"documents": DOCUMENTS, "labels": labels}) == want


def words(x):
    return [w for w in re.split(r"\W+", x.lower().replace("²", " ")) if w]  # a raised 2 is no word for the JVM


def test_search_in_every_language(spark, tmp_path):
    want = [(i,) for i, x, _ in DOCUMENTS[0] if {"with", "from"} <= set(words(x))]
    assert made(spark, tmp_path, "search_all_terms", {"documents": DOCUMENTS}) == want
    held = lambda w: " of the " in f" {' '.join(w)} " and "idiot" not in w and bool({"was", "from"} & set(w)) and any(x.startswith("wi") for x in w)
    found = sorted(tuple(r) for r in registry.queries()["search_query"](spark, str(tmp_path)).collect())
    assert found == [(i,) for i, x, _ in DOCUMENTS[0] if held(words(x))]


def test_token_counts_of_every_text(spark, tmp_path):
    got, sql = both(spark, tmp_path, "token_counts", {"documents": DOCUMENTS})
    count, docs = {}, {}
    for i, x, _ in DOCUMENTS[0]:
        for w in words(x):
            count[w] = count.get(w, 0) + 1
            docs.setdefault(w, set()).add(i)
    assert got == sql == sorted((w, n, len(docs[w])) for w, n in count.items())


def test_topic_text_in_every_language(spark, tmp_path):
    got, sql = both(spark, tmp_path, "clean_topic_text", {"documents": DOCUMENTS})
    head = "see https://x.example/{}/a_b  now\t @john_doe and #some_tag_here\n\n\n\n WWW.site.org "
    assert got == sql == [(i, topic(head.format(i) + x)) for i, x, _ in DOCUMENTS[0]]
