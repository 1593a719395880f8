import random

from pyspark.sql import functions as F

from sparkloom.operators import people


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_many_names_like_few(spark):
    rng = random.Random(11)
    words = ["Anna", "anna", "MÜLLER", "Straße", "STRASSE", "von", "der", "Weiß-Blau", "İpek", "ipek", "ΣΟΦΟΣ", "σοφος", "x", "K", "k", "a.b", "\\E", "é"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(300)}) + ["...", "", "Anna"]
    texts = [(i, rng.choice(["", "-", " "]).join(["", *[rng.choice([" ", ", ", "-", "."]) + rng.choice(words) for _ in range(rng.randrange(12))]])) for i in range(120)] + [(500, None), (501, "")]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(texts, "id long, text string")
    # the pattern of every name against every text
    met = n.distinct().crossJoin(t).filter("name RLIKE '(?U)\\\\w'").filter(F.regexp_like("text", people._whole(F.col("name"))))
    hits = {r.name: (r.id, r.n) for r in met.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).collect()}
    want = sorted(((x, *hits.get(x, (None, 0))) for x in names), key=str)
    assert rows(people.many_whole_word_matches(n, t)) == rows(people.many_whole_word_matches(n, t, names_bytes=500)) == want
    assert sum(r[2] > 0 for r in want) > 20
    assert rows(people.many_whole_word_matches(n.limit(0), t)) == [] and all(r[2] == 0 for r in rows(people.many_whole_word_matches(n, t.limit(0))))


def test_ten_thousand_names_that_begin_alike(spark):
    n = spark.range(10_000).selectExpr("concat('Graf Name', id) AS name")
    t = spark.range(3000).selectExpr("id", "concat('gestern GRAF NAME', id * 3, ' und Graf Namenlos') AS text")
    got = {r.name: (r.id, r.matches) for r in people.many_whole_word_matches(n, t).collect()}
    assert len(got) == 10_000 and {k for k, v in got.items() if v[1]} == {f"Graf Name{i * 3}" for i in range(3000)} and got["Graf Name30"] == (10, 1)


def test_many_bytes_of_names_meet_texts_by_words(spark, monkeypatch):
    """No worker holds the names: they aren't collected, whatever their number; words that fold to several characters or by their place stay apart or meet."""
    monkeypatch.setattr(people, "_named", None)
    made = ["a b c d e f g h", "a b c d e f g i", "ΑΣ", "ẞ-x", ".Anna.", "İ", "Weiß-Blau", "x"]
    n = spark.createDataFrame([(x,) for x in made], "name string")
    t = spark.createDataFrame([(1, "A B C D E F G H!"), (2, "ας.β ας"), (3, "ß-X"), (4, "o .anna. o.Anna."), (5, "i"), (6, "weiß-blau weiss-blau x-x"), (7, None), (7, "Anna"), (None, "x")], "id long, text string")
    met = n.crossJoin(t).filter(F.regexp_like("text", people._whole(F.col("name")))).groupBy("name").agg(F.count("*").alias("k")).collect()
    got = {r.name: r.matches for r in people.many_whole_word_matches(n, t, names_bytes=10).collect()}
    assert got == dict.fromkeys(made, 0) | {r.name: r.k for r in met} and got["ΑΣ"] == got["ẞ-x"] == got["İ"] == got["a b c d e f g h"] == 1 and got["a b c d e f g i"] == 0
