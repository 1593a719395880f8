from pyspark.sql import functions as F

from sparkloom.operators import browse, checks, evidence, normalize, people, redaction, search, tree, upsert


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(tuple(r) for r in df.collect())


def test_tree(spark):
    paths = spark.createDataFrame([(["Parent"],), (["Parent", "Middle", "Child"],), (["Other", "Leaf"],)], "path array<string>")
    nodes = tree.build(paths)
    assert {("/".join(r.path), r.is_main) for r in nodes.collect()} == {("Parent", True), ("Parent/Middle", False), ("Parent/Middle/Child", True), ("Other", False), ("Other/Leaf", True)}
    members = spark.createDataFrame([(1, ["Parent", "Middle", "Child"]), (2, ["Parent"]), (2, ["Parent", "Middle", "Child"])], "item int, path array<string>")
    covered = tree.coverage(members, nodes, "item")
    assert {("/".join(r.path), r.covered) for r in covered.collect()} == {("Parent", 2), ("Parent/Middle/Child", 2)}
    shown = tree.main_topic_tree(members, nodes, "item", ["Parent"]).orderBy("nth").collect()
    assert [(r.label, r.depth, r.has_children, r.expanded, r.visible, r.selected) for r in shown] == [("Parent", 1, True, True, True, True), ("Child", 2, False, False, True, False)]
    stale = tree.main_topic_tree(members, nodes, "item", ["Other", "Leaf"]).orderBy("nth").collect()
    assert [(r.visible, r.selected) for r in stale] == [(True, False), (False, False)]


def test_upsert_is_idempotent_and_fresh(spark):
    kind = "id int, name string, n int, at timestamp"
    t = lambda s: s and __import__("datetime").datetime.fromisoformat(s)
    old = spark.createDataFrame([(1, "a", 1, t("2024-01-02")), (2, "b", 2, None), (3, "c", 3, t("2024-01-01"))], kind)
    new = spark.createDataFrame([(1, "x", 9, t("2024-01-01")), (2, "y", 2, t("2024-01-01")), (3, "z", 3, None), (4, "d", 4, None)], kind)
    changes = upsert.matched(old, new, ["id"], upsert.Policy(fresh="at"))
    assert rows(changes.select("id", "op")) == [(1, "unchanged"), (2, "updated"), (3, "unchanged"), (4, "created")]
    assert rows(upsert.field_changes(changes).filter("field = 'name'")) == [(2, "name", "b", "y")]
    state = upsert.new_state(changes)
    again = upsert.matched(state, new, ["id"], upsert.Policy(fresh="at"))
    assert again.filter("op NOT IN ('unchanged', 'kept')").count() == 0
    log = upsert.change_log({"account": changes}, "id").collect()
    assert [(r.table, r.changes) for r in log] == [("account", '{"created":["4"],"updated":["2"],"deleted":[]}')]


def test_redaction(spark):
    rules = [redaction.Rule("Badword", "[X]"), redaction.Rule(r"(\w+)@(\w+)", r"\2 at \g<1>$", is_regex=True), redaction.Rule("[", "y", is_regex=True), redaction.Rule("", "z"), redaction.Rule("off", "-", enabled=False)]
    own = redaction.rules_of_posts(spark, [(1, redaction.Rule("secret", "[Name]")), (2, redaction.Rule("secret", "no", enabled=False))])
    posts = spark.createDataFrame([(1, "BADWORD Badwords a@b secret off"), (2, "secret ärger@öl"), (3, None)], "post_id long, text string")
    assert rows(redaction.redact_posts(posts, "text", rules, own), "post_id") == [(1, "[X] Badwords b at a$ [Name] off"), (2, "secret öl at ärger$"), (3, None)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick Ärger brown"), (3, None)], "id int, text string")
    find = lambda q: rows(search.search(docs, "id", "text", q))
    assert find("quick") == [(1,), (2,)] and find("quick ärger") == [(2,)] and find('"quick brown"') == [(1,)] and find("qui* -fox") == [(2,)] and find("fox | ärger") == [(1,), (2,)] and find("  ") == []
    index = search.token_table(docs, "id", "text")
    for query in ("quick", "quick ärger", '"quick brown"', '"brown quick"', "qui* -fox", "fox | ärger", "  ", "-fox", "-fox | quick", '-"quick brown"', 'br* "the quick"', '"the quick" | "quick ärger"'):
        # a text without words is in no index
        assert rows(search.search_by_index(index, "id", query)) == [r for r in find(query) if r != (3,)], query
    assert rows(search.search(docs, "id", "text", "quick", cap=1)) == rows(search.search_by_index(index, "id", "quick", cap=1)) == [(1,)]
    assert search.search_path(spark, "/nowhere/at/all", "id", ["x"]) == (None, False)


def test_whole_words(spark):
    names = spark.createDataFrame([("Die Linke",), ("SPD",), ("CDU/CSU",), ("Straße",), ("A-B",), ("?",)], "name string")
    texts = spark.createDataFrame([(1, "die linke"), (2, "Fraktion SPD-nah"), (3, "spd (Bund)"), (4, "die CDU/CSU, SPD"), (5, "STRAßE a-b"), (6, "A-B-C ?"), (7, None)], "id int, text string")
    got = {r.name: (r.id, r.matches) for r in people.whole_word_matches(names, texts).collect()}
    assert got == {"Die Linke": (1, 1), "SPD": (3, 2), "CDU/CSU": (4, 1), "Straße": (5, 1), "A-B": (5, 1), "?": (None, 0)}


def test_resolution(spark):
    actors = spark.createDataFrame([(1, ["Thorsten Moriße", "TM"]), (2, ["Anna Muster"]), (3, ["Anna Muster"])], "actor int, names array<string>")
    index = people.name_index(actors, "actor", F.col("names"))
    labels = spark.createDataFrame([(1, "Thorsten Paul Morisse"), (2, "anna muster"), (3, "Nobody"), (4, "")], "id int, label string")
    assert rows(people.resolve(labels, "label", index).select("id", "actor", "reason"), "id") == [(1, 1, None), (2, None, "ambiguous"), (3, None, "unknown"), (4, None, "blank")]
    accounts = spark.createDataFrame([(7, "TM"), (7, "tm"), (8, "TM"), (8, "Nobody")], "account int, label string")
    assert rows(people.owners(accounts, "account", "label", index), "account") == [(7, 1, None), (8, None, "conflict")]


def test_mentions(spark):
    data = [(1, 0, [["A"], ["B"]], ["1"]), (1, 1, [["C"]], ["2", "3"])]
    df = spark.createDataFrame(data, "post int, nth int, topic array<array<string>>, footnote array<string>")
    merged = evidence.merged_reports(df, "post", "nth", ["topic", "footnote"])
    found, bad = evidence.expanded_mentions(merged, "post", ["topic", "footnote"], "topic", "footnote")
    assert rows(found.select("nth", "footnote"), "nth") == [(0, "1"), (1, "2"), (2, "3")] and bad.count() == 0
    checks.require(bad, "topic without footnote")


def test_parameters():
    assert [browse.param_int(x) for x in ("12", " 7 ", "²", "x", None, "")] == [12, 7, None, None, None, None]
    assert browse.param_date("2024-02-30") is None and browse.param_year("2024-x") == 2024 and browse.param_chapter(["x", "5", "6"]) == 5
    assert browse.years_to_dates(2019, 2021, 2019, 2021) == ("", "") and browse.years_to_dates(2020, 2021, 2019, 2021) == ("2020-01-01", "2021-12-31")
    assert browse.has_filters({"q": " "}) is False and browse.has_filters({"actor": "1"})


def test_normalized_references(spark):
    raw = '{"message_id": 5, "username": "u", "channel_id": 1, "fwd_from": {"from_id": null, "from_name": "n", "date": "d"}, "reactions": {"results": [{"reaction": {"emoticon": "x"}, "count": 3}]}}'
    df = spark.createDataFrame([("telegram", raw), ("myspace", "{}")], "platform string, body string").select("platform", F.parse_json("body").alias("raw"))
    (post,) = normalize.normalized(df).collect()
    assert post.platform_post_id == "5" and post.reactions == {"x": 3} and post.references[0].account.username == "n" and post.references[0].platform_post_id is None


def test_shards(spark):
    df = evidence.shards(spark.range(7), ["id"], 3)
    assert rows(df) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]
    assert rows(evidence.shards(spark.range(2), ["id"], 3)) == [(0, 1), (1, 2)]
