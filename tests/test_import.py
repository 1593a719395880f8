import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import align, display, importing, layout, people, structdiff
from sparkloom.operators.normalize import ACCOUNT, REFERENCE

POST = (
    "platform string, ordinal int, actor long, account_labels array<string>, platform_post_id string, url string, created_at string, edited_at string, collected_at string, text string, title string, description string, "
    f"view_count long, like_count long, comment_count long, share_count long, account {ACCOUNT}, references array<{REFERENCE}>, topic array<array<string>>, footnote_id array<string>, fliesstext array<string>, report_urls array<string>, starts array<string>, ends array<string>"
)


def account(user="u1", name="Name", verified=None):
    return {"username": name, "platform_user_id": user, "display_name": name, "description": None, "url": None, "follower_count": 5, "is_verified": verified, "is_blue_verified": None}


def post(ordinal=0, actor=1, post_id="p1", text="t", collected="2024-01-02T00:00:00", topics=((["Root", "Root", "Leaf"], "1"),), references=(), labels=("Max Muster",), **own):
    row = {"platform": "twitter", "ordinal": ordinal, "actor": actor, "account_labels": list(labels), "platform_post_id": post_id, "url": "http://x", "created_at": "2024-01-01T00:00:00", "collected_at": collected, "text": text, "account": account(), "references": list(references),
           "topic": [t for t, _ in topics], "footnote_id": [f for _, f in topics], "fliesstext": ["c"] * len(topics), "report_urls": [], "starts": ["0:05"], "ends": []}
    return row | own


@pytest.fixture(scope="module")
def index(spark):
    return people.name_index(spark.createDataFrame([(1, ["Max Muster"]), (2, ["Eva Beispiel"])], "actor long, names array<string>"), "actor", F.col("names"))


def run(spark, index, posts, stored=None):
    found = importing.run(spark.createDataFrame(posts, POST), stored or importing.empty_state(spark), index)
    # as a table written between two runs
    state = {t: spark.createDataFrame(found.state(t).collect(), importing.SCHEMAS[t]) for t in importing.SCHEMAS}
    return state, {r.table: r.changes for r in found.log().collect()}


def test_fresh_import_and_again(spark, index):
    posts = [post(), post(ordinal=1, actor=2, topics=((["B"], "2"),))]
    state, log = run(spark, index, posts)
    assert {t: df.count() for t, df in state.items()} == {"account": 1, "post": 1, "evidence": 1, "mention": 2, "originator": 2}
    assert set(log) == {"account", "post", "evidence", "mention", "originator"} and state["account"].first().actor == 1
    mentions = {m.footnote: m for m in state["mention"].collect()}
    assert mentions["1"].chapter_structure == ["Root", "Leaf"] and mentions["1"].originator == 1 and mentions["2"].originator == 2 and mentions["1"].start_s == 5 and mentions["2"].report_url == ""
    assert run(spark, index, posts, state)[1] == {}


def test_freshness(spark, index):
    state, _ = run(spark, index, [post()])
    older, log = run(spark, index, [post(collected="2024-01-01T00:00:00", account=account(name="Old"))], state)
    assert older["account"].first().username == "Name" and "account" not in log
    newer, log = run(spark, index, [post(collected="2024-02-01T00:00:00", account=account(name="New"))], state)
    assert newer["account"].first().username == "New" and set(log) == {"account", "evidence"}
    undated, log = run(spark, index, [post(collected=None, account=account(name="None"))], newer)
    assert undated["account"].first().username == "New" and str(undated["evidence"].first().documentation_date) == "2024-02-01" and log == {}


def test_mentions_are_synchronised(spark, index):
    state, _ = run(spark, index, [post(topics=((["A"], "1"), (["B"], "2")))])
    changed, log = run(spark, index, [post(topics=((["B"], "2"), (["C"], "3")))], state)
    assert sorted(m.footnote for m in changed["mention"].collect()) == ["2", "3"] and set(log) == {"mention"}
    kept, log = run(spark, index, [post(topics=())], state)
    assert kept["mention"].count() == 2 and log == {}
    with pytest.raises(ValueError, match="footnote"):
        run(spark, index, [post(topics=((["A"], None),))])


def test_references_make_stubs(spark, index):
    reference = {"platform_post_id": "q1", "url": "http://q", "created_at": None, "text": "quoted", "account": account("u2", "Other", True)}
    state, _ = run(spark, index, [post(references=[reference])])
    assert {(p.platform_post_id, p.redistributes) for p in state["post"].collect()} == {("p1", "q1"), ("q1", None)} and state["evidence"].count() == 1
    assert {(a.platform_user_id, a.is_verified) for a in state["account"].collect()} == {("u1", None), ("u2", True)}
    full, _ = run(spark, index, [post(post_id="q1", text="full", account=account("u2", "Other2"), labels=("Eva Beispiel",), collected=None)], state)
    assert {(p.platform_post_id, p.text) for p in full["post"].collect()} == {("p1", "t"), ("q1", "full")} and {a.actor for a in full["account"].collect()} == {1, 2}


def test_conflicting_labels_leave_no_owner(spark, index):
    state, _ = run(spark, index, [post(labels=("Max Muster", "Eva Beispiel"))])
    assert state["account"].first().actor is None


def test_alignment(spark):
    organisations = spark.createDataFrame([("Verb. Nord", ["x"]), ("Landesverband Ost", [])], "name string, aliases array<string>")
    labels = spark.createDataFrame([("Landesverband Nord",), ("Landesverband Ost",), ("Kreisverband Süd",), ("Jugend Rest",), ("Sonst",)], "label string")
    pairs = lambda rows: spark.createDataFrame(rows, "rule string, value string")
    plan = align.organisation_plan(organisations, labels, pairs([("Verb. Nord", "Landesverband Nord")]), pairs([("Sonst", "Umfeld")]), pairs([("Kreisverband", "Kreis"), ("Jugend", "REVIEW")]))
    assert {(r.category, r.name, r.level) for r in plan.collect()} == {("rename", "Verb. Nord", None), ("create", "Kreisverband Süd", "Kreis"), ("create", "Sonst", "Umfeld"), ("review", "Jugend Rest", None)}
    assert {(r.name, tuple(r.aliases)) for r in align.renamed(organisations, plan).collect()} == {("Landesverband Nord", ("x", "Verb. Nord")), ("Landesverband Ost", ()), ("Kreisverband Süd", ()), ("Sonst", ())}
    persons = spark.createDataFrame([(1, "Anna Maria", "von Muster"), (2, "Bo", "Beispiel")], "person long, first_name string, last_name string")
    plan = align.person_plan(persons, spark.createDataFrame([("Anna von Muster",), ("Neu Person",), ("Eins Zwei Drei",)], "label string"))
    assert {(r.category, r.label) for r in plan.collect()} == {("rename", "Anna von Muster"), ("create", "Neu Person"), ("review", "Eins Zwei Drei")}
    assert [tuple(r) for r in align.split_names(plan, persons).collect()] == [(1, "Anna", "von Muster")]
    held = spark.createDataFrame([(1, "Max Muster", "alt")], "person long, name string, label string")
    tags = spark.createDataFrame([(1, "Sprecher*in", None)], "person long, role string, level string")
    replaced, both = align.position_overrides(held, spark.createDataFrame([("max muster", "MdB")], "name string, position string"), tags, ["AfD-Bundespartei"])
    assert replaced.first().label == "MdB" and {(r.role, r.level) for r in both.collect()} == {("Sprecher*in", None), ("Abgeordnete*r", "AfD-Bundespartei")}


def difference(spark, a, b):
    dumps = [spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()], "entry_id string, j string").select("entry_id", F.parse_json("j").alias("entry")) for d in (a, b)]
    return sorted(r.line for r in structdiff.diff(*dumps).collect())


def test_structural_diff(spark):
    a = {"x": [1, {"k": 1, "l": 2}, 3], "y": "s", "z": {"label": "gone", "n": 1}, "same": {"b": [1, 2], "a": None}}
    b = {"x": [3, {"k": 1, "l": 5}, 1], "y": "t", "w": None, "same": {"a": None, "b": [2, 1]}}
    assert difference(spark, a, b) == sorted(["+ /w", "~ /x[]/l : 2 -> 5", '~ /y : "s" -> "t"', '- /z : "gone"']) and difference(spark, a, a) == []


def test_structural_diff_of_named_elements(spark):
    a = {"p": {"posts": [{"id": 1, "t": "a", "n": 1}, {"id": 2, "t": "b", "label": "B"}, "s"], "m": 1}}
    b = {"p": {"posts": ["u", {"id": 1, "t": "a", "n": 9}, {"id": 3, "t": "c"}], "o": [2]}}
    # 2 and 3 share no entry, so they are one gone and one new
    assert difference(spark, a, b) == sorted(["- /p/m : 1", "+ /p/o : [2]", "~ /p/posts[id=1]/n : 1 -> 9", '- /p/posts[id=2] : "B"', '- /p/posts[] : "s"', '+ /p/posts[] : "u"', "+ /p/posts[id=3]"])


def test_structural_diff_of_lists_and_odd_values(spark):
    a = {"l": [[1, 2], [3], {"a": 1, "b": 1}, {"a": 1, "c": 2}, "x", "x", "ü \" : ,"], "o": {"k": {"deep": [{"n": [1]}]}}, "t": {"v": [1]}, "u": {"label": None}}
    b = {"l": [{"a": 1, "b": 2}, [1, 5], "x"], "o": {"k": {"deep": [{"n": [1], "m": 2}]}}, "t": {"v": {"a": 1}}}
    want = [
        "+ /l[][] : 5", "- /l[][] : 3",  # the later lists belong together
        "- /l[] : [1, 2]", "~ /l[]/b : 1 -> 2", '- /l[] : {"a": 1, "c": 2}', '- /l[] : "x"', '- /l[] : "ü \\" : ,"',
        "+ /o/k/deep[]/m : 2", '~ /t/v : [1] -> {"a": 1}', "- /u",
    ]
    want = [*want, "+ /l[][] : 1"]
    assert difference(spark, a, b) == sorted(want)


def test_display_and_layout(spark):
    m = spark.createDataFrame([(["A", "B"], "l", None, 65, "c", True), ([], "l", None, None, "c", False)], "path array<string>, label string, s long, e long, citation string, video boolean")
    got = display.mention_rows(m, "path", "label", "s", "e", "citation", "video").collect()
    assert [(r.category, r.excerpt, r.shown_citation) for r in got] == [("A › B", "0:00:00 – 0:01:05", "c"), ("l", "", "")]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 0.0), (4, 50.0, 50.0)], "id long, x double, y double")
    out = {r.id: r for r in layout.relaxed(points, 4.0, rounds=4, cut=2).collect()}
    assert (out[4].x, out[4].y) == (50.0, 50.0) and (out[1].x, out[1].y) != (out[3].x, out[3].y) and abs(out[1].x - out[2].x) > 1
