import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names, text, values


def column(spark, rows, f, kind="string"):
    """f applied to a column of rows, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_slugs(spark):
    cases = [
        ("facebook", "1076563753291891", "mth6nd3uc2"), ("instagram", "DQoaetgAFsG", "zhfqiblev2"), ("telegram", "jungealternativenrw/727", "7nlsmub2zm"), ("tiktok", "7554751221773487382", "pnneq6tiu6"),
        ("twitter", "1968621682618212654", "epxhe62cal"), ("youtube", "sBmPJi-9NoI", "tg55e4xqbb"),
    ]
    df = spark.createDataFrame(cases, "p string, i string, want string")
    assert df.filter(values.slug(F.col("p"), F.col("i")) != F.col("want")).count() == 0


def test_names(spark):
    got = column(spark, ["Moriße", "Morisse", "Landesverband  (NRW)/AfD", "Kreis-Verband", None, "Café"], names.normalize_name)
    assert got == ["morisse", "morisse", "landesverband", "kreis verband", "", "caf"]
    assert column(spark, ["Muster, Max", "Verband Bayern", " Muster ,Max, Jr"], names.swap_comma_name) == ["Max Muster", "Verband Bayern", "Max, Jr Muster"]
    assert column(spark, ["Anna Maria Muster", "Anna Muster", "Muster"], names.drop_middle_names) == ["Anna Muster", "Anna Muster", "Muster"]
    assert column(spark, ["  Miglied im  Vorstans . ", None, "Berllin.."], names.clean_function) == ["Mitglied im Vorstands", "", "Berlin"]
    assert column(spark, ["MdB und Sprecher, Bundesvorstand", "Bund und Land", None], names.segments) == [["MdB", "Sprecher", "Bundesvorstand"], ["Bund", "Land"], []]


@pytest.mark.parametrize(
    "label, role, level",
    [
        ("Stellvertretende Bundessprecherin", "Stellvertretende*r Bundessprecher*in", "AfD-Bundespartei"), ("stv. Landesvorsitzender", "Stellvertretende*r Landesvorsitzende*r", "AfD-Landesverbände"),
        ("MdB", "Abgeordnete*r", "AfD-Bundespartei"), ("Vorstandsmitglied Kreisverband", "Vorstandsmitglied", "AfD-Kreisverbände"), ("Mitglied im Landesvorstand", "Vorstandsmitglied", "AfD-Landesverbände"),
        ("MdEP", "Abgeordnete*r", "AfD-Europafraktion"), ("Kreistagsabgeordneter", "Kreisrat*rätin", "AfD-Kreisverbände"), ("etwas", "", ""), ("Bürgermeisterkandidat", "Kandidat*in", "AfD-Kreisverbände"),
    ],
)
def test_classifiers(spark, label, role, level):
    assert column(spark, [label], names.role) == [role] and column(spark, [label], names.level) == [level]


def test_numbers(spark):
    assert column(spark, ["568.0", "12", "", None, "x", "-3.9", "inf", "1e3", "1_000", "1e3d"], values.coerce_int) == [568, 12, None, None, None, -3, None, 1000, 1000, None]
    assert column(spark, ["14.8K subscribers", "1,234 views", "2m", "none", None, "1.5B"], values.parse_count_text) == [14800, 1234, 2_000_000, None, None, 1_500_000_000]
    assert [str(x) if x else None for x in column(spark, ["0", "1700000000.9", "", "x", None], values.parse_epoch)] == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", None, None, None]
    rng = random.Random(1)
    numbers = [0, 999, 1000, 1500, 2_400_000, 999_950, 135_650, -1500, 10**9, 3 * 10**12] + [rng.randrange(10**10) for _ in range(500)]

    def python(n):
        for d, s in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
            if abs(n) >= d:
                return f"{n / d:.1f}".rstrip("0").rstrip(".") + s
        return str(n)

    assert column(spark, numbers, text.compact_number, "long") == [python(n) for n in numbers]


def test_durations(spark):
    assert column(spark, ["01:02:03", "2:05", "x:1", "1", "", None, "1:99"], values.parse_duration) == [3723, 125, None, None, None, None, 159]
    assert column(spark, [5, 63, 86400, 200000, None], values.print_duration, "long") == ["0:00:05", "0:01:03", "1 day, 0:00:00", "2 days, 7:33:20", ""]


def test_topic_text(spark):
    def python(t):
        t = re.sub(r"(?:https?://|www\.)\S+", " ", t, flags=re.I)
        t = re.sub(r"(?<!\w)[@#](\w+)", lambda m: m[1].replace("_", " "), t)
        t = "\n".join(x.strip() for x in re.sub(r"[^\S\n]+", " ", t).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    rng = random.Random(3)
    parts = ["@john_doe", "#Jörg_x", " ", "\n", "a@b", "https://x.y/z_q", "WWW.site", "wörd_s", " ", "\n\n\n", "@", "#1_2", "x", "#a_"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = column(spark, cases, text.topic_text)
    assert [c for c, g in zip(cases, got) if g != python(c)] == []


def test_display(spark):
    assert column(spark, ["a\\nb<", None], text.plain_text) == ["a<br>b&lt;", ""]
    assert column(spark, ["a, b,c & d", None], text.break_after_commas) == ["a,<br>b,c &amp; d", ""]
    assert column(spark, [[" A ", "A", "", "B", "A"], []], values.clean_path, "array<string>") == [["A", "B", "A"], []]
