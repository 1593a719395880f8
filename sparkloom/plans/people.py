"""Names, rules and the resolution of labels to actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import names
from sparkloom.operators import checks, people
from sparkloom.plans.tables import table
from sparkloom.registry import query


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\(.*?\\)', ' ', 'g'), '\\bafd\\b', ' ', 'g'), '[^0-9a-zäöüß]+', ' ', 'g'))"


@query("normalize_name", f"SELECT c_custkey, {_norm('x')} AS name FROM (SELECT c_custkey, c_name || ' (NRW) AfD-Groß/' || c_mktsegment AS x FROM customer)")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat("c_name", F.lit(" (NRW) AfD-Groß/"), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", names.normalize_name(made).alias("name"))


@query("swap_comma", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS label FROM customer")
def swap_comma(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" , "), "c_mktsegment", F.lit("  "))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", names.swap_comma_name(made).alias("label"))


@query("drop_middle", "SELECT n_nationkey, n_name || ' End' AS label FROM nation WHERE n_name NOT LIKE '% %'")
def drop_middle(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat("n_name", F.lit("  Anna Paul End"))
    return table(spark, d, "nation").filter("n_name NOT LIKE '% %'").select("n_nationkey", names.drop_middle_names(made).alias("label"))


@query("clean_function", "SELECT c_custkey, 'Mitglied des Vorstands ' || c_mktsegment AS label FROM customer")
def clean_function(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("  Miglied   des Vorstans "), "c_mktsegment", F.lit(". .. "))
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(names.clean_function(made), r"[. ]+$", "").alias("label"))


#: Position texts that the classifiers are run on, dealt to customers in turn.
_TEXTS = ["MdB und stellvertretende Bundessprecherin", "Vorsitzender Kreisverband Nord, Beisitzer im Landesvorstand", "stv. Sprecher", "Landtagskandidat im Landkreis", "einfaches Mitglied", "MdEP", "Bürgermeister", "ohne Amt"]
_SQL_TEXTS = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + "]"


@query("segment_positions", f"""
WITH s AS (SELECT c_custkey, list_filter(list_transform(regexp_split_to_array({_SQL_TEXTS}[1 + c_custkey % 8], '\\s*(,|\\bund\\b)\\s*'), lambda x: trim(x)), lambda x: x <> '') AS p FROM customer)
SELECT c_custkey, CAST(len(p) AS INTEGER) AS n, array_to_string(p, '|') AS parts FROM s""")
def segment_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("s", names.segments(_dealt()))
    return c.select("c_custkey", F.size("s").alias("n"), F.array_join("s", "|").alias("parts"))


def _dealt():
    return F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("c_custkey") % 8 + 1).cast("int"))


def _case(rules: list[tuple[str, str]], x: str) -> str:
    # the texts hold no word beside these patterns' ASCII borders, so ASCII rules agree
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{n}'" for p, n in rules) + " ELSE '' END"


@query("classify_role_level", f"SELECT c_custkey, {_case(names.ROLES, 'x')} AS role, {_case(names.LEVELS, 'x')} AS level FROM (SELECT c_custkey, {_SQL_TEXTS}[1 + c_custkey % 8] AS x FROM customer)")
def classify_role_level(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("x", _dealt())
    return c.select("c_custkey", names.role(F.col("x")).alias("role"), names.level(F.col("x")).alias("level"))


@query("position_tags", f"""
WITH s AS (SELECT c_custkey, unnest(list_filter(list_transform(regexp_split_to_array({_SQL_TEXTS}[1 + c_custkey % 8], '\\s*(,|\\bund\\b)\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS x FROM customer),
t AS (SELECT DISTINCT c_custkey, nullif({_case(names.ROLES, 'x')}, '') AS role, nullif({_case(names.LEVELS, 'x')}, '') AS level FROM s)
SELECT c_custkey, role, level FROM t WHERE role IS NOT NULL OR level IS NOT NULL""")
def position_tags(spark: SparkSession, d: str) -> DataFrame:
    return people.positions(table(spark, d, "customer").withColumn("x", _dealt()), "c_custkey", "x")


@query("ambiguous_keys", "SELECT c_mktsegment || ' ' || c_nationkey AS name, count(*) AS entities FROM customer GROUP BY 1 HAVING count(*) > 1")
def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("name"), "c_custkey")
    return checks.collisions(rows, "name", "c_custkey")


_INDEX = """
WITH a AS (SELECT s_suppkey AS actor, lower(s_name) AS name FROM supplier UNION SELECT s_suppkey, 'group ' || s_nationkey FROM supplier),
i AS (SELECT trim(regexp_replace(name, '[^0-9a-zäöüß]+', ' ', 'g')) AS name, min(actor) AS actor, count(DISTINCT actor) > 1 AS ambiguous FROM a GROUP BY 1) """


def _index(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return people.name_index(s, "s_suppkey", F.array("s_name", F.concat(F.lit("Group-"), F.col("s_nationkey").cast("string"))))


@query("name_index", _INDEX + "SELECT name, actor, ambiguous FROM i")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query("resolve_labels", _INDEX + """,
l AS (SELECT n_nationkey AS id, 'group ' || n_nationkey AS label FROM nation UNION ALL SELECT 100 + s_suppkey, lower(s_name) FROM supplier UNION ALL SELECT -1, 'nobody')
SELECT id, CASE WHEN NOT ambiguous THEN actor END AS actor, CASE WHEN ambiguous THEN 'ambiguous' WHEN i.name IS NULL THEN 'unknown' END AS reason
FROM l LEFT JOIN i ON i.name = trim(regexp_replace(l.label, '[^0-9a-zäöüß]+', ' ', 'g'))""")
def resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("GROUP "), F.col("n_nationkey").cast("string")).alias("label"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.upper("s_name").alias("label"))
    c = spark.createDataFrame([(-1, "nobody")], "id long, label string")
    return people.resolve(a.union(b).union(c), "label", _index(spark, d)).select("id", "actor", "reason")


@query("account_owners", """
SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' ELSE 'unknown' END AS reason FROM events GROUP BY user_id""")
def account_owners(spark: SparkSession, d: str) -> DataFrame:
    return people.owners(table(spark, d, "events"), "user_id", "event_type", _index(spark, d)).select("user_id", "reason")


@query("longest_prefix_rule", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN 'exact' WHEN p_type || ' ' || p_brand = p_type || ' Brand#11' THEN 'two words' ELSE 'one word' END AS value FROM part""")
def longest_prefix_rule(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("label", F.concat_ws(" ", "p_type", "p_brand", F.lit("x")))
    types = part.select("p_type").distinct()
    prefix = types.select(F.col("p_type").alias("rule"), F.lit("one word").alias("value")).union(types.select(F.concat("p_type", F.lit(" Brand#11")), F.lit("two words")))
    exact = types.select(F.concat("p_type", F.lit(" Brand#12 x")).alias("rule"), F.lit("exact").alias("value"))
    return people.longest_prefix(part, ["p_partkey"], "label", exact, prefix).select("p_partkey", "value")


@query("replace_labels", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Kreisverband ' || n_name WHEN n_nationkey % 3 = 1 THEN 'Fixed' ELSE 'KV' END AS label FROM nation")
def replace_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    rows = table(spark, d, "nation").withColumn("label", F.when(n == 0, F.concat(F.lit("KV "), "n_name")).when(n == 1, F.concat(F.lit("Wrong "), "n_name")).otherwise("KV"))
    exact = rows.filter(n == 1).select(F.col("label").alias("rule"), F.lit("Fixed").alias("value"))
    prefix = spark.createDataFrame([("KV", "Kreisverband")], "rule string, value string")
    return people.replaced_labels(rows, "label", exact, prefix).select("n_nationkey", F.col("replaced").alias("label"))


@query("suffix_matches", "SELECT 'Dr. Anna ' || n_name AS label, CAST(n_nationkey AS BIGINT) AS person FROM nation WHERE n_name NOT LIKE '% %'")
def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_name NOT LIKE '% %'")
    labels = n.select(F.concat(F.lit("Dr. Anna "), "n_name").alias("label"))
    return people.suffix_matches(labels, n.select(F.col("n_nationkey").cast("long").alias("person"), F.lit("Anna").alias("first_name"), F.col("n_name").alias("last_name")))


@query("whole_word_match", """
SELECT r_name AS name, count(n_name) AS matches FROM region LEFT JOIN (SELECT n_nationkey, n_name, 'Fraction ' || (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) || ' ' || n_name AS text FROM nation) t
ON ' ' || text || ' ' LIKE '% ' || r_name || ' %' GROUP BY 1""")
def whole_word_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    texts = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("fraction "), F.lower("r_name"), F.lit(" "), "n_name").alias("text"))
    return people.whole_word_matches(r.select(F.col("r_name").alias("name")), texts).select("name", "matches")


@query("whole_word_match_many", "SELECT c_name AS name, count(o_orderkey) AS matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def whole_word_match_many(spark: SparkSession, d: str) -> DataFrame:
    """All customers' names, which begin with the same word, in a text for each order."""
    customers = table(spark, d, "customer")
    texts = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("for customer "), F.upper("c_name"), F.lit(", "), "o_orderpriority").alias("text"))
    return people.many_whole_word_matches(customers.select(F.col("c_name").alias("name")), texts).select("name", "matches")


@query("first_registered", "SELECT lower(c_mktsegment) AS key, min(c_name) AS label FROM customer GROUP BY 1")
def first_registered(spark: SparkSession, d: str) -> DataFrame:
    return people.first_registered(table(spark, d, "customer"), names.normalize_name(F.col("c_mktsegment")), "c_name")


@query("check_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_orphans", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id)")
def check_orphans(spark: SparkSession, d: str) -> DataFrame:
    return checks.orphans(table(spark, d, "labels"), "doc_id", table(spark, d, "benchmark"), "item_id").select("doc_id")


@query("check_exactly_one", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 2 = 1) = (o_orderkey % 3 < 2)")
def check_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 1, k).alias("a"), F.when(F.floor(k % 3 / 2) == 0, k).alias("b"))
    return checks.not_exactly_one(rows, ["a", "b"]).select("o_orderkey")
