"""Plans that align stored names with a dump's labels: what to rename, create, review or leave; and position overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.names import normalize_name
from sparkloom.operators.checks import collisions, require
from sparkloom.operators.people import longest_prefix, positions, suffix_matches


def organisation_plan(organisations: DataFrame, labels: DataFrame, overrides: DataFrame, exact: DataFrame, prefix: DataFrame) -> DataFrame:
    """category, name, target, level: rename (stored name to its canonical one), create (labels nobody has, with a level), review
    (labels whose type is undecided or unknown). ``organisations`` has name; ``labels`` label; ``overrides`` rule, value."""
    renames = organisations.join(overrides, organisations["name"] == overrides["rule"]).filter(F.col("name") != F.col("value")).select(F.lit("rename").alias("category"), "name", F.col("value").alias("target"), F.lit(None).cast("string").alias("level"))
    known = organisations.select(normalize_name(F.col("name")).alias("n")).union(renames.select(normalize_name(F.col("target")))).distinct()
    missing = labels.select("label").distinct().withColumn("n", normalize_name(F.col("label"))).join(known, "n", "left_anti")
    levelled = longest_prefix(missing.select("label"), [], "label", exact, prefix)
    undecided = F.col("value").isNull() | (F.col("value") == "REVIEW")
    created = levelled.select(F.when(undecided, "review").otherwise("create").alias("category"), F.col("label").alias("name"), F.lit(None).cast("string").alias("target"), F.when(~undecided, F.col("value")).alias("level"))
    return renames.unionByName(created)


def renamed(organisations: DataFrame, plan: DataFrame) -> DataFrame:
    """``organisations`` (name, aliases) under their canonical names, the old ones kept as aliases, and those to create."""
    r = plan.filter("category = 'rename'").select(F.col("name").alias("__old"), F.col("target").alias("__new"))
    joined = organisations.join(r, organisations["name"] == F.col("__old"), "left")
    kept = joined.withColumn("aliases", F.when(F.col("__new").isNotNull(), F.array_union("aliases", F.array("name"))).otherwise(F.col("aliases"))).withColumn("name", F.coalesce("__new", "name")).drop("__old", "__new")
    new = plan.filter("category = 'create'").select("name", F.array().cast("array<string>").alias("aliases"))
    return kept.unionByName(new, allowMissingColumns=True)


def person_plan(people: DataFrame, labels: DataFrame) -> DataFrame:
    """category, label, person: rename (one person fits the label), collision (a label or a person fits several), create (nobody fits and the
    label has two words), review (nobody fits otherwise)."""
    pairs = suffix_matches(labels.select("label").distinct(), people)
    by_label, by_person = pairs.groupBy("label").agg(F.count("*").alias("n"), F.min("person").alias("person")), collisions(pairs, "person", "label").select(F.col("person").alias("__p"))
    joined = labels.select("label").distinct().join(by_label, "label", "left").join(by_person, F.col("person") == F.col("__p"), "left")
    two = F.size(F.filter(F.split("label", r"(?U)\s+"), lambda w: w != "")) == 2
    category = F.when((F.col("n") > 1) | F.col("__p").isNotNull(), "collision").when(F.col("n") == 1, "rename").when(two, "create").otherwise("review")
    return joined.select(category.alias("category"), "label", F.when(F.col("n") == 1, F.col("person")).alias("person"))


def split_names(plan: DataFrame, people: DataFrame) -> DataFrame:
    """person, first_name, last_name by the labels to rename: the last name keeps its number of words."""
    require(plan.filter("category = 'collision'"), "a label fits several people")
    words = F.filter(F.split("label", r"(?U)\s+"), lambda w: w != "")
    size = F.size(F.filter(F.split("last_name", r"(?U)\s+"), lambda w: w != ""))
    joined = plan.filter("category = 'rename'").join(people.select("person", "last_name"), "person")
    return joined.select("person", F.concat_ws(" ", F.slice(words, F.lit(1), F.size(words) - size)).alias("first_name"), F.concat_ws(" ", F.slice(words, F.size(words) - size + 1, size)).alias("last_name"))


def position_overrides(people: DataFrame, overrides: DataFrame, tags: DataFrame, levels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(people with replaced position labels, tags with those of the new labels added). ``people`` has person, name, label; ``overrides`` name, position; names
    that nobody or several people have abort."""
    o = overrides.select(normalize_name(F.col("name")).alias("__n"), F.col("position").alias("__position"))
    p = people.withColumn("__key", normalize_name(F.col("name")))
    counts = o.join(p.groupBy("__key").agg(F.count("*").alias("n")), F.col("__n") == F.col("__key"), "left")
    require(counts.filter("coalesce(n, 0) <> 1").select("__n"), "not exactly one person of this name")
    replaced = p.join(o, F.col("__key") == F.col("__n"), "left").withColumn("label", F.coalesce("__position", "label"))
    new = positions(replaced.filter("__position IS NOT NULL"), "person", "label", levels).select("person", "role", "level")
    both = tags.select("person", "role", "level").union(new).distinct()
    return replaced.drop("__key", "__n", "__position"), both


def summary(plan: DataFrame) -> DataFrame:
    """category, n."""
    return plan.groupBy("category").agg(F.count("*").alias("n"))
