"""Names to people and organisations: an index with aliases, ambiguous keys, owners of accounts, rule look-ups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.names import drop_middle_names, normalize_name
from sparkloom.operators.upsert import first_by


def name_index(actors: DataFrame, actor: str, names: Column) -> DataFrame:
    """name, actor, ambiguous: every normalized name or alias; a name of several actors is ambiguous and resolves to none."""
    each = actors.select(F.col(actor).alias("actor"), F.explode(F.transform(names, normalize_name)).alias("name")).filter("name <> ''").distinct()
    return each.groupBy("name").agg(F.min("actor").alias("actor"), (F.count("*") > 1).alias("ambiguous"))


def resolve(labels: DataFrame, label: str, index: DataFrame) -> DataFrame:
    """``labels`` with actor and reason (null if resolved): by the whole name, else by its first and last word."""
    full, short = normalize_name(F.col(label)), normalize_name(drop_middle_names(F.col(label)))
    first = index.select(F.col("name").alias("__n1"), F.col("actor").alias("__a1"), F.col("ambiguous").alias("__m1"))
    second = index.select(F.col("name").alias("__n2"), F.col("actor").alias("__a2"), F.col("ambiguous").alias("__m2"))
    found = labels.join(first, full == F.col("__n1"), "left").join(second, short == F.col("__n2"), "left")
    actor = F.when(~F.col("__m1"), F.col("__a1")).when(F.col("__m1").isNull() & ~F.col("__m2"), F.col("__a2"))
    reason = F.when(full == "", "blank").when(F.col("__m1"), "ambiguous").when(F.col("__m1").isNull() & F.col("__m2"), "ambiguous").when(actor.isNull(), "unknown")
    return found.withColumn("actor", actor).withColumn("reason", reason).drop("__n1", "__a1", "__m1", "__n2", "__a2", "__m2")


def owners(labels: DataFrame, account: str, label: str, index: DataFrame) -> DataFrame:
    """account, actor, reason: the owner that all labels of an account agree on; several labels are a conflict."""
    each = labels.select(account, F.col(label).alias("label"), normalize_name(F.col(label)).alias("n")).filter("n <> ''")
    one = each.groupBy(account).agg(F.countDistinct("n").alias("names"), F.min("label").alias("label"))
    resolved = resolve(one, "label", index)
    conflict = F.col("names") > 1
    return resolved.select(account, F.when(~conflict, F.col("actor")).alias("actor"), F.when(conflict, "conflict").otherwise(F.col("reason")).alias("reason"))


def longest_prefix(rows: DataFrame, key: list[str], label: str, exact: DataFrame, prefix: DataFrame) -> DataFrame:
    """key, value: of the exact rule (rule, value), else of the longest prefix rule followed by a blank or the end. A label's word
    prefixes are exploded, so that rules are found by equality however many there are."""
    words = F.split(F.col(label), " ")
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    each = rows.select(*key, label, F.explode(begins).alias("rule"))
    best = each.join(prefix, "rule").groupBy(*key, label).agg(F.max_by("value", F.length("rule")).alias("by_prefix"))
    whole = exact.select(F.col("rule").alias("__rule"), F.col("value").alias("by_label"))
    found = rows.select(*key, label).distinct().join(best, [*key, label], "left").join(whole, F.col(label) == F.col("__rule"), "left")
    return found.select(*key, label, F.coalesce("by_label", "by_prefix").alias("value"))


def replaced_labels(rows: DataFrame, label: str, exact: DataFrame, prefix: DataFrame) -> DataFrame:
    """Whole labels by exact rules, else the first word by prefix rules if another one follows."""
    head = F.when(F.col(label).contains(" "), F.substring_index(F.col(label), " ", 1))
    tail = F.expr(f"substr({label}, instr({label}, ' ') + 1)")
    found = rows.join(exact.select(F.col("rule").alias("__e"), F.col("value").alias("__ev")), F.col(label) == F.col("__e"), "left")
    found = found.join(prefix.select(F.col("rule").alias("__p"), F.col("value").alias("__pv")), head == F.col("__p"), "left")
    value = F.coalesce(F.col("__ev"), F.concat("__pv", F.lit(" "), tail), F.col(label))
    return found.withColumn("replaced", value).drop("__e", "__ev", "__p", "__pv")


def suffix_matches(labels: DataFrame, people: DataFrame) -> DataFrame:
    """label, person: labels that end with a person's last name, one's first names containing the other's. Met by equality on the last
    word; ``people`` has person, first_name, last_name."""
    words = lambda c: F.filter(F.split(normalize_name(c), " "), lambda w: w != "")
    left = labels.select("label", words(F.col("label")).alias("l")).withColumn("end", F.try_element_at("l", F.lit(-1)))
    right = people.select("person", words(F.col("first_name")).alias("f"), words(F.col("last_name")).alias("s")).withColumn("end", F.try_element_at("s", F.lit(-1)))
    both = left.join(right, "end").filter(F.size("l") > F.size("s")).filter(F.slice("l", F.size("l") - F.size("s") + 1, F.size("s")) == F.col("s"))
    own = F.slice("l", 1, F.size("l") - F.size("s"))
    return both.filter((F.size(F.array_except(own, "f")) == 0) | (F.size(F.array_except("f", own)) == 0)).select("label", "person")


def _whole(name: Column) -> Column:
    """The pattern of a name as whole words, the name itself quoted."""
    quoted = F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"(?iuU)(?<![\w-])\Q"), quoted, F.lit(r"\E(?![\w-])"))


def whole_word_matches(names: DataFrame, texts: DataFrame) -> DataFrame:
    """name, id, matches: names that occur as whole words (hyphens count as letters) in a text; ``matches`` other than 1 is an error.

    Texts and names meet by equality on the first word of a name, which a text with the name has to hold; the pattern, with the name
    quoted, then decides. A name without any word character matches nothing."""
    words = lambda c: F.regexp_extract_all(F.lower(F.upper(c)), F.lit(r"(?U)[\w-]+"), F.lit(0))
    pattern = _whole(F.col("name"))
    keyed = names.select("name", F.get(words(F.col("name")), 0).alias("key")).distinct()
    held = texts.select("id", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("key"))
    hits = held.join(keyed, "key").filter(F.regexp_like("text", pattern)).select("name", "id").distinct()
    counts = hits.groupBy("name").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    return names.join(counts, "name", "left").select("name", "id", F.coalesce("matches", F.lit(0)).alias("matches"))


#: Up to so many bytes, names are looked for by an automaton that each worker keeps (some 20 times as large); more meet texts by words.
NAMES_BYTES = 1 << 20
#: So many words of a name, from its first on, are met with those of a text.
RUN = 6


class _Fold(dict):
    """Characters as the pattern compares them: the lower form of the upper form, each of one character."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        upper = upper if len(upper) == 1 else chr(code)
        self[code] = ord(upper.lower()[0])
        return self[code]


_fold = _Fold()
_automata: dict[str, object] = {}


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_fold)


def _automaton(key: str, names: list[str]):
    """The automaton that a worker used last."""
    if key not in _automata:
        import ahocorasick

        held: dict[str, list[str]] = {}
        for name in names:
            held.setdefault(folded(name), []).append(name)
        made = ahocorasick.Automaton()
        for form, same in held.items():
            made.add_word(form, same)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made if held else None
    return _automata[key]


def _named(texts: DataFrame, names: list[str]) -> DataFrame:
    """id, text, names: those that a text may hold, by one pass over it."""
    shared, key = texts.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, shared.value)
        for batch in batches:
            rows = [sorted({n for _, same in found.iter(folded(t)) for n in same}) if t and found else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.string()))], names=["id", "text", "names"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, text string, names array<string>")


def _by_words(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """id, name: names in texts, however many of both. A text with a name holds the name's words in a row, so they meet by equality
    of a hash of the first ``RUN`` of these; the pattern then decides. Keys alone are dealt by hash, texts once, by id."""
    plain = F.pandas_udf(lambda c: c.map(folded, na_action="ignore"), "string")
    words = lambda c: F.regexp_extract_all(plain(c), F.lit(r"(?U)[\w-]+"), F.lit(0))
    held = wanted.select("name", F.slice(words(F.col("name")), 1, RUN).alias("w")).select("name", F.size("w").alias("n"), F.xxhash64(F.array_join("w", " ")).alias("key"))
    # at most RUN of them
    sizes = sorted(r.n for r in held.select("n").distinct().collect())
    kept = texts.select("id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    split = kept.select("id", words(F.col("text")).alias("w"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    runs = [F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<bigint>")) for n in sizes]
    keys = split.select("id", F.explode(F.array_distinct(F.flatten(F.array(*runs)) if runs else F.array().cast("array<bigint>"))).alias("key"))
    maybe = keys.join(held.select("key", "name"), "key").select("id", "name")
    return maybe.join(kept.withColumnRenamed("id", "at"), F.col("id").eqNullSafe(F.col("at"))).filter(F.regexp_like("text", _whole(F.col("name")))).select("id", "name")


def many_whole_word_matches(names: DataFrame, texts: DataFrame, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """``whole_word_matches`` for many names, however many begin alike. Up to ``names_bytes`` of them, an automaton, which each worker
    keeps, reads a text once, and the pattern is asked only about the names that it finds; more names are dealt like the texts."""
    wanted = names.select("name").filter(F.col("name").rlike(r"(?U)[\w-]")).distinct()
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    if total <= names_bytes:
        found = _named(texts, [r.name for r in wanted.collect()])
        hits = found.select("id", F.explode(F.filter("names", lambda n: F.regexp_like("text", _whole(n)))).alias("name"))
    else:
        hits = _by_words(wanted, texts)
    counts = hits.distinct().groupBy("name").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    return names.join(counts, "name", "left").select("name", "id", F.coalesce("matches", F.lit(0)).alias("matches"))


def first_registered(rows: DataFrame, key: Column, label: str) -> DataFrame:
    """key, label: the least label of each normalized form."""
    return rows.select(key.alias("key"), F.col(label).alias("label")).groupBy("key").agg(F.min("label").alias("label"))


def positions(people: DataFrame, person: str, label: str, known_levels: list[str] | None = None) -> DataFrame:
    """person, role, level: the tags of a person's position label; roles are created, levels only looked up; both missing: no tag."""
    from sparkloom.functions.names import level, role, segments

    each = people.select(person, F.explode(segments(F.col(label))).alias("s")).select(person, F.nullif(role(F.col("s")), F.lit("")).alias("role"), F.nullif(level(F.col("s")), F.lit("")).alias("level"))
    if known_levels is not None:
        each = each.withColumn("level", F.when(F.col("level").isin(known_levels), F.col("level")))
    return each.filter("role IS NOT NULL OR level IS NOT NULL").distinct()


__all__ = ["first_by", "first_registered", "longest_prefix", "many_whole_word_matches", "name_index", "owners", "positions", "replaced_labels", "resolve", "suffix_matches", "whole_word_matches"]
