"""A search index kept up to date in segments.

Each change of the documents adds a segment: the tokens of the documents that came or changed, the words of each in a row, and the keys
that it speaks for, those that went among them. Older segments stay as they are; what they hold of a key that a later one speaks for is dead. A reader sees one
token table, for ``search.search_by_index``: all segments, less their dead rows, which are few as later segments are
small. Segments of like size are merged, so there are few of them, and every row is rewritten a number of times that grows with
the logarithm of the index. A merge drops dead documents by their rows of words and takes them apart into tokens again: documents
are shuffled, tokens never.

Segments are published by numbered lists (``sources.versions``); a segment's number is that of its list, so segments are in order, and two
writers at once both count. What is indexed is the text as it is given: redacted texts are frozen until ``redaction_changes`` tells
which a changed rule touches and these are added anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.redaction import Rule, redact_posts
from sparkloom.operators.search import tokens_of_words, words_table, write_sorted
from sparkloom.operators.triggers import Change
from sparkloom.scratch import delete
from sparkloom.sources import versions

#: So many neighbouring segments of a size class are merged; a class holds segments up to so many times as large as the one below.
FAN = 4
_KINDS = ("tokens", "keys", "words")


def segments(tables: dict[str, str]) -> dict[int, tuple[str | None, str, str]]:
    """By number, oldest first, the places of a segment's tokens, None if they are left to a merge, keys and words."""
    numbers = sorted({int(name.split("-")[1]) for name in tables if name.split("-")[0] in _KINDS})
    return {n: tuple(tables.get(f"{kind}-{n}") for kind in _KINDS) for n in numbers}


def _place(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}/v-{uuid.uuid4().hex}"


def _write(root: str, words: DataFrame, gone: DataFrame | None, key: str, later: bool = False) -> tuple[str | None, str, str]:
    spark, places = words.sparkSession, (None if later else _place(root, "tokens"), _place(root, "keys"), _place(root, "words"))
    words.write.parquet(places[2])
    # texts are taken apart once: tokens and keys are made of the words as written
    held = spark.read.schema(words.schema).parquet(places[2])
    if not later:
        write_sorted(tokens_of_words(held, key), places[0])
    keys = held.select(key, F.lit(False).alias("gone"))
    if gone is not None:
        keys = keys.unionByName(gone.select(key, F.lit(True).alias("gone")))
    keys.groupBy(key).agg(F.min("gone").alias("gone")).write.parquet(places[1])
    return places


def _listed(spark: SparkSession, root: str, change: Callable[[int, dict[str, str]], dict[str, str | None] | None]) -> bool:
    """Commits what ``change`` makes of the next number and the newest list, anew when somebody else was first."""
    for _ in range(versions.TRIES):
        number, tables = versions.versions(spark, root)
        places = change(number + 1, tables)
        if places is None:
            return False
        try:
            versions.commit(spark, places, root, number, alone=True)
            return True
        except versions.Conflict:
            continue
    raise OSError(f"no list for a segment in {root}")


def add(docs: DataFrame, key: str, text: str, root: str, gone: DataFrame | None = None, later: bool = False) -> None:
    """Adds a segment with the texts of ``docs``, whose keys are unique and not null, and without the keys of ``gone``. A key
    of both stays. With ``later``, for many changes at once, the token table is left to ``compact``; readers take the tokens from
    the words until then."""
    spark = docs.sparkSession
    places = _write(root, words_table(docs, key, text), gone, key, later)
    _listed(spark, root, lambda number, tables: {f"{kind}-{number}": place for kind, place in zip(_KINDS, places, strict=True) if place})


def _union(spark: SparkSession, held: dict[int, tuple[str | None, str, str]], which: int, key: str) -> DataFrame:
    union = None
    for number, places in held.items():
        rows = spark.read.parquet(places[which]) if places[which] else tokens_of_words(spark.read.parquet(places[2]), key)
        one = rows.withColumn("__segment", F.lit(number).cast("long"))
        union = one if union is None else union.unionByName(one)
    return union


def _live(spark: SparkSession, held: dict[int, tuple[str | None, str, str]], key: str, which: int = 0) -> DataFrame:
    """The tokens, or words, of the segments, less the dead ones."""
    rows = _union(spark, held, which, key)
    later = dict(list(held.items())[1:])
    if not later:
        return rows.drop("__segment")
    newest = _union(spark, later, 1, key).groupBy(F.col(key).alias("__key")).agg(F.max("__segment").alias("__newest"))
    # filters on tokens go down to the files of every segment, below this join
    return rows.join(newest, (F.col(key) == F.col("__key")) & (F.col("__segment") < F.col("__newest")), "left_anti").drop("__segment")


def read(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The token table (key, token, pos) of all segments; None before the first one."""
    held = segments(versions.versions(spark, root)[1])
    return _live(spark, held, key) if held else None


def _run(sizes: list[int], fan: int) -> int:
    """How many of the newest segments are to be merged: those up to the least size class that has ``fan``. A segment counts to
    the class of the largest that came after it, so classes go down from the oldest to the newest."""
    classes: list[int] = []
    for n in reversed(sizes):
        tier = 0
        while n >= fan:
            n, tier = n // fan, tier + 1
        classes.append(max([tier, *classes[-1:]]))
    full = [t for t in sorted(set(classes)) if classes.count(t) >= fan]
    return sum(t <= full[0] for t in classes) if full else 0


def _index(spark: SparkSession, root: str, key: str, held: dict[int, tuple[str | None, str, str]]) -> None:
    """Writes the token tables that were left for later."""
    for n, places in held.items():
        if places[0]:
            continue
        place = _place(root, "tokens")
        write_sorted(tokens_of_words(spark.read.parquet(places[2]), key), place)
        if not _listed(spark, root, lambda number, tables, n=n, places=places, place=place: {f"tokens-{n}": place} if segments(tables).get(n) == places else None):
            delete(spark, place)


def compact(spark: SparkSession, root: str, key: str, fan: int = FAN) -> int:
    """Merges neighbouring segments of like size until there are less than ``fan`` of each size class, and gives how many merges there
    were. Segments that lack a token table get one. Keys that went are forgotten where nothing older is left. Segments that others add meanwhile stay; those that another merge
    took first are left to it."""
    merges = 0
    while True:
        held = segments(versions.versions(spark, root)[1])
        run = _run([spark.read.parquet(keys).count() for _, keys, _ in held.values()], fan)
        if not run:
            _index(spark, root, key, held)
            return merges
        merged = dict(list(held.items())[-run:])
        gone = _union(spark, merged, 1, key).groupBy(key).agg(F.max_by("gone", "__segment").alias("gone")).filter("gone")
        places = _write(root, _live(spark, merged, key, 2), None if run == len(held) else gone, key)
        last = list(merged)[-1]

        def swap(number: int, tables: dict[str, str], merged=merged, places=places, last=last) -> dict[str, str | None] | None:
            now = segments(tables)
            if any(now.get(n) != p for n, p in merged.items()):
                return None
            return {f"{kind}-{n}": None for n in merged for kind in _KINDS} | {f"{kind}-{last}": place for kind, place in zip(_KINDS, places, strict=True)}

        if not _listed(spark, root, swap):
            for place in places:
                delete(spark, place)
            return merges
        merges += 1


def hook(key: str, text: str, root: str) -> Callable[[Change], None]:
    """For ``triggers.Triggers``: a publication's changes become a segment."""
    return lambda change: add(change.created.unionByName(change.changed), key, text, root, change.deleted)


def redaction_changes(
    posts: DataFrame, text: str, key: str, before: list[Rule], after: list[Rule], own_before: DataFrame | None = None, own_after: DataFrame | None = None
) -> DataFrame:
    """The posts whose redacted text is another under the rules ``after``, with that text: what a segment has to say anew."""
    both = redact_posts(posts.withColumn("__before", F.col(text)), "__before", before, own_before, key)
    both = redact_posts(both, text, after, own_after, key)
    return both.filter(~F.col("__before").eqNullSafe(F.col(text))).drop("__before")
