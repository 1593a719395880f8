"""The structural differences of two dumps, without regard to the order of lists.

Entries meet by their id, and from there on a level at a time: what stands at a place on both sides is a row of two JSON texts. Equal rows go;
objects are exploded and their keys joined; of lists, what both hold as often is taken out as a multiset, and the elements that are left are paired
by the facts (key and value) that they share, found by a join, not by comparing all with all. A level's rows are written before
the next one, so there are as many rounds as the dumps are deep, whatever their size.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from sparkloom.scratch import written

#: The keys that name an element of a list, in order of preference.
NAMES = ("id", "pk", "uuid", "url", "slug", "name", "key")
_OBJECT, _FACTS = "map<string,variant>", ["list", "fact"]


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """JSON texts in the form that people read: sorted keys, blanks behind commas and colons."""
    return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False), na_action="ignore")


def _is(kind: str, *values: Column) -> Column:
    return functools.reduce(Column.__and__, [v.startswith(kind) for v in values])


def _fields(text: Column) -> Column:
    """The fields of an object as (key, value as JSON); a list for other values, empty."""
    fields = F.map_entries(F.from_json(F.when(_is("{", text), text).otherwise("{}"), _OBJECT))
    return F.transform(fields, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))


def _field(text: Column, key: str) -> Column:
    found = F.filter(_fields(text), lambda e: (e["key"] == key) & (e["value"] != "null"))
    return F.get(found, 0)["value"]


def _name(*values: Column) -> Column:
    """``key=value`` by the first key that names an object, the same on all sides; else empty."""
    options = []
    for key in NAMES:
        held = [_field(v, key) for v in values]
        same = functools.reduce(Column.__and__, [h == held[0] for h in held])
        options.append(F.when(same, F.concat(F.lit(f"{key}="), canonical(held[0]))))
    return F.coalesce(*options, F.lit(""))


def _by_key(rows: DataFrame) -> DataFrame:
    """The next level of objects: a row for each key of either side."""
    chosen = rows.filter(_is("{", F.col("a"), F.col("b")))
    a, b = (chosen.select("row", "place", F.explode(_fields(F.col(n))).alias("x")).select("row", "place", "x.key", F.col("x.value").alias(n)) for n in "ab")
    both = a.join(b, ["row", "place", "key"], "full")
    return both.select(F.concat("place", F.lit("/"), "key").alias("place"), "a", "b", F.lit(False).alias("told"))


def _elements(rows: DataFrame) -> list[DataFrame]:
    """For each side (list, place, nth, value) of the elements that the other side's list holds less often, the last ones."""
    chosen = rows.filter(_is("[", F.col("a"), F.col("b")))
    made = []
    for side in "ab":
        each = chosen.select("row", "place", F.posexplode(F.from_json(side, "array<variant>")).alias("nth", "x"))
        each = each.select(F.col("row").alias("list"), "place", "nth", F.coalesce(F.to_json("x"), F.lit("null")).alias("value"))
        made.append(each.withColumn("copy", F.row_number().over(Window.partitionBy("list", "value").orderBy("nth"))))
    a, b = made
    return [x.join(y.select("list", "value", "copy"), ["list", "value", "copy"], "left_anti").drop("copy") for x, y in ((a, b), (b, a))]


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(list, i, j): elements that belong together. Objects share facts, a point each, and half a point for the same keys; lists
    have one point. The pair with most points comes first, of equals the later one, and each element has one partner."""

    def facts(side: DataFrame, n: str) -> DataFrame:
        keys = F.to_json(F.array_sort(F.transform(_fields(F.col("value")), lambda e: e["key"]))).alias(f"keys_{n}")
        return side.filter(_is("{", F.col("value"))).select("list", F.col("nth").alias(n), keys, F.explode(_fields(F.col("value"))).alias("fact"))

    met = facts(a, "i").join(facts(b, "j"), _FACTS).groupBy("list", "i", "j").agg(F.count("*").alias("n"), F.first(F.col("keys_i") == F.col("keys_j")).alias("alike"))
    met = met.select("list", "i", "j", (F.col("n") + F.when(F.col("alike"), 0.5).otherwise(0.0)).alias("points"))
    lists = [side.filter(_is("[", F.col("value"))).select("list", F.col("nth").alias(n)) for side, n in ((a, "i"), (b, "j"))]
    met = met.unionByName(lists[0].join(lists[1], "list").withColumn("points", F.lit(1.0)))
    # the pairs of one list, all of whose elements stand in one row of either dump
    ranked = met.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("points", "i", "j")), asc=False).alias("ranked"))
    none = "cast(array() AS array<struct<i:int,j:int>>)"
    taken = f"aggregate(ranked, {none}, (held, p) -> if(exists(held, h -> h.i = p.i OR h.j = p.j), held, concat(held, array(struct(p.i AS i, p.j AS j)))))"
    return ranked.select("list", F.inline(F.expr(taken)))


def _by_likeness(rows: DataFrame) -> DataFrame:
    """The next level of lists: a row for each pair of elements and for each element without partner."""
    a, b = _elements(rows)
    pairs = written(_pairs(a, b), "pairs")
    left = a.join(pairs, (a["list"] == pairs["list"]) & (a["nth"] == pairs["i"]), "left").select(a["list"].alias("list"), a["place"].alias("place"), a["value"].alias("a"), pairs["j"].alias("j"))
    right = b.select(F.col("list").alias("other"), F.col("place").alias("b_place"), F.col("nth").alias("b_nth"), F.col("value").alias("b"))
    both = left.join(right, (F.col("list") == F.col("other")) & (F.col("j") == F.col("b_nth")), "full")
    name = F.when(F.col("a").isNull(), _name(F.col("b"))).when(F.col("b").isNull(), _name(F.col("a"))).otherwise(_name(F.col("a"), F.col("b")))
    named = both.select(F.coalesce("place", "b_place").alias("place"), "a", "b", name.alias("name"))
    return named.select(F.concat("place", F.lit("["), "name", F.lit("]")).alias("place"), "a", "b", (F.col("name") != "").alias("told"))


def _lines(rows: DataFrame) -> DataFrame:
    """What is there on one side only, told by its label if its name says which it is, or else by its value; and other values than
    before."""
    only = F.coalesce("a", "b")
    shown = F.when(F.col("told"), _field(only, "label")).otherwise(only)
    side = F.concat(F.when(F.col("b").isNull(), "- ").otherwise("+ "), "place", F.coalesce(F.concat(F.lit(" : "), canonical(shown)), F.lit("")))
    changed = F.concat(F.lit("~ "), "place", F.lit(" : "), canonical(F.col("a")), F.lit(" -> "), canonical(F.col("b")))
    alone = F.col("a").isNull() | F.col("b").isNull()
    further = _is("{", F.col("a"), F.col("b")) | _is("[", F.col("a"), F.col("b"))
    return rows.filter(alone).select(side.alias("line")).unionAll(rows.filter(~alone & ~further).select(changed.alias("line")))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """line, for each difference of two dumps (entry_id, unique; entry VARIANT): it begins with - (only before), + (only after) or
    ~ (changed)."""
    a, b = (d.select("entry_id", F.coalesce(F.to_json("entry"), F.lit("null")).alias(n)) for d, n in ((before, "a"), (after, "b")))
    rows = a.join(b, "entry_id", "full").select(F.concat(F.lit("/"), "entry_id").alias("place"), "a", "b", F.lit(True).alias("told"))
    lines = []
    while True:
        apart = rows.filter(~F.col("a").eqNullSafe(F.col("b"))).withColumn("row", F.monotonically_increasing_id())
        level = written(apart, "level")
        lines.append(_lines(level))
        if level.filter(_is("{", F.col("a"), F.col("b")) | _is("[", F.col("a"), F.col("b"))).isEmpty():
            return functools.reduce(DataFrame.unionAll, lines)
        rows = _by_key(level).unionAll(_by_likeness(level))
