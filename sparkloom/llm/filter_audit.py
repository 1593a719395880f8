"""Filter interaction audit by inclusion and exclusion: what each filter removes, in every order of the filters, from one count
of joint failures.

For each set of filters, the documents that fail all of them are counted as a sum of products of flags, by part and with
weights for all, good and toxic documents. From these 32 counts follows everything else by sums with alternating signs: the documents
that survive a set of filters, and so what each step of each order keeps and removes; those that one filter alone removes; and
the Shapley value of each filter, whose game (documents removed by a set of filters) has the signed joint failures as its
Harsanyi dividends.

A document's text is read once, in the task that scans it; what goes on are a digest, five columns of its row and a count.
Whether a text is a copy is told by equality: the rows that are not copies are those that meet the smallest doc_id of their digest
by (digest, doc_id), a key that no group of copies makes hot; the smallest doc_id is combined before the shuffle.

Defined cases: a null text is empty, and equal to empty ones; a null part is empty; an empty text fails A alone of A to D; rows
without a doc_id are not copies and make no others copies; of rows with equal doc_id and text none is a copy of another, each counts; a
document is good or toxic if any of its rows in ``labels`` says so, and neither without one; texts of any length are judged whole; an
empty table gives no parts and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stage

#: The words that filters A and B count, and the characters that D forbids.
WORDS = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
FILTERS = "ABCDE"
_WEIGHTS = ("all", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text (not null) fails."""
    words = F.array_remove(F.split(text, WORDS), "")
    n, upper = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(LEAST_DISTINCT).cast("long") * n,
        "C": F.lit(100).cast("long") * upper > F.lit(MOST_UPPER).cast("long") * F.length(text),
        "D": text.rlike(MARKS),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, A to E, good, toxic, n: how many rows of ``docs`` (doc_id, text, ``part``) fail just those filters."""
    text = F.coalesce("text", F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = told.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), *(f.alias(k) for k, f in text_flags(F.col("text")).items()))
    # equal rows are one from here on, however many there are
    rows = stage(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "flagged")
    known, unknown = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    least = known.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.join(least, ["same", "doc_id"], "left").join(judged, "doc_id", "left")
    yes = {"E": F.col("first").isNull(), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    own = ["part", *FILTERS[:4]]
    known = known.select(*own, *(c.alias(k) for k, c in yes.items()), "n")
    return known.unionAll(unknown.select(*own, *(F.lit(False).alias(k) for k in yes), "n"))


def joint_failures(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part and, for each weight, an array whose element at mask m counts the documents of the part that fail all filters of m
    (bit i: the i-th filter), from rows of (part, one flag for each filter, good, toxic, n)."""
    size = len(filters)

    def product(weight: str, mask: int) -> str:
        flags = [weight] * (weight != "all") + [f for i, f in enumerate(filters) if mask >> i & 1]
        return " * ".join(["n", *(f"cast({f} AS long)" for f in flags)])

    masks = range(1 << size)
    counts = rows.groupBy("part").agg(*(F.expr(f"sum({product(w, m)}) AS {w}{m}") for w in _WEIGHTS for m in masks))
    return counts.selectExpr("part", *(f"array({', '.join(f'{w}{m}' for m in masks)}) AS {w}" for w in _WEIGHTS))


def _signed(terms: Iterable[tuple[int, str]]) -> str:
    return " + ".join(f"{factor}L * {term}" for factor, term in terms)


def survivors(joint: str, mask: int, size: int) -> str:
    """Documents that fail no filter of ``mask``: joint failures of its subsets, with alternating signs. SQL over the array
    named ``joint``, as the next two."""
    return _signed(((-1) ** m.bit_count(), f"{joint}[{m}]") for m in range(1 << size) if m & mask == m)


def only(joint: str, i: int, size: int) -> str:
    """Documents that fail the i-th filter and no other: the inversion at that one set."""
    return _signed(((-1) ** (m.bit_count() - 1), f"{joint}[{m}]") for m in range(1 << size) if m >> i & 1)


def shapley(joint: str, i: int, size: int) -> str:
    """The i-th filter's removals, summed over all orders: each dividend of a set that holds it, shared equally, times the
    number of orders. A whole number, as ``size``! divides by every set's size."""
    return _signed(((-1) ** (m.bit_count() - 1) * factorial(size) // m.bit_count(), f"{joint}[{m}]") for m in range(1 << size) if m >> i & 1)


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part,
    order of the five filters and step."""
    size = len(FILTERS)
    joint = joint_failures(flagged(docs, labels, part))
    each = range(size)
    told = joint.selectExpr(
        "part",
        *(f"{_array(survivors(w, mask, size) for mask in range(1 << size))} AS {w}" for w in _WEIGHTS),
        f"{_array(only('all', i, size) for i in each)} AS unique_fails",
        f"{_array(shapley('all', i, size) for i in each)} AS shapley",
        f"{_array(f'all[{1 << i}]' for i in each)} AS fails",
    )
    steps = []
    for order in permutations(each):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    # 600 fixed rows, which every task has from the plan
    fixed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>")
    lost = "{0}[before] - {0}[after] AS {1}".format
    return told.select("*", F.inline(fixed)).selectExpr(
        "part", "filter_order", "step", "all[after] AS kept", lost("all", "removed"), "fails[i] - (all[before] - all[after]) AS redundant",
        "unique_fails[i] AS unique_fails", lost("good", "good_lost"), lost("toxic", "toxic_lost"), "shapley[i] AS shapley",
    )


#: The same by running every order over the failure patterns, one step after the other.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
judged AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, doc_id, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B",
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS "E"
  FROM words),
patterns AS (
  SELECT part, concat(if("A", 'A', ''), if("B", 'B', ''), if("C", 'C', ''), if("D", 'D', ''), if("E", 'E', '')) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM flags LEFT JOIN judged USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
-- the step at which a pattern's documents go: 0 for those that stay
gone AS (
  SELECT *, coalesce(list_min(list_transform(list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: contains(fails, f)), lambda f: instr(filter_order, f))), 0) AS gone_at
  FROM patterns, orders),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
each AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
    sum(if(gone_at = 0 OR gone_at > step, n, 0)) AS kept, sum(if(gone_at = step, n, 0)) AS removed,
    sum(if(gone_at < step AND contains(fails, substr(filter_order, step, 1)), n, 0)) AS redundant,
    sum(if(fails = substr(filter_order, step, 1), n, 0)) AS unique_fails,
    sum(if(gone_at = step AND good, n, 0)) AS good_lost, sum(if(gone_at = step AND toxic, n, 0)) AS toxic_lost
  FROM gone, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM each
"""
