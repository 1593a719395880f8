import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import tree


def some_members(rng, n):
    return [(rng.choice([rng.randrange(500), rng.randrange(10**7), -rng.randrange(50)]), [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]) for _ in range(n)]


def covered_by(members):
    ends = {tuple(p) for _, p in members}
    return {end: len({i for i, p in members if i is not None and tuple(p[: len(end)]) == end}) for end in ends}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_coverage(spark, kind):
    members = some_members(random.Random(7), 800) + [(None, ["a"]), (5, ["a"]), (5, ["a"]), (6, [])]
    df = spark.createDataFrame(members, "item long, path array<string>").withColumn("item", F.col("item").cast(kind))
    nodes = tree.build(df.select("path"))
    got = {tuple(r.path): r.covered for r in tree.coverage(df, nodes, "item").collect()}
    assert got == {k: v for k, v in covered_by(members).items() if k}


def test_preorder_is_that_of_a_walk(spark):
    members = some_members(random.Random(3), 300)
    df = spark.createDataFrame(members, "item long, path array<string>")
    nodes = tree.build(df.select("path"))
    covered = tree.coverage(df, nodes, "item")
    rows = tree.preorder(nodes, tree.condensed_parents(nodes, covered), covered)
    # an order over all nodes would be a window without keys
    assert "windowspecdefinition(path" not in rows._jdf.queryExecution().toString()
    counts = covered_by(members)
    children = {}
    for path in counts:
        parent = next((path[:k] for k in range(len(path) - 1, 0, -1) if path[:k] in counts), None)
        children.setdefault(parent, []).append(path)
    want = []

    def walk(parent, depth):
        for path in sorted(children.get(parent, []), key=lambda p: (-counts[p], p[-1], p)):
            want.append((len(want) + 1, path, parent, depth, counts[path]))
            walk(path, depth + 1)

    walk(None, 1)
    assert sorted((r.nth, tuple(r.path), None if r.parent is None else tuple(r.parent), r.depth, r.covered) for r in rows.collect()) == want
    assert all(w.nth == i for i, w in enumerate(rows.orderBy("nth").collect(), 1))
