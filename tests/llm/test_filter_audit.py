import random
import re
from itertools import permutations

import pytest

from sparkloom.llm import filter_audit
from sparkloom.llm.filter_audit import FILTERS

ORDERS = ["".join(p) for p in permutations(FILTERS)]
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    told = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": any(c in text for c in "#$%&*|"),
    }
    return "".join(f for f in told if told[f])


def plain(docs, labels):
    """Every order run over every document, one filter after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        copy = i is not None and least[text or ""] < i
        rows.append((part or "", fails(text or "") + "E" * copy, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys(FILTERS, 0)
        found = []
        for order in ORDERS:
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                found.append([part, order, step, len(left), len(gone), redundant, sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*x, removed_by[x[1][x[2] - 1]]) for x in found]
    return out


def collected(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def some_text(rng):
    n = rng.choice([0, 1, 5, 199, 200, 201, 260])
    words = [rng.choice(["a", "bb", "Ccc", "ddd", "é"]) + (str(k) if rng.random() < 0.6 else "") for k in range(n)]
    return rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b \x0c", "\r\n", "\x1c"]).join(words) + rng.choice(["", "#", "|", " ", "X"])


def test_against_every_order(spark):
    rng = random.Random(12)
    texts = [some_text(rng) for _ in range(60)] + ["", None]
    docs = [(i, rng.choice(texts), rng.choice(["x", "y", "", None])) for i in rng.sample(range(1000), 150)]
    docs += [(None, rng.choice(texts), "x") for _ in range(10)] + [(docs[0][0], docs[0][1], "z")] * 3 + [docs[1]] * 2
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, _, _ in docs[:80]] + [(docs[0][0], 1, None), (docs[1][0], None, 1), (None, 1, 1)]
    # columns whose names clash with those on the way
    rows = [(d, t, s, 1, "a", 2) for d, t, s in docs]
    got = filter_audit.audited(
        spark.createDataFrame(rows, "doc_id int, text string, source string, part long, same string, n int"), spark.createDataFrame([(*x, "a") for x in labels], "doc_id long, quality int, toxic int, part string")
    )
    assert collected(got) == sorted(plain(docs, labels))


def test_boundaries(spark):
    exact = [
        " ".join(f"w{k}" for k in range(200)),  # no filter
        " ".join(f"w{k}" for k in range(199)),  # A
        " ".join(f"w{k % 100}" for k in range(200)),  # exactly half distinct: no filter
        " ".join(f"w{k % 99}" for k in range(200)),  # B
        "AB" + "x" * 98,  # A, and two of a hundred: not C
        "ABC" + "x" * 97,  # A and C
        "E" + "é" * 49,  # exactly two per cent of the code points, not of the bytes
        "w \x1cw\x85w",  # separators of other kinds hold words together
    ]
    docs = [(i, t, "s") for i, t in enumerate(exact)]
    got = filter_audit.audited(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert collected(got) == sorted(plain(docs, []))


def test_copies_across_parts_and_very_long_texts(spark):
    long = "word Other " * 200_000
    docs = [(i, long if i % 2 else "copy", f"s{i % 3}") for i in range(30)]
    labels = [(i, i % 2, 1) for i in range(30)]
    made = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audited(*made)) == sorted(plain(docs, labels))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audited(docs, labels)) == []


@pytest.mark.parametrize("size", [1, 3, 5])
def test_inversion(spark, size):
    """Joint failures of a known number of documents for each pattern give these numbers back."""
    rng = random.Random(size)
    counts = [rng.randrange(50) for _ in range(1 << size)]
    names = FILTERS[:size]
    rows = [("p", *((m >> i & 1) == 1 for i in range(size)), False, False, n) for m, n in enumerate(counts)]
    joint = filter_audit.joint_failures(spark.createDataFrame(rows, "part string, " + "".join(f"{f} boolean, " for f in names) + "good boolean, toxic boolean, n long"), names)
    each = range(size)
    kept, only, shapley = (", ".join(f("all", m, size) for m in some) for f, some in ((filter_audit.survivors, range(1 << size)), (filter_audit.only, each), (filter_audit.shapley, each)))
    got = joint.selectExpr(f"array({kept})", f"array({only})", f"array({shapley})").first()
    assert got[0] == [sum(n for m, n in enumerate(counts) if not m & s) for s in range(1 << size)]
    assert got[1] == [counts[1 << i] for i in range(size)]
    orders = list(permutations(range(size)))
    removed = [sum(n for o in orders for m, n in enumerate(counts) if m >> i & 1 and not any(m >> j & 1 for j in o[: o.index(i)])) for i in range(size)]
    assert got[2] == removed
