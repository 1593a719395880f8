import random
import re

from sparkloom.llm.near_dedup import components, near_duplicates


def brute(rows):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), (doc if not sets[i] else least.get(find(i)))) for i, (doc, _) in enumerate(rows) if doc is not None)


def words(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for base in range(6):
        w = words(rng, rng.choice([30, 80, 160, 300]))
        texts.append(" ".join(w))
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randrange(0, 5)):
                v[rng.randrange(len(v))] = "changed" + str(rng.randrange(1000))
            texts.append(rng.choice([" ", "\n", "\t "]).join(v))
    # edited copies whose origin is the largest id, and a chain a-b-c whose ends are not alike
    w = words(rng, 70)
    texts += [" ".join([*w[:i], "odd", *w[i + 1 :]]) for i in range(3, 60, 8)] + [" ".join(w)]
    texts += ["a b", "a b", "A B", "", None, "   ", "one two three four five"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = near_duplicates(df, block=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(None, "same words in both of these rows"), (7, "same words in both of these rows"), (None, None), (3, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(None, 3, 7, False), (7, 3, 7, True), (None, 0, None, True), (3, 0, 3, True)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")]
    found = {bytes(r.node): bytes(r.component) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert {v for k, v in found.items() if k < b"w"} == {bytes([0])} and found[b"y"] == b"x"


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, "x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


def test_rows_are_taken_out_by_number(spark):
    from sparkloom.llm.common import free_name, without

    docs = spark.range(0, 1000, 1, 7).selectExpr("id AS doc_id", "string(id) AS text", "id AS row")
    name = free_name(docs, "row")
    assert name == "_row"
    from pyspark.sql import functions as F

    from sparkloom.llm.common import stage

    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    gone = numbered.filter("doc_id % 3 = 0").select(F.col(name).alias("row"))
    left = without(numbered, name, gone)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [i for i in range(1000) if i % 3]
    assert without(numbered, name, gone.limit(0)).count() == 1000
