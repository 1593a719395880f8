import numpy as np
import pytest

from sparkloom.llm.block_search import nearest, products, quantised

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if q in queries:
            found = sorted((-sum(a * b for a, b in zip(v, w)) / (np.sqrt(sum(a * a for a in v)) * np.sqrt(sum(b * b for b in w))), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(150)] + [(i, [1.0] * 16, 1) for i in range(150, 200)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [], 1), (205, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (206, [1.0, 2.0], 1), (207, (rng.normal(size=16) * 1e20).tolist(), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = {0, 50, 100, 150, 160, 200, 203, 206, 207}
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.filter(df.vec_id.isin(list(queries))), query_block=block, candidate_block=block * 3).collect())
    want = brute(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)], SCHEMA)
    assert [tuple(r) for r in nearest(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_products_are_exact_and_bounds_hold_in_many_dimensions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3072))
    x[20:] = x[:20] + rng.normal(size=(20, 3072)) * 1e-3
    codes, scale, near, miss = quantised(x)
    assert (products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    full = np.full((2, 5000), 127, np.int8)
    assert (products(full, full) == 127 * 127 * 5000).all()
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    error = near[:, None] * miss + miss[:, None]
    assert (np.abs(unit @ unit.T - products(codes, codes) * scale[:, None] * scale) <= error).all()


def test_repeated_candidates_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 7), (1, [0.5, 0.5], 1, 7), (1, [0.5, 0.5], 1, 7), (2, [0.0, 1.0], 1, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, codes int")
    got = [(r.rank, r.vec_id) for r in sorted(nearest(df, df.filter("vec_id = 0")).collect())]
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_many_copies_of_one_vector(spark):
    from sparkloom.llm.block_search import _surplus_copies

    rows = [(i, [1.0, 2.0], 1) for i in range(0, 600, 2)] + [(i, [1.0, float(i)], 1) for i in range(1, 60, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0"), query_block=4, candidate_block=40).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got[0] == {1: 2, 2: 4, 3: 6, 4: 8, 5: 10} and got[550] == {1: 0, 2: 2, 3: 4, 4: 6, 5: 8} and len(got) == 12
    numbered = df.selectExpr("vec_id AS id", "embedding AS v", "monotonically_increasing_id() AS row")
    assert _surplus_copies(numbered, 5).count() == 294
