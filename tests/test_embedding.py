import numpy as np

from sparkloom.operators import embedding, vectors


def test_neighbours_and_map(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 6
    rows = [(i, (centres[i % 8] + rng.normal(size=8)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    like = unit @ unit.T - 2 * np.eye(240)
    edges = embedding.neighbours(df, "id", "v", k=5).collect()
    assert len(edges) == 240 * 5 and all(abs(e.similarity - like[e.a, e.b]) < 1e-9 for e in edges)
    assert {(e.a, e.b) for e in edges} == {(a, int(b)) for a in range(240) for b in np.argsort(-like[a])[:5]}

    def kept(frame):
        at = np.array([(r.x, r.y) for r in sorted(frame.collect(), key=lambda r: r.id)])
        far = ((at[:, None] - at[None]) ** 2).sum(axis=2) + 1e9 * np.eye(240)
        return np.mean([np.mean(np.argsort(far[i])[:8] % 8 == i % 8) for i in range(240)])

    flat, mapped = kept(vectors.two_dimensions(df, "v").select("id", "x", "y")), kept(embedding.neighbour_map(df, "id", "v"))
    assert mapped > 0.9 and mapped > flat + 0.1


def test_buckets_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 400)] + [(400, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    edges = embedding.neighbours(df, "id", "v", k=3, bucket=20).collect()
    assert {e.a for e in edges} == set(range(400)) and max(sum(e.a == i for e in edges) for i in range(5)) <= 3
    assert all(e.b >= 300 for e in edges if e.a >= 300 and e.similarity > 0.999999) and all(e.a != e.b for e in edges)
