import math
import random

from pyspark.sql import functions as F

from sparkloom.operators import layout


def test_a_step_like_every_pair(spark):
    """Dense cells in several tiles, dots at one place in several groups, a negative zero, dots at no place."""
    rng = random.Random(5)
    dots = [(i, rng.choice([0.0, -0.0, 0.5, 3.0, rng.uniform(-9, 9)]), rng.choice([0.0, 1.0, rng.uniform(-9, 9)])) for i in range(150)] + [(200, float("nan"), 1.0), (201, None, 0.0), (202, float("inf"), 0.0), (203, 1e-200, 0.0)]
    points = spark.createDataFrame([(*d, 1.0, 2.0) for d in dots], "id long, x double, y double, home_x double, home_y double")
    ids = spark.createDataFrame([(a[0], b[0]) for a in dots for b in dots if a[0] < b[0]], "a long, b long")
    angle = {(r.a, r.b): r.h * math.pi / 180 for r in ids.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(360)).alias("h")).collect()}
    moved = {i: [0.0, 0.0] for i, _, _ in dots}
    for a, ax, ay in dots:
        for b, bx, by in dots:
            if a < b and None not in (ax, bx) and (far := math.hypot(ax - bx, ay - by)) < 4.0:
                ux, uy = ((ax - bx) / far, (ay - by) / far) if far else (math.cos(angle[a, b]), math.sin(angle[a, b]))
                for i, s in ((a, 1), (b, -1)):
                    moved[i][0] += s * ux * (4.0 - far) / 2
                    moved[i][1] += s * uy * (4.0 - far) / 2
    want = {i: None if x is None else (x + moved[i][0] + (1.0 - x) * layout.SPRING, y + moved[i][1] + (2.0 - y) * layout.SPRING) for i, x, y in dots}
    for sizes in ({}, {"tile": 3, "crowd": 2}):
        got = {r.id: (r.x, r.y) for r in layout.relax_step(points, 4.0, **sizes).collect()}
        assert len(got) == len(dots) and got[201][0] is None and math.isnan(got[200][0])
        assert all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) for i in want if i < 200 or i == 203 for u, v in zip(got[i], want[i]))
