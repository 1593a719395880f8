import math
import random

from sparkloom.operators import browse


def test_pairs_are_dealt_by_cell(spark):
    """Each pair once, also across cells, and the repeated side is not broadcast."""
    rng = random.Random(6)
    dots = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)] + [(i, 5.0, 5.0) for i in range(300, 305)]
    pairs = browse.neighbour_pairs(spark.createDataFrame(dots, "id long, x double, y double"), "id", "x", "y", 4.0)
    want = sorted((a[0], b[0]) for a in dots for b in dots if a[0] < b[0] and math.dist(a[1:], b[1:]) < 4.0)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
