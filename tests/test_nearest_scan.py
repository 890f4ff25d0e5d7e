"""The nearest bounds on both sides come from one scan."""

import random

from keepsake.operators.joins import nearest_bounds


def test_both_sides_in_one_scan(spark):
    pick = random.Random(5)
    bounds = [(k, float(pick.randrange(-40, 40))) for k in (1, 2, 3, None) for _ in range(12)] + [(1, None), (5, 3.0), (6, float("inf"))]
    points = [(k, pick.randrange(-100, 100) / 2, f"{k}-{i}") for k in (1, 2, 3, 4, 5, 6, None) for i in range(60)] + [(1, None, "x"), (4, None, "y")]
    b = spark.createDataFrame(bounds, "k long, b double")
    p = spark.createDataFrame(points, "k long, x double, name string")
    for block in (1.0, 16.0, 1000.0):
        out = nearest_bounds(p, b, "k", "x", "b", block)
        got = {r.name: (r.k, r.x, r.below, r.above) for r in out.collect()}
        assert len(got) == len(points)
        for k, x, name in points:
            own = [v for j, v in bounds if j == k and v is not None and x is not None]
            assert got[name] == (k, x, max((v for v in own if v <= x), default=None), min((v for v in own if v >= x), default=None))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 3     # the rows, and one row a block twice
