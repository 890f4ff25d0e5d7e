"""Percentiles to the last bit: thresholds are compared with values that stand exactly on them."""

import random

from keepsake.operators.blocks import exact_percentiles


def test_last_bit(spark):
    import duckdb

    rng = random.Random(1)
    series = {0: [0.32, 82.68, 82.88, 162.67, 188.2]} | {
        k: [round(rng.uniform(0, 200), 2) for _ in range(rng.choice([1, 2, 4, 5, 7, 8, 9, 13, 70]))] for k in range(1, 400)}
    rows = [(k, x) for k, v in series.items() for x in v]
    got = {r.k: (r.p20, r.p50) for r in exact_percentiles(
        spark.createDataFrame(rows, "k long, x double"), ["k"], "x", {"p20": 0.2, "p50": 0.5}).collect()}
    duck = duckdb.connect()
    ask = "SELECT quantile_cont(x, 0.2), quantile_cont(x, 0.5) FROM (SELECT unnest(?::DOUBLE[]) AS x)"
    assert got == {k: duck.execute(ask, [v]).fetchone() for k, v in series.items()}


def test_values_beyond_any_split(spark):
    rows = [(1, float("inf")), (1, 1.0), (2, 2.0 ** 1020), (2, 3 * 2.0 ** 1020), (3, float("inf")), (3, float("inf"))]
    got = {r.k: r.m for r in exact_percentiles(
        spark.createDataFrame(rows, "k long, x double"), ["k"], "x", {"m": 0.5}).collect()}
    assert got == {1: float("inf"), 2: 2.0 ** 1021, 3: float("inf")}
