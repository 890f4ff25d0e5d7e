"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

from keepsake.compare import compare, oracle
from keepsake.plans import REGISTRY, Tables

FOLDER = os.environ.get("KEEPSAKE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    plan = REGISTRY[name]
    df = plan.build(Tables(spark, FOLDER))
    rows = df.collect()
    if plan.sql is not None:
        assert compare(df.schema, rows, duck.execute(plan.sql)) is None
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
