"""Index rows are sorted once: the window's order serves the join with the parents."""

import re

import pytest
from pyspark.sql import functions as F

from keepsake.operators import mutate as U


@pytest.fixture
def plain(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_are_sorted_once(plain, monkeypatch):
    index = plain.createDataFrame([(1, 5, "a"), (1, 3, "b"), (1, None, "n"), (2, 9, "c"), (3, 1, "d"), (None, 4, "e")],
                                  "k long, r long, v string").filter(F.col("r").isNotNull() | (F.col("k") == 1))
    parents = plain.createDataFrame([(1,), (1,), (2,), (7,), (None,)], "k long")
    plans = []
    write = U.reliable
    monkeypatch.setattr(U, "reliable", lambda df: plans.append(df) or write(df))
    table, n = U.purge_stale_counted(index, parents, "k", "r")
    kept = [(1, None, "n"), (2, 9, "c")]
    assert n == 4 and sorted(map(tuple, table.collect())) == kept and table.columns == index.columns
    out = U.purge_stale(index, parents, "k", "r")
    assert sorted(map(tuple, out.collect())) == kept and out.columns == index.columns
    for df, sorts in ((plans[0], 1), (out, 2)):      # before the shuffle too, where only the first of a key goes on
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and len(re.findall(r"Sort \[k#\d+L ASC NULLS FIRST, r#", plan)) == sorts
        assert len(re.findall(r"Sort \[k#\d+L ASC NULLS FIRST\]", plan)) == 1      # the parents
