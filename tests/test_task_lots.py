"""Tasks that name no item are dealt over the partitions; the larger side of a removal is not sorted."""

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


def tasks(spark):
    return spark.range(2000).select(
        "id", F.when(F.col("id") % 7 == 0, "other").otherwise("build_links").alias("type"),
        F.when(F.col("id") % 10 == 0, "pending").otherwise("done").alias("status"),
        F.when(F.col("id") % 20 > 0, F.lit(None)).otherwise(F.concat(F.lit('{"item_id": '), F.col("id"), F.lit("}"))).alias("payload"))


def test_tasks_without_item_are_dealt(plain):
    ids = plain.createDataFrame([(20,), (20,), (140,), (None,), (10,)], "id long")
    out = U.cancel_tasks(tasks(plain), ids)
    assert out.columns == ["id", "type", "status", "payload"]
    assert sorted(r.id for r in out.collect()) == [i for i in range(2000) if i != 20]     # 140 is another type
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 700
    table, n = U.cancel_tasks_counted(tasks(plain), ids)
    assert n == 1 and table.columns == out.columns and table.count() == 1999


def test_removed_items_are_hashed(plain):
    items = plain.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "a")], "id long, source_ref string")
    rows = plain.createDataFrame([(1,), (2,), (None,)], "item_id long")
    links = plain.createDataFrame([(1, 2), (2, 1), (2, 3)], "item_a long, item_b long")
    refs = plain.createDataFrame([("a",), (None,)], "source_ref string")
    # a null id is in no list: its row stays
    out = U.delete_by_source(refs, items, rows, rows, links, tasks(plain))
    assert {k: v.count() for k, v in out.items()} == {"items": 3, "chunks": 2, "vectors": 2, "links": 1, "jobs": 2000}
    for df in out.values():
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
