"""Changed rows are counted in the write of the changed table."""

import pytest
from pyspark.sql import functions as F

from keepsake.operators import mutate as U
from keepsake.sources import files

SCHEMA = "id long, status string, domain string"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "inbox", "a"), (2, "inbox", "b"), (3, None, "a"), (4, "done", "a"), (5, "inbox", None)],
                                 SCHEMA).repartition(3)


def test_bulk_set_status(items):
    table, n = U.bulk_set_status_counted(items, "inbox", "archived", "a")
    assert n == 1 and sorted((r.id, r.status) for r in table.collect()) == [
        (1, "archived"), (2, "inbox"), (3, None), (4, "done"), (5, "inbox")]
    assert table.columns == items.columns
    assert U.bulk_set_status_counted(items, "inbox", "archived")[1] == 3
    assert U.bulk_set_status_counted(items, "gone", "archived")[1] == 0


def test_delete_keys(spark, items):
    keys = spark.createDataFrame([(1,), (1,), (4,), (99,), (None,)], "id long")
    table, n = U.delete_keys_counted(items, keys, ["id"])
    assert n == 2 and sorted(r.id for r in table.collect()) == [2, 3, 5] and table.columns == items.columns
    assert U.delete_keys_counted(items, keys.filter("id = 99"), ["id"])[1] == 0


def test_the_write_reads_the_table_once(spark, items, tmp_path):
    path = str(tmp_path / "items")
    items.write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    table, n = U.bulk_set_status_counted(spark.read.parquet(path).mapInArrow(count, SCHEMA), "inbox", "archived")
    assert n == 3 and table.count() == 5 and reads.value == 5


def test_tasks_and_index(spark):
    jobs = spark.createDataFrame([
        (1, "auto_process", "pending", '{"item_id": 7}', None), (2, "auto_process", "done", '{"item_id": 7}', None),
        (3, "build_links", "running", '{"item_id": 8}', None), (4, "ingest_text", "running", '{"item_id": 7}', "old"),
        (5, "build_links", "pending", "broken", None)], "id long, type string, status string, payload string, error string")
    ids = spark.createDataFrame([(7,), (8,), (7,)], "id long")
    table, n = U.cancel_tasks_counted(jobs, ids)
    assert n == 2 and sorted(r.id for r in table.collect()) == [2, 4, 5] and table.columns == jobs.columns
    table, n = U.recover_running_counted(jobs)
    assert n == 2 and table.filter("status = 'running'").isEmpty()
    index = spark.createDataFrame([(1, 5), (1, 3), (2, 1), (None, 2)], "item_id long, row_id long")
    table, n = U.purge_stale_counted(index, spark.createDataFrame([(1,), (1,), (3,)], "item_id long"), "item_id", "row_id")
    assert n == 3 and [tuple(r) for r in table.collect()] == [(1, 3)]


def test_doubled_vectors_have_one_winner(spark):
    old = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], "chunk_id long, embedding array<float>")
    new = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 3.0]), (1, [0.5, 9.0])], old.schema)
    for parts in (1, 2, 3):
        got = files.upsert_vectors(old, new.repartition(parts)).orderBy("chunk_id").collect()
        assert [(r.chunk_id, r.embedding) for r in got] == [(1, [1.0, 3.0]), (2, [9.0, 9.0])]


def test_empty_tables(items):
    assert U.bulk_set_status_counted(items.filter(F.col("id") < 0), "inbox", "archived")[1] == 0
