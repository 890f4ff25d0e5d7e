"""Streams over tables that are folders of files, as larger tables are."""

import pytest

from keepsake.compare import compare, oracle
from keepsake.plans import REGISTRY
from keepsake.plans.registry import Tables

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("folders"))
    for name in ("pages", "conversations"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_capture_dedup", "stream_embed_append", "stream_merge_segments"])
def test_stream_reads_every_file(spark, folders, name):
    df = REGISTRY[name].build(Tables(spark, folders))
    rows = df.collect()
    assert rows and compare(df.schema, rows, oracle(SOURCE).execute(REGISTRY[name].sql)) is None
