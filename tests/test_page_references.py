"""Pages whose text was cut inside a character reference."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keepsake.compare import compare
from keepsake.functions import text as X
from keepsake.plans import REGISTRY
from keepsake.plans.registry import Tables

HTML = ['<html lang="en"><head><title>a &amp;&amp;&amp</title></head><body>one two three &amp;lt; four &amp and &lt</body>',
        '<title>&copy; &#39;x&#39; &eacute; &#x41;</title><p>five &quot;six&quot; &apos;seven&apos; &nbsp;&middot; &hellip; &lt;</p>']


@pytest.mark.parametrize("name", ["src_html_text", "src_page_extract"])
def test_sql(spark, tmp_path, name):
    import duckdb

    pq.write_table(pa.table({"page_id": [1, 2], "url": ["https://a.example/x"] * 2, "html": HTML}),
                   f"{tmp_path}/pages.parquet")
    df = REGISTRY[name].build(Tables(spark, str(tmp_path)))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert compare(df.schema, df.collect(), duck.execute(REGISTRY[name].sql)) is None


def test_operator_still_reads_all_references(spark):
    row = spark.range(1).select(X.html_text(F.lit("a &amp b &eacute; &#x41;")).alias("t")).first()
    assert row.t == "a & b é A"
