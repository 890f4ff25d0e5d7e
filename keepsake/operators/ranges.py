"""Ordered passes over sorted range partitions with carried summaries.

The rows of all series are cut into ranges of (series, order) at sampled quantiles and sorted inside them, so that every
task gets about the same number of rows, however long a series is and however many of its rows lie close together. One
pass inside the ranges numbers the rows and takes the value before; a series that crosses a range's end gets one summary
row for each range, from which what came before is carried into the next. A range is also a block in the sense of
``blocks``: it never decreases along a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.blocks import join_nullsafe
from keepsake.session import reliable


def _differs(column: pa.Array) -> np.ndarray:
    """Null-safe: does each value but the first differ from the one before?"""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def ranged(series: DataFrame, key: str, order: list[str], extra: list[str] | None = None,
           parts: int | None = None) -> DataFrame:
    """``key``, ``order`` and ``extra`` with ``rn`` (position in the series, from 1), ``gap`` (first order column less
    that of the row before, null for the first row) and ``part``, the number of the row's range. Written once.

    ``parts`` ranges are made, by default as many as Spark makes shuffle partitions. The first order column is numeric.
    """
    spark = series.sparkSession
    columns = [key, *order, *(extra or [])]
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = series.select(*columns)
    kinds = dict(rows.dtypes)
    sorted_ = (rows.repartitionByRange(count, key, *order).sortWithinPartitions(key, *order)
               .withColumn("part", F.spark_partition_id().cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, last = None, 0, np.nan        # key, rows and value of the series that the last batch ended in
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            new = np.r_[held == 0 or keys[0].as_py() != before, _differs(keys)]
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(first < 0, at + held, at - first)
            value = batch.column(order[0]).to_numpy(zero_copy_only=False).astype(float)
            gap = value - np.r_[last, value[:-1]]
            before, held, last = keys[-1].as_py(), int(place[-1]) + 1, value[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place + 1), pa.array(gap, mask=new | np.isnan(gap))],
                [*batch.schema.names, "rn", "gap"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "part long, rn long, gap double"])
    placed = reliable(sorted_.mapInArrow(run, schema))
    ends = placed.groupBy(key, "part").agg(F.max("rn").alias("n"), F.max_by(order[0], "rn").alias("v"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"),
                       F.array().cast("array<struct<part: long, base: long, prev: double>>").alias("out"))
    summed = F.aggregate("ends", nothing, lambda acc, e: F.struct(
        (acc["n"] + e["n"]).alias("n"), e["v"].cast("double").alias("v"),
        F.concat(acc["out"], F.array(F.struct(e["part"].alias("part"), acc["n"].alias("base"), acc["v"].alias("prev"))))
        .alias("out")))
    # only series that cross a range's end, of which there is one for each end
    crossing = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "n", "v"))).alias("ends")).filter(
        F.size("ends") > 1).select(key, F.inline(summed["out"])).filter("base > 0")
    return join_nullsafe(placed, F.broadcast(crossing), [key, "part"]).withColumns({
        "gap": F.when((F.col("rn") == 1) & F.col("base").isNotNull(), F.col(order[0]) - F.col("prev"))
        .otherwise(F.col("gap")),
        "rn": F.col("rn") + F.coalesce("base", F.lit(0))}).drop("base", "prev")
