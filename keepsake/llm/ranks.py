"""Exact global ranks and neighbours without putting a whole table, or one hot value, into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.session import scratch_folder


def shared_write(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back: later jobs don't compute it again.

    The folder is below ``spark.checkpoint.dir``; a temporary one is only taken on a local master without that setting.
    """
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, hash_column: str, rows: int, *ties: Column) -> DataFrame:
    """The ``rows`` rows with the smallest 64-bit hash, a fixed sample.

    Rows far above the expected place are left out first, so that tasks don't each keep ``rows`` of their own; the
    margin is six standard deviations.
    """
    share = (rows + 6 * rows ** 0.5 + 10) / max(1, df.count())
    near = df if share >= 1 else df.filter(F.col(hash_column) <= int(-(2 ** 63) + share * 2 ** 64))
    return near.orderBy(hash_column, *ties).limit(rows)


def rank_within(df: DataFrame, group: str, bucket: Column, *order: Column) -> DataFrame:
    """``rank`` (from 0) of each row inside ``group``; rows are ordered by bucket, then ``order``.

    ``bucket`` must be a function of the row's values and bound the rows of one (group, bucket). Counts of buckets are
    summed first; only they are ordered inside a group.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
            .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (rows.withColumn("_rn", F.row_number().over(inside)).join(base, [group, "_bucket"])
            .withColumn("rank", F.col("_base") + F.col("_rn") - 1).drop("_bucket", "_base", "_rn"))


def with_next(keys: DataFrame, key: str, rows: int = 100_000, most: int = 4096) -> DataFrame:
    """(key, next): the following distinct value of a long column; the last is followed by the first.

    Values are cut into ranges at sampled quantiles (about ``rows`` in each, ``most`` ranges at most); neighbours are
    found inside a range, and the smallest value of each range closes the one before.
    """
    values = shared_write(keys.select(key).filter(F.col(key).isNotNull()).distinct())
    parts = max(1, min(most, values.count() // rows))
    cuts = sorted(set(values.withColumn("_d", F.col(key).cast("double")).approxQuantile(
        "_d", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")] if cuts else [-float("inf"), 0.0, float("inf")],
                        inputCol="_d", outputCol="_range").transform(values.withColumn("_d", F.col(key).cast("double")))
    heads = ranged.groupBy("_range").agg(F.min(key).alias("_head"))
    order = Window.orderBy("_range")      # one row for each range
    closing = (heads.withColumn("_after", F.lead("_head").over(order))
               .withColumn("_first", F.min("_head").over(Window.partitionBy(F.lit(0))))
               .select("_range", F.coalesce("_after", "_first").alias("_close")))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return (ranged.withColumn("_in", inside).join(F.broadcast(closing), "_range")
            .select(key, F.coalesce("_in", "_close").alias("next")))
