"""Totals of a listing: skipped types, keys that exist, keys that are new."""

from pyspark.sql import functions as F

from keepsake.sources import capture as C


def test_listing_totals(spark):
    rows = [("a", 1, 2), ("a", 1, 2), ("a", 2, 2), ("a", 3, 7), ("a", None, 2), ("a", 4, None),
            ("b", 1, 2), ("b", 5, 2), ("b", 6, 2), ("c", 9, 1)]
    listing = spark.createDataFrame(rows, "src string, key long, type int").repartition(3)
    known = spark.createDataFrame([(2,), (6,), (6,), (None,)], "key long")
    out = C.listing_totals(listing, known, "src", "key", F.col("type") == 2).orderBy("src").collect()
    assert [tuple(r) for r in out] == [("a", 6, 3, 1, 2), ("b", 3, 0, 1, 2), ("c", 1, 1, 0, 0)]
    assert C.listing_totals(listing.limit(0), known, "src", "key", F.col("type") == 2).count() == 0
    assert C.listing_totals(listing, known.limit(0), "src", "key", F.lit(True)).agg(F.sum("new")).first()[0] == 7
