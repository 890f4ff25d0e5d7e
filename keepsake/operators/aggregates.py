"""Counts, reports and integrity checks. All of them aggregate map-side before shuffling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.blocks import rank_pick


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_items(items: DataFrame, status: str | None = None, domain: str | None = None,
                category_id: int | None = None) -> DataFrame:
    for column, value in (("status", status), ("domain", domain), ("category_id", category_id)):
        if value is not None:
            items = items.filter(F.col(column) == value)
    return items.agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
                      for name, df in tables.items()])


def category_counts(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Every category with its number of items; zero where none."""
    n = items.groupBy("category_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (categories.join(n, categories["id"] == n["category_id"], "left").drop("category_id")
            .withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("long"))))


def duplicates(df: DataFrame, key: Column, name: str = "copies") -> DataFrame:
    """Rows whose key occurs more than once. The key is hashed, the count is map-side."""
    keyed = df.withColumn("_key", F.sha2(key, 256))
    n = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
    return keyed.join(n, "_key").drop("_key")


def check_row(name: str, df: DataFrame, ok: Column, detail: Column) -> DataFrame:
    """One named check from a one-row aggregate."""
    return df.select(F.lit(name).alias("check_name"), ok.alias("ok"), detail.cast("string").alias("detail"))


def integrity_report(items: DataFrame, chunks: DataFrame, vectors: DataFrame, logs: DataFrame, *,
                     as_of: Column, min_items: int, min_logs: int) -> DataFrame:
    """Named store checks: sizes, parity, orphans, time windows, formats, duplicates.

    ``items(id, title, status)``, ``chunks(id, item_id, modality, embed_status, content)``,
    ``vectors(chunk_id)``, ``logs(happened_at, happened_text)``. ``as_of`` is an aggregate over
    logs. Each table is scanned once for its own counts.
    """
    one = F.count(F.lit(1))
    n_items = items.agg(one.alias("n"), F.count_if(F.col("status") == "filed").alias("filed"))
    text = F.col("modality") == "text"
    n_chunks = chunks.agg(
        F.count_if(text & F.col("content").isNotNull()).alias("n"),
        F.count_if(text & (F.coalesce("embed_status", F.lit("")) != "done")).alias("bad"))
    n_vectors = vectors.agg(one.alias("v"))
    orphans = chunks.select("item_id").join(items.select(F.col("id").alias("item_id")), "item_id",
                                            "left_anti").agg(one.alias("n"))
    latest = logs.agg(as_of.alias("as_of"))
    within = lambda days: F.count_if(
        F.col("happened_at") >= F.col("as_of") - F.expr(f"interval {days} days"))
    n_logs = logs.join(F.broadcast(latest)).agg(      # one row
        one.alias("n"), within(7).alias("d7"), within(45).alias("d45"), within(3650).alias("all"),
        F.count_if(F.contains("happened_text", F.lit("T"))).alias("bad"))
    dup = duplicates(items.select("id", "title"), F.col("title")).agg(one.alias("n"))
    parity = n_chunks.join(n_vectors)                 # one row each
    c = F.col
    return union_all([
        check_row("items_size", n_items, c("n") >= min_items, c("n")),
        check_row("logs_size", n_logs, c("n") >= min_logs, c("n")),
        check_row("vectors_match_chunks", parity, c("n") == c("v"), c("n") - c("v")),
        check_row("all_chunks_embedded", n_chunks, c("bad") == 0, c("bad")),
        check_row("no_orphan_chunks", orphans, c("n") == 0, c("n")),
        check_row("window_covers_all", n_logs, c("all") == c("n"), c("n") - c("all")),
        check_row("window_is_subset", n_logs, (c("d7") > 0) & (c("d7") <= c("d45")), c("d7")),
        check_row("time_format", n_logs, c("bad") == 0, c("bad")),
        check_row("filed_items", n_items, F.lit(True), c("filed")),
        check_row("same_titles", dup, F.lit(True), c("n")),
    ])


def usage_unitized(items: DataFrame, chunks: DataFrame, unit: Column) -> DataFrame:
    """Items with at least one unit chunk, and the rest."""
    n = chunks.agg(F.count_distinct(F.when(unit, F.col("item_id"))).alias("unitized"))
    total = items.agg(F.count(F.lit(1)).alias("total"))
    return n.join(total).select("unitized", F.greatest(       # one row each
        F.lit(0).cast("long"), F.col("total") - F.col("unitized")).alias("remaining"))


def speech_ratio(segments: DataFrame, durations: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spoken share per series; 1.0 when the duration is zero."""
    spoken = segments.groupBy(key).agg(
        F.sum(F.greatest(F.lit(0.0), F.col(end) - F.col(start))).alias("speech_seconds"))
    return durations.join(spoken, key, "left").withColumn(
        "speech_seconds", F.coalesce("speech_seconds", F.lit(0.0))).withColumn(
        "speech_ratio", F.when(F.col("duration") > 0, F.col("speech_seconds") / F.col("duration"))
        .otherwise(F.lit(1.0)))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """The element at position ``n div 2`` (zero based) of the sorted values, per key."""
    return rank_pick(df, keys, value, name, F.floor(F.col("_total") / 2))


def text_rate(lines: DataFrame, frames: DataFrame, series: str, frame: str, y0: str, y1: str,
              n_bands: int = 24) -> DataFrame:
    """Share of sampled frames with text, per series and band.

    The bands of a frame are kept as bits, so one row per (series, frame) is shuffled however many bands its lines cover.
    """
    lo = F.greatest(F.lit(0), F.floor(F.col(y0) * n_bands).cast("int"))
    hi = F.least(F.lit(n_bands - 1), F.floor(F.col(y1) * n_bands).cast("int"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)      # noqa: E731
    words = range(0, n_bands, 62)       # bits a long holds

    def covered(at: int) -> Column:
        inside = lambda n: F.least(F.lit(62), F.greatest(F.lit(0), n - at))      # noqa: E731
        return F.coalesce(F.when(lo <= hi, bit(inside(hi + 1)) - bit(inside(lo))), F.lit(0).cast("long"))

    seen = lines.groupBy(series, frame).agg(*[F.bit_or(covered(at)).alias(f"_w{at}") for at in words])
    counts = seen.groupBy(series).agg(F.count(F.lit(1)).alias("_frames"), *[
        F.sum(F.shiftright(f"_w{b // 62 * 62}", b % 62).bitwiseAND(F.lit(1).cast("long"))).alias(f"_b{b}")
        for b in range(n_bands)])
    if frames is not lines:
        total = frames.select(series, frame).distinct().groupBy(series).agg(F.count(F.lit(1)).alias("_frames"))
        counts = counts.drop("_frames").join(total, series)
    return counts.filter(F.col(series).isNotNull()).select(series, F.col("_frames").alias("frames"), F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"_b{b}").alias("frames_seen")) for b in range(n_bands)])).alias("_s")).filter(
        F.col("_s.frames_seen") > 0).select(series, "_s.band", "_s.frames_seen", "frames").withColumn(
        "text_rate", F.col("frames_seen") / F.col("frames"))


def next_version(owners: DataFrame, versions: DataFrame, owner: str, version: str) -> DataFrame:
    """(owner, next_version): one more than the largest version so far, 1 without any."""
    largest = versions.groupBy(owner).agg(F.max(version).alias("_v"))
    return owners.select(owner).distinct().join(largest, owner, "left").select(
        owner, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("next_version"))
