"""Filters, point lookups and row views over the model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.functions import text as X
from keepsake.operators.blocks import top_n


def rows_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (one column of the same name)."""
    return df.join(ids.select(key), key, "left_semi")


def item_with_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every item with its chunks, one row per chunk; items without chunks keep one row.

    Kept flat on purpose: a nested list would put all chunks of one item into one cell.
    """
    return items.join(chunks, items["id"] == chunks["item_id"], "left").drop(chunks["item_id"])


def timeline(logs: DataFrame, days: int, as_of: Column | str, domain: str | None = None) -> DataFrame:
    """Log rows of the last ``days`` days before ``as_of``, newest first."""
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    out = logs.filter(F.col("happened_at") >= at - F.expr(f"interval {int(days)} days"))
    if domain is not None:
        out = out.filter(F.col("domain") == domain)
    return out.orderBy(F.desc("happened_at"), F.desc("id"))


def with_child_count(items: DataFrame, chunks: DataFrame, name: str = "chunk_count") -> DataFrame:
    """Children are counted before the join, so only one row per item is shuffled."""
    counts = chunks.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    return (items.join(counts, items["id"] == counts["item_id"], "left").drop("item_id")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long"))))


def list_items(items: DataFrame, chunks: DataFrame, status: str | None = None,
               domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of items, newest first, with chunk counts.

    The page is cut first; chunks are then counted for the page's items only.
    """
    if status is not None:
        items = items.filter(F.col("status") == status)
    if domain is not None:
        items = items.filter(F.col("domain") == domain)
    page = items.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    wanted = F.broadcast(page.select(F.col("id").alias("item_id")))     # at most ``limit`` rows
    return with_child_count(page, chunks.join(wanted, "item_id", "left_semi"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def enabled_only(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.filter(F.col("enabled") == 1).orderBy(*order)


def jobs_view(jobs: DataFrame) -> DataFrame:
    """Tasks with a readable duration and payload summary."""
    return jobs.withColumns({
        "duration": S.duration_label("started_at", "finished_at"),
        "payload_pretty": X.payload_summary("payload")})


def item_brief(items: DataFrame, categories: DataFrame, media_root: str) -> DataFrame:
    """Card of an item: 150-character snippet, thumbnail, category name."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return items.join(names, "category_id", "left").select(
        "id", "title", "domain", "type", "status", "category_id", "category_name",
        F.substring(F.coalesce("content_text", F.lit("")), 1, 150).alias("snippet"),
        X.media_url(S.first_media("media_paths"), media_root).alias("thumb"),
        "source_type", "source_ref")


def chunk_detail(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks of each item with time label and jump link."""
    refs = items.select(F.col("id").alias("item_id"), "source_ref")
    return chunks.join(refs, "item_id").withColumns({
        "timestamp_label": F.when(F.col("start_ts").isNotNull(), S.fmt_ts("start_ts")),
        "jump": X.jump_link("source_ref", "start_ts")})


def guard(df: DataFrame, column: str, allowed: list[str], reason: str = "reject_reason") -> DataFrame:
    """Mark rows whose enum value is unknown or missing; valid rows get a null reason."""
    return df.withColumn(
        reason, F.when(F.col(column).isNull(), F.concat(F.lit(column), F.lit(" missing")))
        .when(~F.col(column).isin(*allowed),
              F.concat(F.lit(f"{column} not allowed: "), F.col(column))))


def exists_key(keys: DataFrame, registered: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Whether each key is registered."""
    known = registered.select(key).distinct().withColumn("_k", F.lit(True))
    return keys.join(known, key, "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def recent_jobs(jobs: DataFrame, order: list[Column], limit: int, status: str | None = None) -> DataFrame:
    """The newest tasks, of one status if asked for."""
    return (jobs if status is None else jobs.filter(F.col("status") == status)).orderBy(*order).limit(limit)


def first_named(items: DataFrame, key: str, name: str, order: list[Column], newest: int = 5) -> DataFrame:
    """(key, name): the first name among the newest items of each key; keys without a name are left out."""
    few = top_n(items, [key], order, newest, "_r").filter(F.col(name).isNotNull())
    return few.groupBy(key).agg(F.min_by(name, "_r").alias(name))
