"""Streaming forms of the incremental operators. Every function maps a streaming (or batch)
DataFrame to another; ``run_once`` drives a query to the end of the available input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from keepsake.functions.text import contains_any
from keepsake.operators.blocks import row_index
from keepsake.operators.retrieval import embed
from keepsake.sources.capture import shape_captures


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into a parquet folder and read it back."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                mode: str = "append") -> None:
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()


def capture_dedup(captures: DataFrame, ts: str | None = None, delay: str = "7 days") -> DataFrame:
    """Valid captures, first of each dedup key.

    With an event-time column the state is bounded: a key is remembered for ``delay``. Without
    it every key is kept for ever, which is exact but grows with the number of keys.
    """
    shaped = shape_captures(captures).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    if ts is None:
        return shaped.dropDuplicates(["dedup_key"])
    return shaped.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["dedup_key"])


def ad_windows(comments: DataFrame, key: str, ts: str = "ts", text: str = "text", window: str = "10 seconds",
               min_hits: int = 2, delay: str = "1 minute") -> DataFrame:
    """Hot tumbling windows per stream; segments are merged in batch over the sink."""
    return (comments.filter(contains_any(text)).withWatermark(ts, delay)
            .groupBy(key, F.window(ts, window)).agg(F.count(F.lit(1)).alias("hits"))
            .filter(F.col("hits") >= min_hits)
            .select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hits"))


def rolling_timeline(logs: DataFrame, key: str = "domain", ts: str = "happened_at", window: str = "7 days",
                     slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per key in the last days, for every day."""
    return (logs.withWatermark(ts, delay).groupBy(key, F.window(ts, window, slide))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n"))


def sessions(logs: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "30 minutes") -> DataFrame:
    """Activity sessions split by a quiet time."""
    return (logs.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


_MERGED = "series_id long, start_s double, end_s double, text string"
_BUFFER = "start_s double, end_s double, text string, n_rows long"


def merge_segments(segments: DataFrame, max_chars: int = 240, max_seconds: float = 45.0,
                   arrival: str | None = None, delay: str = "1 minute", idle_ms: int = 60_000,
                   counted: bool = False) -> DataFrame:
    """Greedy merge of ``(series_id, start_s, end_s, text)`` in arrival order per series; rows without text are skipped.

    The state is one open buffer per series. With an event-time column ``arrival`` a buffer is
    flushed once the watermark is ``idle_ms`` past its last row; without, it waits for more
    rows (see ``open_buffers`` for the end of the input). Rows of one trigger are ordered by start and, where there is
    such a column, ``seq``; bound the trigger by ``maxBytesPerTrigger`` so that a busy series stays small. With
    ``counted`` each result tells in ``n_rows`` how many rows it holds.
    """
    names = ["series_id", "start_s", "end_s", "text", "n_rows"]
    order = ["start_s", "seq"] if "seq" in segments.columns else ["start_s"]
    segments = segments.filter(F.col("text").isNotNull())

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=names)
            return
        start, end, text, n = state.get if state.exists else (None, None, "", 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for r in rows.itertuples(index=False):
            start = r.start_s if start is None else start
            end, text, n = r.end_s, text + r.text, n + 1
            if len(text) >= max_chars or end - start >= max_seconds:
                out.append((key[0], start, end, text, n))
                start, end, text, n = None, None, "", 0
        if start is not None:
            state.update((start, end, text, n))
            if arrival is not None:
                last = max(int(rows[arrival].max().timestamp() * 1000), state.getCurrentWatermarkMs())
                state.setTimeoutTimestamp(last + idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    if arrival is not None:
        segments = segments.withWatermark(arrival, delay)
    timeout = GroupStateTimeout.NoTimeout if arrival is None else GroupStateTimeout.EventTimeTimeout
    out = segments.groupBy("series_id").applyInPandasWithState(
        advance, f"{_MERGED}, n_rows long", _BUFFER, "append", timeout)
    return out if counted else out.drop("n_rows")


def open_buffers(merged: DataFrame, segments: DataFrame, block: Column) -> DataFrame:
    """The last, still open buffer of each series once the input has ended: what a drained stream leaves behind.

    ``merged`` is the sink of ``merge_segments(..., counted=True)``, ``segments(series_id, start_s, end_s, seq, text)``
    its input as a table, ``block`` as in ``row_index``. A buffer that is not full holds few rows by its rule.
    """
    used = merged.groupBy("series_id").agg(F.sum("n_rows").alias("_used"))
    rows = row_index(segments.filter(F.col("text").isNotNull()), ["series_id"], ["start_s", "seq"], block, "_rn")
    rest = rows.join(used, "series_id", "left").filter(F.col("_rn") > F.coalesce("_used", F.lit(0)))
    held = rest.groupBy("series_id").agg(F.sort_array(F.collect_list(
        F.struct("_rn", "start_s", "end_s", "text"))).alias("_held"))
    return held.select("series_id", F.col("_held")[0]["start_s"].alias("start_s"),
                       F.element_at("_held", -1)["end_s"].alias("end_s"),
                       F.array_join(F.transform("_held", lambda r: r["text"]), "").alias("text"),
                       F.size("_held").cast("long").alias("n_rows"))


def _registry(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The registry's rows with their files; none before the first batch."""
    known = spark.read.option("recursiveFileLookup", "true").schema(schema)
    try:
        return known.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("_file", F.lit(""))


def incremental_ingest(known_path: str, new_path: str, key: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: keys not yet in the registry are written and registered.

    Both folders get one sub-folder per batch id, overwritten on a retry, so a batch that is
    replayed after a failure leaves the same result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _registry(spark, known_path, batch.select(key).schema)
        earlier = known.filter(
            ~F.contains("_file", F.lit(f"/batch={batch_id}/"))).select(key)
        new = batch.dropDuplicates([key]).join(earlier, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{new_path}/batch={batch_id}")
        written = spark.read.schema(new.schema).parquet(f"{new_path}/batch={batch_id}")
        written.select(key).write.mode("overwrite").parquet(f"{known_path}/batch={batch_id}")

    return write


def embed_append(chunks: DataFrame, make_encoder, text: str = "content") -> DataFrame:
    """Stateless embedding of arriving chunks."""
    return embed(chunks, text, make_encoder).withColumn("embed_status", F.lit("done"))
