"""Streaming queries: the test tables as file streams, run to the end of the input.

In append mode a window is emitted once the watermark passes it, so windows that end after
the last event minus the delay are still open and not part of the result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators.retrieval import HashEncoder
from keepsake.plans import mapping as M
from keepsake.plans.ingest import CAPTURES_SQL, STRIP, captures
from keepsake.plans.registry import TABLES, Tables, plan
from keepsake.session import scratch_folder
from keepsake.streaming import flows

STAMP = "%Y-%m-%d %H:%M:%S"


class StreamTables(Tables):
    """The same tables read as file streams, be a table one file or a folder of files."""

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # as a pattern: a stream takes a plain path for a folder only
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{{{name}}}.parquet")


def finish(t: Tables, stream: DataFrame) -> DataFrame:
    folder = scratch_folder(t.spark)
    return flows.run_once(stream, f"{folder}/out", f"{folder}/state")


def streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@plan("stream_capture_dedup", f"""WITH {CAPTURES_SQL}, s AS (SELECT *, {STRIP.format("text")} AS clean FROM cap)
  SELECT DISTINCT CASE type WHEN 'video' THEN substring(sha1('video|' || url), 1, 16)
    WHEN 'product' THEN substring(sha1('product|' || url || '|' || pname), 1, 16)
    ELSE substring(sha1(type || '|' || url || '|' || substring(clean, 1, 200)), 1, 16) END AS dedup_key FROM s
  WHERE type <> 'other' AND (type NOT IN ('selection', 'page') OR clean <> '')
    AND (type <> 'product' OR pname <> '' OR title <> '')""")
def stream_capture_dedup(t: Tables):
    return finish(t, flows.capture_dedup(captures(streams(t))).select("dedup_key"))


@plan("stream_ad_windows", f"""
  WITH w AS (SELECT event_type AS stream, date_trunc('hour', ts) AS s, count(*) AS hits FROM events WHERE value > 20 GROUP BY 1, 2)
  SELECT stream, strftime(s, '{STAMP}') AS start, hits FROM w
  WHERE hits >= 2 AND s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE value > 20) - INTERVAL 1 MINUTE""")
def stream_ad_windows(t: Tables):
    comments = streams(t).events.select(
        F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat("event_type", F.when(F.col("value") > 20, "恰饭").otherwise("")).alias("text"))
    out = finish(t, flows.ad_windows(comments, "stream", window="1 hour"))
    return out.select("stream", S.ts_text("start").alias("start"), "hits")


@plan("stream_timeline", f"""
  WITH d AS (SELECT event_type AS domain, ts, unnest(range(7)) AS k FROM events),
  w AS (SELECT domain, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s, count(*) AS n FROM d GROUP BY 1, 2)
  SELECT domain, strftime(s, '{STAMP}') AS start, n FROM w
  WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_timeline(t: Tables):
    out = finish(t, flows.rolling_timeline(M.logs(streams(t)).select("domain", "happened_at")))
    return out.select("domain", S.ts_text("start").alias("start"), "n")


@plan("stream_sessions", f"""
  WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE
      THEN 0 ELSE 1 END AS new FROM events),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a),
  s AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM b GROUP BY user_id, g)
  SELECT user_id, strftime(s, '{STAMP}') AS start, n FROM s WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def stream_sessions(t: Tables):
    logs = streams(t).events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = finish(t, flows.sessions(logs, "user_id", "ts"))
    return out.select("user_id", S.ts_text("start").alias("start"), "n")


@plan("stream_merge_segments", f"""WITH RECURSIVE {M.SPEECH_SQL},
  o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_s, seq) AS rn FROM speech),
  w AS (SELECT series_id, rn, start_s, end_s, text, length(text) >= 240 OR end_s - start_s >= 45 AS done FROM o WHERE rn = 1
    UNION ALL
    SELECT o.series_id, o.rn, CASE WHEN w.done THEN o.start_s ELSE w.start_s END, o.end_s,
      CASE WHEN w.done THEN o.text ELSE w.text || o.text END,
      length(CASE WHEN w.done THEN o.text ELSE w.text || o.text END) >= 240
        OR o.end_s - CASE WHEN w.done THEN o.start_s ELSE w.start_s END >= 45
    FROM w JOIN o ON o.series_id = w.series_id AND o.rn = w.rn + 1)
  SELECT series_id, start_s, end_s, text FROM w WHERE done OR rn = (SELECT max(rn) FROM o WHERE o.series_id = w.series_id)""")
def stream_merge_segments(t: Tables):
    columns = ["series_id", "start_s", "end_s", "seq", "text"]
    merged = finish(t, flows.merge_segments(M.speech(streams(t)).select(*columns), counted=True))
    left = flows.open_buffers(merged, M.speech(t).select(*columns), F.floor(F.col("start_s") / 3600.0))
    return merged.unionByName(left).drop("n_rows")


@plan("stream_incremental_ingest", """
  SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')""")
def stream_incremental_ingest(t: Tables):
    folder = scratch_folder(t.spark)
    known = t.orders.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("key")).distinct()
    known.write.parquet(f"{folder}/known/seed")
    listing = streams(t).orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("key"))
    flows.run_batches(listing, flows.incremental_ingest(f"{folder}/known", f"{folder}/new", "key"), f"{folder}/state")
    return t.spark.read.schema("key long").option("recursiveFileLookup", "true").parquet(f"{folder}/new")


@plan("stream_embed_append", "SELECT conv_id, turn, 64::BIGINT AS dim, 'done' AS embed_status FROM conversations")
def stream_embed_append(t: Tables):
    chunks = streams(t).conversations.select("conv_id", "turn", F.col("text").alias("content"))
    out = finish(t, flows.embed_append(chunks, HashEncoder))
    return out.select("conv_id", "turn", F.size("embedding").cast("long").alias("dim"), "embed_status")
