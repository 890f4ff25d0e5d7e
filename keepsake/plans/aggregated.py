"""Aggregation and set queries."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators import aggregates as A
from keepsake.operators.blocks import exact_percentiles, first_n, top_n
from keepsake.plans import mapping as M
from keepsake.plans.registry import TABLES, Tables, plan

WEEK = 7 * 86400.0


def week(column: str = "ts"):
    return F.floor(F.col(column) / WEEK)


@plan("count_items", f"WITH {M.ITEMS_DOCS_SQL} SELECT count(*) AS n FROM items "
                     "WHERE status = 'filed' AND domain = 'en' AND category_id = 1")
def count_items(t: Tables):
    return A.count_items(M.items_docs(t), "filed", "en", 1)


@plan("items_by_domain", "SELECT lang AS domain, count(*) AS n FROM documents GROUP BY lang")
def items_by_domain(t: Tables):
    return A.count_by(t.documents.select(F.col("lang").alias("domain")), "domain")


@plan("store_stats", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES)
      + " UNION ALL SELECT 'inbox', count(*) FROM orders WHERE o_orderstatus = 'O'")
def store_stats(t: Tables):
    return A.table_counts({**{n: getattr(t, n) for n in TABLES},
                           "inbox": t.orders.filter(F.col("o_orderstatus") == "O")})


@plan("stats_overview", """
  SELECT 'domain:' || lang AS name, count(*) AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'items', count(*) FROM documents
  UNION ALL SELECT 'pending_images', count(*) FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def stats_overview(t: Tables):
    docs = t.documents
    domains = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("domain:"), F.col("lang")).alias("name"), "n")
    pending = docs.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return domains.unionByName(A.table_counts({"items": docs, "pending_images": pending}))


@plan("usage_unitized", """
  SELECT count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS unitized,
         greatest(0, (SELECT count(*) FROM orders) - count(DISTINCT l_orderkey)
           FILTER (WHERE l_returnflag = 'R')) AS remaining FROM lineitem""")
def usage_unitized(t: Tables):
    return A.usage_unitized(M.items_orders(t).select("id"), M.chunks_lines(t).select("item_id", "modality"),
                            F.col("modality") == "R")


@plan("category_counts", f"""WITH {M.CATEGORIES_SQL}
  SELECT c.id, c.domain, c.name, (SELECT count(*) FROM customer WHERE c_nationkey = c.id) AS item_count
  FROM cats c""")
def category_counts(t: Tables):
    items = t.customer.select(F.col("c_nationkey").cast("long").alias("category_id"))
    return A.category_counts(M.categories(t).select("id", "domain", "name"), items).orderBy("domain", "id")


@plan("inbox_view", """
  WITH page AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
                ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
  SELECT 'item' AS kind, CAST(o_orderkey AS VARCHAR) AS name, NULL::BIGINT AS n FROM page
  UNION ALL SELECT 'total', 'inbox', count(*) FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'domain', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O'
            GROUP BY o_orderpriority""")
def inbox_view(t: Tables):
    inbox = M.items_orders(t).filter(F.col("status") == "inbox")
    page = first_n(inbox.select("id", "created_at"), [F.desc("created_at"), F.desc("id")], 20)
    row = lambda df, kind, name, n: df.select(
        F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    return A.union_all([
        row(page, "item", F.col("id").cast("string"), F.lit(None)),
        row(A.count_items(inbox), "total", F.lit("inbox"), F.col("n")),
        row(A.count_by(inbox, "domain"), "domain", F.col("domain"), F.col("n"))])


@plan("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(t: Tables):
    return A.count_by(t.orders.select(F.col("o_orderstatus").alias("status")), "status")


@plan("dup_titles", """
  SELECT doc_id AS id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents)
  WHERE copies > 1""")
def dup_titles(t: Tables):
    return A.duplicates(t.documents.select(F.col("doc_id").alias("id"), "text"), F.col("text")).select(
        "id", "copies")


@plan("integrity_report", """
  WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND coalesce(toxic, 0) <> 1) AS filed
             FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  logs AS (SELECT ts, max(ts) OVER () AS m, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events),
  g AS (SELECT count(*) AS n, count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) AS d7,
          count(*) FILTER (WHERE ts >= m - INTERVAL 45 DAY) AS d45,
          count(*) FILTER (WHERE ts >= m - INTERVAL 3650 DAY) AS a, count(*) FILTER (WHERE contains(s, 'T')) AS bad
        FROM logs),
  c AS (SELECT count(*) AS n FROM conversations), v AS (SELECT count(*) AS v FROM embeddings)
  SELECT 'items_size' AS check_name, n >= 15 AS ok, CAST(n AS VARCHAR) AS detail FROM n
  UNION ALL SELECT 'logs_size', n >= 30, CAST(n AS VARCHAR) FROM g
  UNION ALL SELECT 'vectors_match_chunks', n = v, CAST(n - v AS VARCHAR) FROM c, v
  UNION ALL SELECT 'all_chunks_embedded', count(*) = 0, CAST(count(*) AS VARCHAR) FROM conversations WHERE role = 'system'
  UNION ALL SELECT 'no_orphan_chunks', count(*) = 0, CAST(count(*) AS VARCHAR) FROM conversations
    WHERE conv_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'window_covers_all', a = n, CAST(n - a AS VARCHAR) FROM g
  UNION ALL SELECT 'window_is_subset', d7 > 0 AND d7 <= d45, CAST(d7 AS VARCHAR) FROM g
  UNION ALL SELECT 'time_format', bad = 0, CAST(bad AS VARCHAR) FROM g
  UNION ALL SELECT 'filed_items', true, CAST(filed AS VARCHAR) FROM n
  UNION ALL SELECT 'same_titles', true, CAST(coalesce(sum(k), 0)::BIGINT AS VARCHAR)
    FROM (SELECT count(*) AS k FROM documents GROUP BY substring(text, 1, 40) HAVING count(*) > 1)""")
def integrity_report(t: Tables):
    chunks = t.conversations.select(
        F.col("conv_id").alias("item_id"), F.lit("text").alias("modality"),
        F.when(F.col("role") == "system", "pending").otherwise("done").alias("embed_status"),
        F.col("text").alias("content"))
    logs = t.events.select(F.col("ts").cast("timestamp").alias("happened_at"),
                           S.ts_text("ts").alias("happened_text"))
    return A.integrity_report(
        M.items_docs(t).select("id", "title", "status"), chunks,
        t.embeddings.select(F.col("vec_id").alias("chunk_id")), logs,
        as_of=F.max("happened_at"), min_items=15, min_logs=30)


@plan("speech_ratio", f"""WITH {M.SPEECH_SQL}
  SELECT series_id, round(sum(greatest(0.0::DOUBLE, end_s - start_s)) / (max(end_s) - min(start_s)), 6) AS speech_ratio
  FROM speech GROUP BY series_id""")
def speech_ratio(t: Tables):
    sp = M.speech(t)
    durations = sp.groupBy("series_id").agg((F.max("end_s") - F.min("start_s")).alias("duration"))
    return A.speech_ratio(sp, durations, "series_id", "start_s", "end_s").select(
        "series_id", F.round("speech_ratio", 6).alias("speech_ratio"))


@plan("top_mean", f"""WITH {M.VECTORS_SQL}, q AS (SELECT e AS qe FROM vectors WHERE chunk_id = 0),
  s AS (SELECT item_id, list_dot_product(e, qe) AS sim,
          row_number() OVER (PARTITION BY item_id ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS r
        FROM vectors, q)
  SELECT item_id, round(avg(sim), 6) AS score FROM s WHERE r <= 3 GROUP BY item_id""")
def top_mean(t: Tables):
    v = M.vectors(t)
    q = F.broadcast(v.filter(F.col("chunk_id") == 0).select(F.col("embedding").alias("qe")))  # one row
    sims = v.join(q).select("item_id", "chunk_id", S.dot("embedding", "qe").alias("sim"))
    best = top_n(sims, ["item_id"], [F.desc("sim"), F.col("chunk_id")], 3)
    return best.groupBy("item_id").agg(F.round(F.avg("sim"), 6).alias("score"))


@plan("series_percentiles", """
  SELECT user_id AS series_id, round(quantile_cont(value, 0.2), 6) AS p20,
         round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY user_id""")
def series_percentiles(t: Tables):
    out = exact_percentiles(M.series(t).select("series_id", "value"), ["series_id"], "value",
                            {"p20": 0.2, "p50": 0.5})
    return out.select("series_id", F.round("p20", 6).alias("p20"), F.round("p50", 6).alias("p50"))


@plan("event_stats", """
  WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r,
               count(*) OVER (PARTITION BY user_id) AS n FROM events),
  d AS (SELECT user_id, count(*) AS n, epoch_us(max(ts)) / 1000000.0::DOUBLE - epoch_us(min(ts)) / 1000000.0::DOUBLE AS dur
        FROM events GROUP BY user_id)
  SELECT s.user_id AS series_id, d.n AS event_count, s.value AS event_median, round(d.n / nullif(d.dur, 0) * 86400, 6) AS per_day
  FROM s JOIN d ON d.user_id = s.user_id WHERE s.r = s.n // 2""")
def event_stats(t: Tables):
    sr = M.series(t).select("series_id", "ts", "value")
    med = A.upper_median(sr, ["series_id"], "value", "event_median")
    n = sr.groupBy("series_id").agg(F.count(F.lit(1)).alias("event_count"),
                                    (F.max("ts") - F.min("ts")).alias("dur"))
    return n.join(med, "series_id").select("series_id", "event_count", "event_median", F.round(
        F.try_divide(F.col("event_count"), F.col("dur")) * 86400, 6).alias("per_day"))


@plan("text_rate", """
  WITH l AS (SELECT l_suppkey AS series, l_orderkey AS frame, l_quantity / 50.0::DOUBLE AS y0,
               least(0.999::DOUBLE, l_quantity / 50.0::DOUBLE + l_discount) AS y1 FROM lineitem),
  c AS (SELECT series, band, count(DISTINCT frame) AS seen FROM (
          SELECT series, frame, unnest(range(greatest(0, CAST(floor(y0 * 24) AS BIGINT)),
            least(23, CAST(floor(y1 * 24) AS BIGINT)) + 1)) AS band FROM l) GROUP BY ALL),
  f AS (SELECT series, count(DISTINCT frame) AS n FROM l GROUP BY series)
  SELECT c.series, c.band, c.seen AS frames_seen, round(c.seen / n, 6) AS text_rate FROM c JOIN f ON f.series = c.series""")
def text_rate(t: Tables):
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("series"), F.col("l_orderkey").alias("frame"),
        (F.col("l_quantity") / 50.0).alias("y0"),
        F.least(F.lit(0.999), F.col("l_quantity") / 50.0 + F.col("l_discount")).alias("y1"))
    return A.text_rate(lines, lines, "series", "frame", "y0", "y1").select(
        "series", F.col("band").cast("long").alias("band"), "frames_seen",
        F.round("text_rate", 6).alias("text_rate"))


@plan("distinct_names", "SELECT DISTINCT p_brand AS name FROM part")
def distinct_names(t: Tables):
    return t.part.select(F.col("p_brand").alias("name")).distinct().orderBy("name")


@plan("max_version", "SELECT o_orderkey AS owner_id, coalesce(max(l_linenumber), 0)::BIGINT + 1 AS next_version "
                     "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY o_orderkey")
def max_version(t: Tables):
    versions = t.lineitem.filter(F.col("l_quantity") > 25).select(
        F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("version"))
    return A.next_version(t.orders.select(F.col("o_orderkey").alias("owner_id")), versions, "owner_id", "version")


# ---- sets -----------------------------------------------------------------

@plan("union_domains", """
  SELECT lang AS domain FROM documents UNION
  SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) FROM pages""")
def union_domains(t: Tables):
    pages = t.pages.select(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("domain"))
    return t.documents.select(F.col("lang").alias("domain")).union(pages).distinct().orderBy("domain")


@plan("bounds_distinct", """
  SELECT DISTINCT b FROM (SELECT l_quantity AS b FROM lineitem
    UNION ALL SELECT l_quantity + l_linenumber FROM lineitem)""")
def bounds_distinct(t: Tables):
    spans = M.chunks_lines(t).select("start_ts", "end_ts").distinct()
    return spans.select(F.explode(F.array("start_ts", "end_ts")).alias("b")).distinct()


@plan("dedupe_spans", """
  SELECT l_orderkey AS item_id, l_quantity AS start_ts, l_quantity + l_linenumber AS end_ts, min(l_partkey) AS first_ref
  FROM lineitem GROUP BY 1, 2, 3""")
def dedupe_spans(t: Tables):
    return M.chunks_lines(t).groupBy("item_id", "start_ts", "end_ts").agg(
        F.min("part_id").alias("first_ref"))


@plan("except_known", """
  SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'
  EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'""")
def except_known(t: Tables):
    old = t.lineitem.filter(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select(
        F.col("l_partkey").alias("key"))
    return t.lineitem.filter(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(
        F.col("l_partkey").alias("key")).join(old, "key", "left_anti").distinct()


@plan("except_known_whole", """
  SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'
  EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'""")
def except_known_whole(t: Tables):
    """``except_known`` with one boundary: every line is known or new."""
    known = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    return t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.bool_or(known).alias("known")).filter(
        "NOT known").select("key")


@plan("win_median_step", f"""WITH {M.SERIES_SQL}
  SELECT series_id, round(quantile_cont(d, 0.5), 3) AS step FROM (
    SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts, id) AS d FROM series)
  WHERE d IS NOT NULL GROUP BY series_id""")
def win_median_step(t: Tables):
    from keepsake.operators.series import median_step

    return median_step(M.series(t), "series_id", ["ts", "id"]).select(
        "series_id", F.round("step", 3).alias("step"))


