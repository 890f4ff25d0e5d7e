"""Scans, filters, point lookups and row views."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.functions import text as X
from keepsake.operators import lookup as L
from keepsake.operators.blocks import first_n
from keepsake.plans import mapping as M
from keepsake.plans.registry import TABLES, Tables, plan

STAMP = "%Y-%m-%d %H:%M:%S"


@plan("src_tables", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES))
def src_tables(t: Tables):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n).alias("table_name"), "n_rows") for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("get_chunks", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def get_chunks(t: Tables):
    ids = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return L.rows_by_ids(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ids, "l_orderkey")


@plan("get_items", f"""WITH {M.ITEMS_DOCS_SQL}
  SELECT id, domain, type, title, status FROM items WHERE id IN (SELECT doc_id FROM labels)""")
def get_items(t: Tables):
    return L.rows_by_ids(M.items_docs(t).select("id", "domain", "type", "title", "status"),
                         t.labels.select(F.col("doc_id").alias("id")), "id")


@plan("item_with_chunks", f"""WITH {M.ITEMS_ORDERS_SQL}, {M.CHUNKS_LINES_SQL}
  SELECT i.id, i.domain, i.status, c.seq, c.part_id, c.supp_id, c.start_ts
  FROM items i LEFT JOIN chunks c ON c.item_id = i.id""")
def item_with_chunks(t: Tables):
    return L.item_with_chunks(
        M.items_orders(t).select("id", "domain", "status"),
        M.chunks_lines(t).select("item_id", "seq", "part_id", "supp_id", "start_ts"))


@plan("timeline", f"""WITH {M.LOGS_SQL}
  SELECT id, domain, strftime(happened_at, '{STAMP}') AS happened_at, content_text FROM logs
  WHERE happened_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND domain = 'purchase'""")
def timeline(t: Tables):
    logs = M.logs(t)
    latest = logs.agg(F.max("happened_at").alias("as_of"))
    out = L.timeline(logs.crossJoin(F.broadcast(latest)), 7, F.col("as_of"), "purchase")  # one row
    return out.select("id", "domain", S.ts_text("happened_at").alias("happened_at"), "content_text")


@plan("list_items", f"""WITH {M.ITEMS_ORDERS_SQL}, page AS (
    SELECT * FROM items WHERE status = 'filed' AND domain = '2-HIGH'
    ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50)
  SELECT id, title, strftime(created_at, '{STAMP}') AS created_at,
         (SELECT count(*) FROM lineitem WHERE l_orderkey = page.id) AS chunk_count FROM page""")
def list_items(t: Tables):
    out = L.list_items(M.items_orders(t), M.chunks_lines(t).select("item_id"), "filed", "2-HIGH", 50, 50)
    return out.select("id", "title", S.ts_text("created_at").alias("created_at"), "chunk_count")


@plan("profile_read", """
  SELECT user_id, event_type AS key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
    FROM events) WHERE r = 1""")
def profile_read(t: Tables):
    latest = L.latest_per_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"),
                              ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return latest.select("user_id", F.col("event_type").alias("key"), "value").orderBy("user_id", "key")


@plan("list_categories", f"""WITH {M.CATEGORIES_SQL}
  SELECT id, domain, name, status FROM cats WHERE domain = 'ASIA'""")
def list_categories(t: Tables):
    return (M.categories(t).filter(F.col("domain") == "ASIA")
            .select("id", "domain", "name", "status").orderBy("id"))


@plan("list_sources", """
  SELECT s_suppkey AS id, s_name AS label, s_nationkey::BIGINT AS domain, 1::BIGINT AS enabled
  FROM supplier WHERE s_acctbal > 0""")
def list_sources(t: Tables):
    src = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"),
                            F.col("s_nationkey").cast("long").alias("domain"),
                            (F.col("s_acctbal") > 0).cast("long").alias("enabled"))
    return L.enabled_only(src, [F.col("id")])


@plan("list_bindings", f"""WITH {M.BINDINGS_SQL}
  SELECT id, kind, target, prompt_name, priority FROM rules WHERE enabled = 1 AND stage = 'extract'""")
def list_bindings(t: Tables):
    rules = M.bindings(t).filter(F.col("stage") == "extract")
    return L.enabled_only(rules, [F.desc("priority"), F.col("id")]).select(
        "id", "kind", "target", "prompt_name", "priority")


@plan("list_clips", f"""WITH {M.CHUNKS_LINES_SQL}
  SELECT item_id, start_ts, end_ts, modality AS kind FROM chunks
  WHERE item_id = (SELECT max(l_orderkey) FROM lineitem)""")
def list_clips(t: Tables):
    clips = M.chunks_lines(t).select("item_id", "start_ts", "end_ts", F.col("modality").alias("kind"))
    newest = F.broadcast(clips.agg(F.max("item_id").alias("item_id")))      # one row
    return clips.join(newest, "item_id", "left_semi").orderBy("start_ts", "end_ts")


@plan("list_jobs_view", """
  SELECT o_orderkey AS id, o_orderstatus AS status, l_linenumber::BIGINT AS part,
         CASE WHEN date_diff('second', o_orderdate, l_shipdate) < 120
              THEN date_diff('second', o_orderdate, l_shipdate) || ' 秒'
              ELSE CAST(CAST(round_even(date_diff('second', o_orderdate, l_shipdate) / 60.0, 1)
                   AS DECIMAL(20, 1)) AS VARCHAR) || ' 分钟' END AS duration,
         'part=' || l_partkey || ' · supplier=' || l_suppkey AS payload_pretty
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
  ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber LIMIT 100""")
def list_jobs_view(t: Tables):
    jobs = t.orders.join(
        t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("l_linenumber").cast("long").alias("part"),
        F.col("o_orderdate").alias("started_at"), F.col("l_shipdate").alias("finished_at"),
        F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")))
        .alias("payload"))
    newest = L.recent_jobs(jobs, [F.desc("started_at"), F.desc("id"), F.col("part")], 100, "F")
    return L.jobs_view(newest).select("id", "status", "part", "duration", "payload_pretty")


@plan("pending_images", """
  SELECT doc_id AS id, source || '/' || doc_id AS media_path FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND n_chars > 1000""")
def pending_images(t: Tables):
    return (t.documents.filter(F.col("n_chars") > 1000).select("doc_id", "source")
            .join(t.labels.select("doc_id"), "doc_id", "left_anti")
            .select(F.col("doc_id").alias("id"),
                    F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("media_path"))
            .orderBy("id"))


@plan("item_brief", f"""WITH {M.ITEMS_DOCS_SQL}, {M.CATEGORIES_LABEL_SQL}
  SELECT i.id, i.title, i.domain, i.type, i.status, i.category_id, c.name AS category_name,
         substring(i.content_text, 1, 150) AS snippet,
         CASE WHEN i.media_paths <> '[]' THEN '/media/' || i.source_ref || '.jpg' END AS thumb,
         i.source_type, i.source_ref
  FROM items i LEFT JOIN cats c ON c.id = i.category_id""")
def item_brief(t: Tables):
    cats = t.labels.select(F.col("quality").cast("long").alias("id")).distinct().withColumn(
        "name", F.when(F.col("id") == 1, "high").otherwise("low"))
    return L.item_brief(M.items_docs(t), cats, M.MEDIA_ROOT)


@plan("item_detail", """
  SELECT o_orderkey AS item_id, l_linenumber::BIGINT AS seq, l_partkey AS part_id,
         printf('%02d:%02d', CAST(floor(l_extendedprice) AS BIGINT) // 60,
                CAST(floor(l_extendedprice) AS BIGINT) % 60) AS timestamp_label,
         'https://www.bilibili.com/video/' || 'BV' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0')
           || '?t=' || CAST(floor(l_extendedprice) AS BIGINT) AS jump
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def item_detail(t: Tables):
    items = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(
        F.lit("https://www.bilibili.com/video/BV"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("/")).alias("source_ref"))
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_partkey").alias("part_id"), F.col("l_extendedprice").alias("start_ts"))
    return L.chunk_detail(chunks, items).select("item_id", "seq", "part_id", "timestamp_label", "jump")


@plan("meta_filter", f"""WITH {M.VECTORS_SQL}
  SELECT chunk_id, item_id, domain FROM vectors WHERE domain = 'd3' AND item_id <> 0""")
def meta_filter(t: Tables):
    return M.vectors(t).filter((F.col("domain") == "d3") & (F.col("item_id") != 0)).select(
        "chunk_id", "item_id", "domain")


@plan("status_guard", """
  SELECT o_orderkey AS id, o_orderstatus AS status,
         CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status not allowed: ' || o_orderstatus END
           AS reject_reason FROM orders""")
def status_guard(t: Tables):
    return L.guard(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
                   "status", ["F", "O"])


@plan("point_lookup", """
  SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey = 7""")
def point_lookup(t: Tables):
    return t.nation.filter(F.col("n_nationkey") == 7).select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


@plan("exists_key", """
  SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderpriority = '1-URGENT') AS found FROM customer""")
def exists_key(t: Tables):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("key"))
    return L.exists_key(t.customer.select(F.col("c_custkey").alias("key")), urgent, "key")


@plan("image_hit_view", f"""WITH {M.VECTORS_SQL},
  q AS (SELECT e AS qe FROM vectors WHERE chunk_id = 0)
  SELECT round(list_dot_product(e, qe), 4) AS score, chunk_id, item_id,
         '/media/item_' || item_id || '/' || chunk_id || '.jpg' AS media_url
  FROM vectors, q WHERE chunk_id <> 0 ORDER BY list_dot_product(e, qe) DESC, chunk_id LIMIT 10""")
def image_hit_view(t: Tables):
    v = M.vectors(t)
    q = F.broadcast(v.filter(F.col("chunk_id") == 0).select(F.col("embedding").alias("qe")))  # one row
    hits = first_n(v.filter(F.col("chunk_id") != 0).join(q).withColumn("sim", S.dot("embedding", "qe")),
                   [F.desc("sim"), F.col("chunk_id")], 10)
    path = F.concat(F.lit(f"{M.MEDIA_ROOT}/item_"), F.col("item_id").cast("string"), F.lit("/"),
                    F.col("chunk_id").cast("string"), F.lit(".jpg"))
    return hits.select(F.round("sim", 4).alias("score"), "chunk_id", "item_id",
                       X.media_url(path, M.MEDIA_ROOT).alias("media_url"))


@plan("profile_cache_list", """
  SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def profile_cache_list(t: Tables):
    return t.events.select(F.col("event_id").alias("id"),
                           F.try_element_at(S.json_safe("props"), F.lit("k")).try_cast("long").alias("k"))


@plan("next_task", f"""
  SELECT o_orderkey AS id, o_orderpriority AS priority, strftime(o_orderdate, '{STAMP}') AS created_at
  FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1""")
def next_task(t: Tables):
    return first_n(t.orders.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"),
        S.ts_text("o_orderdate").alias("created_at")),
        [F.col("priority"), F.col("created_at"), F.col("id")], 1)


@plan("page_slice", f"""
  SELECT o_orderkey AS id, strftime(o_orderdate, '{STAMP}') AS created_at FROM orders
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 200""")
def page_slice(t: Tables):
    page, size = max(1, 3), min(100, max(1, 9999))
    return (t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
            .offset((page - 1) * size).limit(size)
            .select(F.col("o_orderkey").alias("id"), S.ts_text("o_orderdate").alias("created_at")))


@plan("keyword_topk", """
  SELECT doc_id AS chunk_id FROM documents WHERE contains(lower(text), 'the')
  ORDER BY doc_id LIMIT 20""")
def keyword_topk(t: Tables):
    hits = t.documents.filter(F.contains(F.lower("text"), F.lit("the")))
    return first_n(hits.select(F.col("doc_id").alias("chunk_id")), [F.col("chunk_id")], 20)


@plan("win_latest_active", """
  SELECT c AS owner_id, id, price FROM (
    SELECT o_custkey AS c, o_orderkey AS id, o_totalprice AS price,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
    FROM orders WHERE o_orderstatus = 'F') WHERE r = 1""")
def win_latest_active(t: Tables):
    active = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("id"), "o_orderdate",
        F.col("o_totalprice").alias("price"))
    return L.latest_per_key(active, ["owner_id"], [F.desc("o_orderdate"), F.desc("id")]).select(
        "owner_id", "id", "price")


@plan("win_keep_min_rowid", """
  SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text""")
def win_keep_min_rowid(t: Tables):
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("id"),
                                    F.count(F.lit(1)).alias("copies")).drop("key")


