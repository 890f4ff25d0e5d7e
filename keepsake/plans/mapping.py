"""How the test tables stand in for the model tables: a DataFrame and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.scalars import seconds
from keepsake.plans.registry import Tables

MEDIA_ROOT = "/vault/media"

ITEMS_DOCS_SQL = """items AS (
  SELECT d.doc_id AS id, d.lang AS domain, d.source AS type, substring(d.text, 1, 40) AS title,
         d.text AS content_text, l.quality::BIGINT AS category_id,
         CASE WHEN l.toxic = 1 THEN 'archived' WHEN l.quality = 1 THEN 'filed' ELSE 'inbox' END AS status,
         CASE WHEN d.n_chars > 1000 THEN '["/vault/media/' || d.source || '/' || d.doc_id || '.jpg"]'
              ELSE '[]' END AS media_paths,
         'file' AS source_type, d.source || '/' || d.doc_id AS source_ref
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def items_docs(t: Tables) -> DataFrame:
    d, l = t.documents, t.labels
    ref = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.col("source").alias("type"),
        F.substring("text", 1, 40).alias("title"), F.col("text").alias("content_text"),
        F.col("quality").cast("long").alias("category_id"),
        F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 1, "filed")
        .otherwise("inbox").alias("status"),
        F.when(F.col("n_chars") > 1000, F.concat(
            F.lit(f'["{MEDIA_ROOT}/'), ref, F.lit('.jpg"]'))).otherwise("[]").alias("media_paths"),
        F.lit("file").alias("source_type"), ref.alias("source_ref"))


CATEGORIES_LABEL_SQL = """cats AS (
  SELECT * FROM (VALUES (0::BIGINT, 'low'), (1::BIGINT, 'high')) c(id, name))"""

ITEMS_ORDERS_SQL = """items AS (
  SELECT o_orderkey AS id, o_orderpriority AS domain, 'order' AS type,
         'order ' || o_orderkey AS title,
         CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'O' THEN 'inbox' ELSE 'archived' END AS status,
         o_custkey AS owner_id, o_totalprice AS price, o_orderdate AS created_at
  FROM orders)"""


def items_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"),
        F.lit("order").alias("type"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "filed").when(F.col("o_orderstatus") == "O", "inbox")
        .otherwise("archived").alias("status"),
        F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


CHUNKS_LINES_SQL = """chunks AS (
  SELECT l_orderkey AS item_id, l_linenumber::BIGINT AS seq, l_partkey AS part_id, l_suppkey AS supp_id,
         l_returnflag AS modality, l_quantity AS start_ts, l_quantity + l_linenumber AS end_ts,
         l_extendedprice AS price
  FROM lineitem)"""


def chunks_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"),
        F.col("l_returnflag").alias("modality"), F.col("l_quantity").alias("start_ts"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("end_ts"),
        F.col("l_extendedprice").alias("price"))


LOGS_SQL = """logs AS (
  SELECT event_id AS id, event_type AS domain, ts AS happened_at,
         event_type || ' ' || CAST(value AS VARCHAR) AS content_text, props AS attrs_json,
         user_id AS owner_id, value
  FROM events)"""


def logs(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("domain"),
        F.col("ts").cast("timestamp").alias("happened_at"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("string")).alias("content_text"),
        F.col("props").alias("attrs_json"), F.col("user_id").alias("owner_id"), F.col("value"))


SERIES_SQL = """series AS (
  SELECT user_id AS series_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_id AS id, value, event_type
  FROM events)"""


def series(t: Tables) -> DataFrame:
    """Events as one time series per user, time in seconds."""
    return t.events.select(F.col("user_id").alias("series_id"), seconds("ts").alias("ts"),
                           F.col("event_id").alias("id"), "value", "event_type")


SPEECH_SQL = """speech AS (
  SELECT conv_id AS series_id, turn AS seq, turn * 10.0::DOUBLE AS start_s,
         turn * 10.0::DOUBLE + least(9.5::DOUBLE, length(text) / 50.0::DOUBLE) AS end_s, text, role
  FROM conversations)"""


def speech(t: Tables) -> DataFrame:
    start = F.col("turn") * F.lit(10.0)
    return t.conversations.select(
        F.col("conv_id").alias("series_id"), F.col("turn").alias("seq"), start.alias("start_s"),
        (start + F.least(F.lit(9.5), F.length("text") / F.lit(50.0))).alias("end_s"), "text", "role")


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS chunk_id, vec_id // 10 AS item_id, 'd' || label AS domain, embedding::DOUBLE[] AS e
  FROM embeddings)"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("item_id"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), "embedding")


CATEGORIES_SQL = """cats AS (
  SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS parent_id, r_name AS domain, n_name AS name,
         CASE n_nationkey % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'proposed' ELSE 'active' END AS status
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def categories(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 5
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"),
        F.col("r_name").alias("domain"), F.col("n_name").alias("name"),
        F.when(k == 0, "archived").when(k == 1, "proposed").otherwise("active").alias("status"))


BINDINGS_SQL = """rules AS (
  SELECT c_custkey AS id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'up' WHEN 'AUTOMOBILE' THEN 'up_set'
              WHEN 'MACHINERY' THEN 'domain' WHEN 'HOUSEHOLD' THEN 'source_type' ELSE 'keyword' END AS kind,
         c_name AS target, 'extract' AS stage, 'profile_' || c_nationkey AS prompt_name,
         c_nationkey::BIGINT AS priority, (c_acctbal > 0)::INT::BIGINT AS enabled
  FROM customer)"""


def bindings(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(seg == "BUILDING", "up").when(seg == "AUTOMOBILE", "up_set")
        .when(seg == "MACHINERY", "domain").when(seg == "HOUSEHOLD", "source_type")
        .otherwise("keyword").alias("kind"),
        F.col("c_name").alias("target"), F.lit("extract").alias("stage"),
        F.concat(F.lit("profile_"), F.col("c_nationkey").cast("string")).alias("prompt_name"),
        F.col("c_nationkey").cast("long").alias("priority"),
        (F.col("c_acctbal") > 0).cast("long").alias("enabled"))
