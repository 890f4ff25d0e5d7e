"""Table-change queries: each returns the table after the change."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators import mutate as U
from keepsake.plans import mapping as M
from keepsake.plans.registry import Tables, plan


def _cut(day: str):
    return F.lit(day).cast("timestamp_ntz")


@plan("upsert_profile", """
  SELECT user_id AS domain, event_type AS key, arg_max(value, (ts, event_id)) AS value,
    max(ts) >= TIMESTAMP '2024-01-16' AS updated FROM events GROUP BY 1, 2""")
def upsert_profile(t: Tables):
    e = t.events.select(F.col("user_id").alias("domain"), F.col("event_type").alias("key"), "value", "ts", "event_id")
    keys, order = ["domain", "key"], [F.desc("ts"), F.desc("event_id")]
    none = e.filter(F.lit(False)).withColumn("updated", F.lit(False))
    old = U.upsert_latest(none, e.filter(F.col("ts") < _cut("2024-01-16")).withColumn("updated", F.lit(False)), keys, order)
    new = e.filter(F.col("ts") >= _cut("2024-01-16")).withColumn("updated", F.lit(True))
    return U.upsert_latest(old, new, keys, order).drop("ts", "event_id")


@plan("upsert_binding", """
  SELECT c_custkey::BIGINT AS target, CASE WHEN c_custkey % 3 = 0 THEN 'cached' ELSE 'profile_' || c_nationkey END AS prompt_name,
    CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE c_nationkey END::BIGINT AS priority,
    (c_custkey % 3 = 0 OR c_acctbal > 0) AS enabled, CASE WHEN c_acctbal > 5000 THEN 'kept' END AS payload FROM customer
  UNION ALL SELECT -1 - s_suppkey, 'cached', 9, true, NULL FROM supplier""")
def upsert_binding(t: Tables):
    old = t.customer.select(
        F.col("c_custkey").alias("target"), F.concat(F.lit("profile_"), F.col("c_nationkey").cast("string")).alias("prompt_name"),
        F.col("c_nationkey").cast("long").alias("priority"), (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(F.col("c_acctbal") > 5000, "kept").alias("payload"))
    keys = t.customer.filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("target")).unionByName(
        t.supplier.select((-1 - F.col("s_suppkey")).alias("target")))
    new = keys.select("target", F.lit("cached").alias("prompt_name"), F.lit(9).cast("long").alias("priority"))
    return U.upsert_merge(old, new, ["target"], {"enabled": F.lit(True)})


@plan("upsert_owner_rule", """
  SELECT c_custkey::BIGINT AS owner_id, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS owner_name,
    CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE c_nationkey END::BIGINT AS category_id FROM customer""")
def upsert_owner_rule(t: Tables):
    old = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"),
                            F.col("c_nationkey").cast("long").alias("category_id"))
    new = old.filter(F.col("owner_id") % 4 == 0).select(
        "owner_id", F.lit("renamed").alias("owner_name"), F.lit(3).cast("long").alias("category_id"))
    return U.upsert_merge(old, new, ["owner_id"])


@plan("unbind", f"""WITH {M.BINDINGS_SQL}
  SELECT id, kind, target FROM rules WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def unbind(t: Tables):
    gone = t.orders.filter(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").alias("id"))
    return U.delete_keys(M.bindings(t).select("id", "kind", "target"), gone, ["id"])


_ITEMS = ["id", "domain", "status"]


@plan("bulk_set_status", f"""WITH {M.ITEMS_ORDERS_SQL}
  SELECT id, CASE WHEN status = 'inbox' AND domain = '2-HIGH' THEN 'archived' ELSE status END AS status FROM items""")
def bulk_set_status(t: Tables):
    return U.bulk_set_status(M.items_orders(t).select(*_ITEMS), "inbox", "archived", "2-HIGH").select("id", "status")


@plan("set_status", f"""WITH {M.ITEMS_ORDERS_SQL}
  SELECT id, CASE WHEN id = 42 THEN 'archived' ELSE status END AS status FROM items""")
def set_status(t: Tables):
    return U.set_where(M.items_orders(t).select("id", "status"), "status", "archived", F.col("id") == 42)


@plan("inbox_batch", f"""WITH {M.ITEMS_ORDERS_SQL}
  SELECT id, CASE WHEN status = 'inbox' AND domain = '1-URGENT' THEN 'filed' ELSE status END AS status,
    CASE WHEN status = 'inbox' AND domain = '1-URGENT' THEN 7 ELSE owner_id END::BIGINT AS category_id,
    CASE WHEN status = 'inbox' AND domain = '1-URGENT' THEN '手动归入:NATION_7' END AS auto_note FROM items""")
def inbox_batch(t: Tables):
    items = M.items_orders(t).select(*_ITEMS, F.col("owner_id").alias("category_id"),
                                     F.lit(None).cast("string").alias("auto_note"))
    return U.inbox_batch(items, "assign", domain="1-URGENT", category_id=7, note="手动归入:NATION_7").drop("domain")


def _assignable(t: Tables):
    return M.items_orders(t).select(
        "id", "status", F.col("owner_id").alias("category_id"), F.lit(None).cast("double").alias("category_conf"),
        F.lit(None).cast("string").alias("auto_note"))


@plan("assign_category", f"""WITH {M.ITEMS_ORDERS_SQL}, a AS (SELECT l_orderkey AS id, min(l_suppkey) AS c FROM lineitem
    WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT i.id, CASE WHEN a.id IS NULL THEN i.status ELSE 'filed' END AS status,
    CASE WHEN a.id IS NULL THEN owner_id ELSE a.c END AS category_id,
    CASE WHEN a.id IS NOT NULL THEN 1.0::DOUBLE END AS category_conf, CASE WHEN a.id IS NOT NULL THEN '人工指定' END AS auto_note
  FROM items i LEFT JOIN a ON a.id = i.id""")
def assign_category(t: Tables):
    a = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_suppkey").alias("category_id")).select(
        "id", "category_id", F.lit(1.0).alias("confidence"), F.lit("人工指定").alias("note"))
    return U.assign_category(_assignable(t), a)


@plan("bind_owner_and_file", f"""WITH {M.ITEMS_ORDERS_SQL}, b AS (SELECT max(o_orderkey) AS id, o_custkey AS owner FROM orders
    WHERE o_totalprice > 400000 GROUP BY o_custkey)
  SELECT i.id, CASE WHEN b.id IS NULL THEN i.status ELSE 'filed' END AS status,
    CASE WHEN b.id IS NULL THEN i.owner_id ELSE 5 END AS category_id,
    CASE WHEN b.id IS NOT NULL THEN 'UP主规则:' || c_name || ' 的视频归入本分类' END AS auto_note
  FROM items i LEFT JOIN b ON b.id = i.id LEFT JOIN customer ON c_custkey = b.owner""")
def bind_owner_and_file(t: Tables):
    bound = t.orders.filter(F.col("o_totalprice") > 400000).groupBy("o_custkey").agg(F.max("o_orderkey").alias("id"))
    rules = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"),
                              F.col("c_nationkey").cast("long").alias("category_id"))
    fresh = bound.select(F.col("o_custkey").alias("owner_id"), F.lit(5).cast("long").alias("category_id"))
    rules = U.upsert_merge(rules, fresh, ["owner_id"])
    filed = bound.join(rules, F.col("o_custkey") == F.col("owner_id")).select(
        "id", "category_id", F.lit(1.0).alias("confidence"),
        F.concat(F.lit("UP主规则:"), "owner_name", F.lit(" 的视频归入本分类")).alias("note"))
    return U.assign_category(_assignable(t), filed).drop("category_conf")


@plan("confirm_category", f"""WITH {M.CATEGORIES_SQL}
  SELECT id, CASE status WHEN 'proposed' THEN 'active' ELSE status END AS status FROM cats""")
def confirm_category(t: Tables):
    return U.set_where(M.categories(t).select("id", "status"), "status", "active", F.col("status") == "proposed")


def _deleted(t: Tables):
    gone = t.nation.filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").cast("long").alias("id"))
    items = M.items_orders(t).select("id", "status", (F.col("id") % 25).alias("category_id"))
    prompts = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30).alias("category_id"))
    feedback = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("prompt_id"))
    owners = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_nationkey").cast("long").alias("category_id"))
    return U.delete_category(gone, items, M.categories(t), prompts, feedback, owners)


@plan("delete_category", """
  SELECT n_nationkey::BIGINT AS id, n_name AS name, (SELECT count(*) FROM orders WHERE o_orderkey % 25 = n_nationkey) AS items,
    (SELECT count(*) FROM part WHERE p_partkey % 30 = n_nationkey) AS prompts,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS owner_rules FROM nation WHERE n_regionkey = 2
  UNION ALL SELECT -1, 'left', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'
      AND o_orderkey % 25 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)),
    (SELECT count(*) FROM part WHERE p_partkey % 30 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)),
    (SELECT count(*) FROM lineitem WHERE l_partkey % 30 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))""")
def delete_category(t: Tables):
    out = _deleted(t)
    one = F.count(F.lit(1))
    left = (out["items"].agg(F.count_if(F.col("status") == "filed").alias("items"))
            .join(out["prompts"].agg(one.alias("prompts"))).join(out["feedback"].agg(one.alias("owner_rules"))))  # one row each
    return out["counts"].select("id", "name", "items", "prompts", "owner_rules").unionByName(
        left.select(F.lit(-1).cast("long").alias("id"), F.lit("left").alias("name"), "items", "prompts", "owner_rules"))


@plan("delete_by_source", """
  WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
  SELECT 'items' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'links', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g) AND o_orderkey + 1 NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'jobs', count(*) FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
    AND o_orderkey IN (SELECT id FROM g))""")
def delete_by_source(t: Tables):
    o, k = t.orders, F.col("o_orderkey")
    refs = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("source_ref"))
    jobs = o.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "auto_process").otherwise("ingest_text").alias("type"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
        F.to_json(F.struct(k.alias("item_id"))).alias("payload"))
    out = U.delete_by_source(
        refs, o.select(k.alias("id"), F.col("o_custkey").alias("source_ref")),
        t.lineitem.select(F.col("l_orderkey").alias("item_id")), t.embeddings.select(F.col("vec_id").alias("item_id")),
        o.select(k.alias("item_a"), (k + 1).alias("item_b")), jobs)
    from keepsake.operators.aggregates import table_counts

    return table_counts(out)


@plan("cancel_tasks", """
  SELECT event_id AS id FROM events WHERE NOT (event_type IN ('click', 'view') AND value > 20
    AND CAST(json_extract_string(props, '$.k') AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000))""")
def cancel_tasks(t: Tables):
    ids = t.supplier.filter(F.col("s_acctbal") > 4000).select(F.col("s_suppkey").alias("id"))
    return U.cancel_tasks(_task_table(t), ids).select("id")


@plan("purge_stale", """
  SELECT l_orderkey AS item_id, min(l_partkey) AS row_id FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def purge_stale(t: Tables):
    index = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("row_id"))
    parents = t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("item_id"))
    return U.purge_stale(index, parents, "item_id", "row_id")


def _counted(table, n: int, *columns):
    """The changed table's rows summed up, next to the number of changed rows that its write has measured."""
    return table.agg(F.lit(n).cast("long").alias("n_affected"), F.count(F.lit(1)).alias("n_rows"), *columns)


@plan("unbind_counted", f"""WITH {M.BINDINGS_SQL}, k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  SELECT count(*) FILTER (o_custkey IS NOT NULL) AS n_affected, count(*) FILTER (o_custkey IS NULL) AS n_rows
  FROM rules LEFT JOIN k ON o_custkey = id""")
def unbind_counted(t: Tables):
    gone = t.orders.filter(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").alias("id"))
    return _counted(*U.delete_keys_counted(M.bindings(t).select("id", "kind", "target"), gone, ["id"]))


@plan("bulk_set_status_counted", f"""WITH {M.ITEMS_ORDERS_SQL}
  SELECT count(*) FILTER (status = 'inbox' AND domain = '2-HIGH') AS n_affected, count(*) AS n_rows,
    count(*) FILTER (status = 'archived' OR status = 'inbox' AND domain = '2-HIGH') AS n_archived FROM items""")
def bulk_set_status_counted(t: Tables):
    changed = U.bulk_set_status_counted(M.items_orders(t).select(*_ITEMS), "inbox", "archived", "2-HIGH")
    return _counted(*changed, F.count_if(F.col("status") == "archived").alias("n_archived"))


def _task_table(t: Tables):
    return t.events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "click", "auto_process").when(F.col("event_type") == "view", "build_links")
        .otherwise("ingest_text").alias("type"),
        F.when(F.col("value") > 20, "pending").otherwise("done").alias("status"),
        F.replace(F.col("props"), F.lit('"k"'), F.lit('"item_id"')).alias("payload"))


@plan("cancel_tasks_counted", """
  WITH e AS (SELECT event_type IN ('click', 'view') AND value > 20 AND CAST(json_extract_string(props, '$.k') AS BIGINT)
    IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) AS gone FROM events)
  SELECT count(*) FILTER (gone) AS n_affected, count(*) FILTER (gone IS DISTINCT FROM true) AS n_rows FROM e""")
def cancel_tasks_counted(t: Tables):
    ids = t.supplier.filter(F.col("s_acctbal") > 4000).select(F.col("s_suppkey").alias("id"))
    return _counted(*U.cancel_tasks_counted(_task_table(t), ids))


@plan("purge_stale_counted", """
  WITH k AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem
             WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
  SELECT (SELECT count(*) FROM lineitem) - n AS n_affected, n AS n_rows FROM k""")
def purge_stale_counted(t: Tables):
    index = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("row_id"))
    parents = t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("item_id"))
    return _counted(*U.purge_stale_counted(index, parents, "item_id", "row_id"))


@plan("recover_running_counted", """
  SELECT count(*) FILTER (o_orderstatus = 'P') AS n_affected, count(*) AS n_rows,
    count(*) FILTER (o_orderstatus = 'P') AS n_noted FROM orders""")
def recover_running_counted(t: Tables):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(
        F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"))
    return _counted(*U.recover_running_counted(jobs), F.count("error").alias("n_noted"))


@plan("bucket_schedule", "SELECT DISTINCT user_id AS source, epoch_us(ts) // 21600000000 AS bucket FROM events")
def bucket_schedule(t: Tables):
    return U.bucket_schedule(t.events.withColumnRenamed("user_id", "source"), "source", "ts", 21600)


@plan("recover_running", """
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'done' END AS status,
    CASE o_orderstatus WHEN 'P' THEN '上次进程中断,已自动恢复重试' END AS error FROM orders""")
def recover_running(t: Tables):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(
        F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"))
    return U.recover_running(jobs)


@plan("migrate_attrs", """
  SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN props END AS attrs_json,
    CASE event_type WHEN 'purchase' THEN NULL ELSE props END AS attrs_ai, strftime(ts, '%Y-%m-%d %H:%M:%S') AS happened_at FROM events""")
def migrate_attrs(t: Tables):
    old = t.events.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "product").otherwise("note").alias("type"),
        F.col("props").alias("attrs_json"), F.lit(None).cast("string").alias("attrs_ai"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("happened_at"))
    return U.migrate_attrs(old).withColumn("happened_at", S.ts_normalize("happened_at")).drop("type")


@plan("touch_source", """
  SELECT s_suppkey AS id, strftime((SELECT max(ts) FROM events WHERE user_id = s_suppkey), '%Y-%m-%d %H:%M:%S') AS last_checked
  FROM supplier""")
def touch_source(t: Tables):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("last_checked"))
    checks = t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("at")).select(
        "id", S.ts_text("at").alias("last_checked"))
    return U.upsert_merge(old, checks.join(old.select("id"), "id", "left_semi"), ["id"])


@plan("append_rows", """
  SELECT event_id AS id, event_type AS domain, 'manual' AS source, 1::BIGINT AS enabled FROM events WHERE ts < TIMESTAMP '2024-01-16'
  UNION ALL SELECT event_id, CASE WHEN value > 20 THEN event_type ELSE 'general' END, 'chat', 1 FROM events
    WHERE ts >= TIMESTAMP '2024-01-16'""")
def append_rows(t: Tables):
    one = F.lit(1).cast("long")
    old = t.events.filter(F.col("ts") < _cut("2024-01-16")).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("domain"), F.lit("manual").alias("source"), one.alias("enabled"))
    new = t.events.filter(F.col("ts") >= _cut("2024-01-16")).select(
        F.col("event_id").alias("id"), F.when(F.col("value") > 20, F.col("event_type")).alias("domain"),
        F.lit("chat").alias("source"))
    return U.append_rows(old, new, {"domain": F.lit("general"), "enabled": one})


@plan("extract_persist", """
  SELECT event_id AS reply_id, 'profile' AS kind, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE event_type = 'click'
  UNION ALL SELECT event_id, 'log', 'fitness', event_type FROM events WHERE event_type IN ('view', 'error')""")
def extract_persist(t: Tables):
    e = F.col("event_type")
    reply = (F.when(e == "click", F.concat(F.lit('{"profile": [{"key": "k", "value": "'), S.json_field("props", "k"),
                                           F.lit('"}, {"key": "", "value": "1"}, {"key": "x", "value": null}], "log": null}')))
             .when(e.isin("view", "error"), F.concat(F.lit('{"profile": [], "log": {"content": "'), e, F.lit('", "domain": ""}}')))
             .when(e == "signup", F.lit('{"log": {"content": "", "domain": "x"}}')).otherwise("not json"))
    profile, log = U.persist_extraction(t.events.select(
        F.col("event_id").alias("reply_id"), F.lit("fitness").alias("skill"), reply.alias("json")), "skill")
    return profile.select("reply_id", F.lit("profile").alias("kind"), "key", "value").unionByName(
        log.select("reply_id", F.lit("log").alias("kind"), F.col("domain").alias("key"), F.col("content").alias("value")))
