"""Classification, prompt and clip queries."""

from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators import classify as C
from keepsake.operators import joins as J
from keepsake.operators import retrieval as Q
from keepsake.plans import mapping as M
from keepsake.plans.joined import MATCHES_SQL, rule_items, rules
from keepsake.plans.registry import Tables, plan

_TAILS = ", ".join(f"'{x}'" for x in X.GENERIC_TAILS)
_TAIL_RE = "|".join(X.GENERIC_TAILS)

#: Categories with suffix variants, from the parts: domain = brand, name = type plus a suffix.
CATS_SQL = """cat AS (SELECT p_partkey AS id, p_brand AS domain, p_type || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '主题'
      WHEN 2 THEN '主题分类' ELSE '内容' END AS name,
    CASE p_partkey % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'proposed' ELSE 'active' END AS status FROM part)"""


def variant_categories(t: Tables):
    k, s = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"),
        F.concat("p_type", F.when(k == 0, "").when(k == 1, "主题").when(k == 2, "主题分类").otherwise("内容")).alias("name"),
        F.when(s == 0, "archived").when(s == 1, "proposed").otherwise("active").alias("status"))


@plan("category_variant_join", f"""WITH {CATS_SQL}, n AS (SELECT DISTINCT domain, name FROM cat),
  tail(t) AS (SELECT unnest([{_TAILS}]))
  SELECT a.domain, a.name, b.name AS variant FROM n a JOIN tail ON true JOIN n b ON b.domain = a.domain AND b.name = a.name || t""")
def category_variant_join(t: Tables):
    return C.variant_names(variant_categories(t))


@plan("category_dedupe", f"""WITH RECURSIVE {CATS_SQL}, n AS (SELECT DISTINCT domain, name FROM cat),
  p AS (SELECT a.domain, a.name, b.name AS parent FROM n a JOIN n b ON b.domain = a.domain
        AND b.name = regexp_replace(a.name, '^(.+)({_TAIL_RE})$', '\\1') AND b.name <> a.name),
  w AS (SELECT domain, name, name AS root, 0 AS d FROM n UNION ALL
        SELECT w.domain, w.name, p.parent, d + 1 FROM w JOIN p ON p.domain = w.domain AND p.name = w.root),
  r AS (SELECT domain, name, arg_max(root, d) AS root FROM w GROUP BY 1, 2),
  c AS (SELECT cat.*, r.root, (SELECT count(*) FROM lineitem WHERE l_partkey = cat.id) AS items
        FROM cat JOIN r ON r.domain = cat.domain AND r.name = cat.name)
  SELECT id, first_value(id) OVER (PARTITION BY domain, root ORDER BY CASE status WHEN 'active' THEN 0 ELSE 1 END,
      length(name), items DESC, id) AS keeper_id FROM c""")
def category_dedupe(t: Tables):
    return C.dedupe_categories(variant_categories(t), t.lineitem.select(F.col("l_partkey").alias("category_id")))


#: Orders as items with a verdict each; customers carry owner rules.
ROUTE_SQL = """it AS (SELECT o_orderkey AS id, n_name AS domain_name, r_name AS domain, o_custkey,
    CASE WHEN c_acctbal < 0 THEN c_nationkey::BIGINT END AS rule_category_id, c_name AS rule_owner_name
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
  vd AS (SELECT o_orderkey AS id, o_orderkey % 25 AS category_id,
    CASE WHEN o_orderkey % 7 = 0 THEN '「NATION_' || (o_orderkey % 40) || '」' ELSE '' END AS new_name,
    CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 100) / 100.0::DOUBLE END AS confidence,
    CASE o_orderkey % 3 WHEN 0 THEN '建议新增「NATION_' || (o_orderkey % 30) || '范畴」' WHEN 1 THEN '属于NATION_' || (o_orderkey % 35)
      ELSE 'unclear' END AS reason FROM orders)"""


def route_inputs(t: Tables):
    items = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("o_orderkey").alias("id"), F.col("r_name").alias("domain"),
        F.when(F.col("c_acctbal") < 0, F.col("c_nationkey").cast("long")).alias("rule_category_id"),
        F.col("c_name").alias("rule_owner_name")))
    k = F.col("o_orderkey")
    text = lambda m: (k % m).cast("string")
    verdicts = t.orders.select(
        k.alias("item_id"), (k % 25).alias("category_id"),
        F.when(k % 7 == 0, F.concat(F.lit("「NATION_"), text(40), F.lit("」"))).otherwise("").alias("new_name"),
        F.when(k % 11 == 0, F.lit(None)).otherwise((k % 100) / 100.0).alias("confidence"),
        F.when(k % 3 == 0, F.concat(F.lit("建议新增「NATION_"), text(30), F.lit("范畴」")))
        .when(k % 3 == 1, F.concat(F.lit("属于NATION_"), text(35))).otherwise("unclear").alias("reason"))
    return items, verdicts, M.categories(t)


_ROUTED_SQL = f"""{M.CATEGORIES_SQL}, {ROUTE_SQL},
  a AS (SELECT it.id, it.domain, it.rule_category_id, it.rule_owner_name, vd.category_id AS vc, vd.confidence, vd.reason,
      EXISTS (SELECT 1 FROM cats WHERE cats.id = vd.category_id AND cats.domain = it.domain AND status = 'active')
        AND vd.confidence >= 0.8 AS direct,
      CASE WHEN new_name <> '' THEN regexp_replace(new_name, '[「」]', '', 'g')
        WHEN reason LIKE '建议%' THEN regexp_replace(regexp_extract(reason, '「(.*)」', 1), '范畴$', '')
        WHEN reason LIKE '属于%' AND confidence >= 0.5 THEN substring(reason, 3) END AS prop
    FROM it JOIN vd ON vd.id = it.id),
  b AS (SELECT *, CASE WHEN rule_category_id IS NULL AND NOT direct THEN prop END AS p FROM a),
  c AS (SELECT b.*, (SELECT min(cats.id) FROM cats WHERE cats.domain = b.domain AND status <> 'archived' AND cats.name = b.p) AS e FROM b),
  d AS (SELECT c.*, cats.status AS es FROM c LEFT JOIN cats ON cats.id = c.e),
  routed AS (SELECT id, CASE WHEN rule_category_id IS NOT NULL OR direct THEN 'filed' WHEN p IS NULL THEN 'inbox'
      WHEN es = 'active' AND confidence >= 0.8 THEN 'filed' ELSE 'proposed' END AS action,
    CASE WHEN rule_category_id IS NOT NULL THEN rule_category_id WHEN direct THEN vc ELSE e END AS category_id,
    CASE WHEN e IS NULL THEN p END AS new_category,
    CASE WHEN rule_category_id IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence,
    CASE WHEN rule_category_id IS NOT NULL THEN 'UP主规则:' || rule_owner_name || ' 的视频归入本分类'
      WHEN direct OR (es = 'active' AND confidence >= 0.8) THEN reason WHEN p IS NULL THEN '未分类:' || reason
      WHEN e IS NOT NULL THEN '命中已有分类「' || p || '」。' || reason ELSE '提议新分类:' || p || '。' || reason END AS note FROM d)"""


@plan("route_decision", f"WITH {_ROUTED_SQL} SELECT * FROM routed")
def route_decision(t: Tables):
    return C.route(*route_inputs(t)).drop("domain")


@plan("owner_rule_filing", f"WITH {_ROUTED_SQL} SELECT id, category_id, note FROM routed WHERE confidence = 1.0")
def owner_rule_filing(t: Tables):
    items, verdicts, categories = route_inputs(t)
    ruled = items.filter(F.col("rule_category_id").isNotNull())
    return C.route(ruled, verdicts, categories).select("id", "category_id", "note")


@plan("prompt_resolve", f"""WITH {MATCHES_SQL}
  SELECT item.id, m.prompt_name AS profile FROM item LEFT JOIN matched m ON m.id = item.id AND m.r = 1""")
def prompt_resolve(t: Tables):
    items = rule_items(t)
    best = J.match_rules(items, rules(t)).select("id", F.col("prompt_name").alias("profile"))
    return items.select("id").join(best, "id", "left")


@plan("win_first_match", f"WITH {MATCHES_SQL} SELECT prompt_name, count(*) AS n FROM matched WHERE r = 1 GROUP BY 1")
def win_first_match(t: Tables):
    return J.match_rules(rule_items(t), rules(t)).groupBy("prompt_name").agg(F.count(F.lit(1)).alias("n"))


@plan("prompt_select", f"""WITH {MATCHES_SQL}
  SELECT item.id, CASE WHEN CAST(substring(m.prompt_name, 9) AS INT) % 3 = 0 THEN 'profile'
      WHEN item.id % 25 % 2 = 0 THEN 'category' ELSE 'generic' END AS source,
    CASE WHEN CAST(substring(m.prompt_name, 9) AS INT) % 3 = 0 THEN CAST(substring(m.prompt_name, 9) AS INT) + 100
      WHEN item.id % 25 % 2 = 0 THEN item.id % 25 + 200 ELSE 300 END::BIGINT AS version
  FROM item LEFT JOIN matched m ON m.id = item.id AND m.r = 1""")
def prompt_select(t: Tables):
    k = F.col("n_nationkey").cast("long")
    prompt = lambda name, cat, ver, cond: t.nation.filter(cond).select(
        name.alias("name"), cat.alias("category_id"), ver.cast("long").alias("version"), F.lit("active").alias("status"))
    prompts = (prompt(F.concat(F.lit("profile_"), k.cast("string")), F.lit(None).cast("long"), k + 100, k % 3 == 0)
               .unionByName(prompt(F.lit("extract"), k, k + 200, k % 2 == 0))
               .unionByName(prompt(F.lit("extract"), F.lit(None).cast("long"), F.lit(300), k == 0)))
    items = rule_items(t)
    best = J.match_rules(items, rules(t)).select("id", F.col("prompt_name").alias("profile"))
    asked = items.select("id", (F.col("id") % 25).alias("category_id")).join(best, "id", "left")
    return C.select_prompt(asked, prompts)


@plan("prompt_version", """
  SELECT o_custkey AS owner_id, o_orderkey AS id, row_number() OVER w AS version,
    CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) THEN 'active' ELSE 'retired' END AS status
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prompt_version(t: Tables):
    log = t.orders.select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    month = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 2592000)
    return C.number_versions(log, "owner_id", ["o_orderdate", "id"], month).drop("o_orderdate")


@plan("seed_upgrade", """
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'new text'
    ELSE o_orderpriority END AS content,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'upgrade' ELSE 'user' END AS origin FROM orders""")
def seed_upgrade(t: Tables):
    prompts = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("retired").alias("status"),
        F.col("o_orderpriority").alias("content"), F.lit("user").alias("origin"), F.lit(1).alias("version"))
    return C.upgrade_seeds(prompts, [" 1-URGENT ", "5-LOW"], "new text").select("id", "content", "origin")


@plan("feedback_add", "SELECT item_id AS feedback_id, text AS critique, 64::BIGINT AS dim FROM benchmark")
def feedback_add(t: Tables):
    rows = t.benchmark.select(F.col("item_id").alias("feedback_id"), F.col("text").alias("critique"))
    return Q.embed(rows, "critique", Q.HashEncoder).select(
        "feedback_id", "critique", F.size("embedding").cast("long").alias("dim"))


UNITS_SQL = """units AS (SELECT l_orderkey AS item_id, l_quantity AS lo, l_quantity + l_linenumber AS hi,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey) AS n FROM lineitem)"""


def units_of(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_quantity").alias("lo"),
                             (F.col("l_quantity") + F.col("l_linenumber")).alias("hi"), "l_partkey", "l_suppkey")
    return C.number_units(rows, "item_id", ["lo", "l_partkey", "l_suppkey"], F.floor(F.col("lo") / 10)).select(
        "item_id", "n", "lo", "hi")


@plan("win_ordinal_units", f"WITH {UNITS_SQL} SELECT item_id, n, lo, hi FROM units")
def win_ordinal_units(t: Tables):
    return units_of(t)


@plan("clip_extract", f"""WITH {UNITS_SQL},
  refs AS (SELECT l_orderkey AS item_id, l_partkey * 10000 + l_suppkey AS ref_id, l_linenumber AS f,
      CASE WHEN l_returnflag = 'A' THEN l_linenumber WHEN l_returnflag = 'R' THEN l_suppkey % 6 ELSE NULL END AS g,
      l_returnflag = 'N' AS broken, l_linestatus AS kind FROM lineitem),
  s AS (SELECT r.item_id, r.ref_id, a.lo, b.hi, CASE r.kind WHEN 'O' THEN '片段' ELSE r.kind END AS kind FROM refs r
    JOIN units a ON a.item_id = r.item_id AND a.n = least(r.f, r.g) JOIN units b ON b.item_id = r.item_id AND b.n = greatest(r.f, r.g)
    WHERE NOT broken)
  SELECT item_id, round_even(lo, 2) AS start_ts, round_even(hi, 2) AS end_ts, arg_min(kind, ref_id) AS kind FROM s GROUP BY 1, 2, 3""")
def clip_extract(t: Tables):
    line = F.col("l_linenumber").cast("string")
    refs = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ref_id"),
        line.alias("from_unit"), F.when(F.col("l_returnflag") == "A", F.lit(None)).when(
            F.col("l_returnflag") == "R", (F.col("l_suppkey") % 6).cast("string")).otherwise("last").alias("to_unit"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("kind"), F.lit(None).cast("double").alias("confidence"))
    return C.clips_from_units(refs, units_of(t), "item_id").drop("confidence")


_RAW_CLIPS_SQL = """raw AS (SELECT o_orderkey AS item_id, o_orderkey AS clip_id,
    extract(day FROM o_orderdate) - 3.0::DOUBLE AS start_ts,
    extract(day FROM o_orderdate) - 3.0::DOUBLE + extract(month FROM o_orderdate) / 3.0::DOUBLE AS end_ts FROM orders)"""


@plan("clip_snap", f"""WITH {_RAW_CLIPS_SQL},
  bnd AS (SELECT DISTINCT l_orderkey AS item_id, b FROM (SELECT l_orderkey, l_quantity AS b FROM lineitem
    UNION ALL SELECT l_orderkey, l_quantity + l_linenumber FROM lineitem)),
  v AS (SELECT * FROM raw WHERE start_ts >= 0 AND end_ts >= 0 AND end_ts - start_ts >= 0.5),
  s AS (SELECT v.item_id, v.clip_id, any_value(v.start_ts) AS s0, any_value(v.end_ts) AS e0,
      max(b) FILTER (WHERE b <= v.start_ts) AS lo, min(b) FILTER (WHERE b >= v.end_ts) AS hi, min(b) AS first, max(b) AS last
    FROM v LEFT JOIN bnd ON bnd.item_id = v.item_id GROUP BY 1, 2),
  o AS (SELECT item_id, clip_id, coalesce(lo, first, s0) AS start_ts, coalesce(hi, last, e0) AS end_ts FROM s)
  SELECT item_id, clip_id, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts FROM o WHERE end_ts - start_ts >= 0.5""")
def clip_snap(t: Tables):
    start = F.dayofmonth("o_orderdate") - F.lit(3.0)
    clips = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("clip_id"),
                            start.alias("start_ts"), (start + F.month("o_orderdate") / F.lit(3.0)).alias("end_ts"))
    bounds = M.chunks_lines(t).select("item_id", F.explode(F.array("start_ts", "end_ts")).alias("b"))
    return C.snap_clips(clips, bounds, "item_id", 16.0).select(
        "item_id", "clip_id", F.round("start_ts", 6).alias("start_ts"), F.round("end_ts", 6).alias("end_ts"))


@plan("clips_replace", """
  SELECT l_orderkey AS item_id, l_quantity AS start_ts, l_returnflag AS kind FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_orderkey, 0.0::DOUBLE, CASE o_orderpriority WHEN '5-LOW' THEN '片段' ELSE o_orderpriority END
    FROM orders WHERE o_orderstatus = 'F'""")
def clips_replace(t: Tables):
    old = M.chunks_lines(t).select("item_id", "start_ts", F.col("modality").alias("kind"))
    new = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("item_id"), F.lit(None).cast("double").alias("start_ts"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("kind"))
    fresh = new.select("item_id", F.coalesce("start_ts", F.lit(0.0)).alias("start_ts"),
                       F.coalesce("kind", F.lit(C.CLIP_KIND)).alias("kind"))
    return old.join(new.select("item_id"), "item_id", "left_anti").unionByName(fresh)


