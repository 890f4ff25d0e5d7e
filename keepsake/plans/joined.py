"""Join queries."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators import joins as J
from keepsake.operators import lookup as L
from keepsake.operators.blocks import first_n
from keepsake.plans import mapping as M
from keepsake.plans.registry import Tables, plan


@plan("join_rules_category", f"""WITH {M.CATEGORIES_SQL}
  SELECT c_custkey AS owner_id, c_name AS owner_name, c.name AS category_name, c.domain AS category_domain
  FROM customer LEFT JOIN cats c ON c.id = c_nationkey""")
def join_rules_category(t: Tables):
    rules = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner_name"),
                              F.col("c_nationkey").cast("long").alias("category_id"))
    return J.with_category(rules, M.categories(t)).drop("category_id")


@plan("join_owner_rule", """
  SELECT event_id AS id, c_nationkey::BIGINT AS rule_category_id, c_name AS rule_owner_name
  FROM events LEFT JOIN customer ON c_custkey = CAST(json_extract_string(props, '$.k') AS BIGINT)
    AND c_acctbal > 0""")
def join_owner_rule(t: Tables):
    rules = t.customer.filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("owner_id"), F.col("c_name").alias("owner_name"),
        F.col("c_nationkey").cast("long").alias("category_id"))
    items = t.events.select(F.col("event_id").alias("id"), "props")
    return J.owner_rule(items, rules, S.json_field("props", "k")).drop("props")


@plan("join_hits_enrich", f"""WITH {M.VECTORS_SQL},
  q AS (SELECT e AS qe FROM vectors WHERE chunk_id = 1),
  hits AS (SELECT chunk_id, item_id, list_dot_product(e, qe) AS score FROM vectors, q
           ORDER BY score DESC, chunk_id LIMIT 16)
  SELECT h.chunk_id, round(h.score, 6) AS score, d.doc_id AS item_id, d.lang AS domain, d.source AS type
  FROM hits h JOIN documents d ON d.doc_id = h.item_id""")
def join_hits_enrich(t: Tables):
    v = M.vectors(t)
    q = F.broadcast(v.filter(F.col("chunk_id") == 1).select(F.col("embedding").alias("qe")))  # one row
    hits = first_n(v.join(q).select("chunk_id", "item_id", S.dot("embedding", "qe").alias("score")),
                   [F.desc("score"), F.col("chunk_id")], 16)
    docs = t.documents.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("domain"),
                              F.col("source").alias("type"))
    return docs.join(F.broadcast(hits), "item_id").select(      # 16 rows
        "chunk_id", F.round("score", 6).alias("score"), "item_id", "domain", "type")


@plan("join_titles", """
  SELECT e.event_id AS id, e.user_id + 900 AS related_id,
         coalesce(substring(d.text, 1, 40), '#' || (e.user_id + 900)) AS title
  FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id + 900""")
def join_titles(t: Tables):
    related = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") + 900).alias("related_id"))
    items = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"))
    return J.titles_or_id(related, items).select("id", "related_id", "title")


@plan("binding_labels", """
  WITH five AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey
                    ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
  newest AS (SELECT o_custkey, arg_min(o_orderkey, r) AS o_orderkey FROM five
             WHERE r <= 5 AND o_orderstatus <> 'F' GROUP BY 1)
  SELECT e.k AS target, coalesce(c.c_name, 'order ' || n.o_orderkey) AS label
  FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  LEFT JOIN customer c ON c.c_custkey = e.k AND c.c_acctbal > 1000
  LEFT JOIN newest n ON n.o_custkey = e.k""")
def binding_labels(t: Tables):
    targets = t.events.select(S.json_field("props", "k").try_cast("long").alias("target")).distinct()
    rules = t.customer.filter(F.col("c_acctbal") > 1000).select(
        F.col("c_custkey").alias("target"), F.col("c_name").alias("rule_name"))
    orders = t.orders.select(
        F.col("o_custkey").alias("target"), "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "F", F.concat(
            F.lit("order "), F.col("o_orderkey").cast("string"))).alias("item_name"))
    newest = L.first_named(orders, "target", "item_name", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return targets.join(rules, "target", "left").join(newest, "target", "left").select(
        "target", F.coalesce("rule_name", "item_name").alias("label"))


@plan("semi_ids", """
  SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_ids(t: Tables):
    keys = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(keys, "l_orderkey", "left_semi")


@plan("anti_orphans", """
  SELECT o_orderkey AS id, o_custkey AS parent FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def anti_orphans(t: Tables):
    parents = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("parent"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")).join(
        parents, "parent", "left_anti")


@plan("anti_seen", """
  SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def anti_seen(t: Tables):
    seen = t.orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("key"))
    new = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("key"))
    return new.join(seen, "key", "left_anti").distinct()


@plan("anti_seen_whole", """
  SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def anti_seen_whole(t: Tables):
    """``anti_seen`` with one boundary: every order is known or new. Keys are summed up before they are compared."""
    known = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.bool_or(known).alias("known")).filter(
        "NOT known").select("key")


#: Event spans used by the interval joins: an event lasts as many minutes as its ``k``.
SPANS_SQL = f"""{M.SERIES_SQL}, spans AS (
  SELECT series_id, id, s.ts AS a0, s.ts + CAST(json_extract_string(e.props, '$.k') AS DOUBLE) * 60.0::DOUBLE AS a1,
         s.value
  FROM series s JOIN events e ON e.event_id = s.id)"""


def spans(t: Tables):
    start = S.seconds("ts")
    return t.events.select(
        F.col("user_id").alias("series_id"), F.col("event_id").alias("id"), start.alias("a0"),
        (start + S.json_field("props", "k").try_cast("double") * 60.0).alias("a1"), "value", "event_type")


@plan("interval_overlap", f"""WITH {SPANS_SQL}
  SELECT a.series_id, a.id AS event_id, b.id AS speech_id
  FROM spans a JOIN spans b ON a.series_id = b.series_id AND b.a1 > a.a0 AND b.a0 < a.a1""")
def interval_overlap(t: Tables):
    a = spans(t).select("series_id", F.col("id").alias("event_id"), "a0", "a1")
    b = spans(t).select("series_id", F.col("id").alias("speech_id"), F.col("a0").alias("b0"),
                        F.col("a1").alias("b1"))
    return J.interval_overlap(a, b, "series_id", ("a0", "a1"), ("b0", "b1"), 3600.0).select(
        "series_id", "event_id", "speech_id")


@plan("asof_settle", f"""WITH {SPANS_SQL}, cand AS (
    SELECT e.series_id, e.id, s.id AS settle_id, row_number() OVER (PARTITION BY e.id ORDER BY s.a0, s.id) AS r
    FROM spans e JOIN spans s ON e.series_id = s.series_id AND s.value <= 20
      AND s.a0 >= e.a1 AND s.a0 <= e.a1 + 10800.0::DOUBLE)
  SELECT e.series_id, e.id, c.settle_id AS first_settle_id
  FROM spans e LEFT JOIN cand c ON c.id = e.id AND c.r = 1""")
def asof_settle(t: Tables):
    events = spans(t).select("series_id", "id", "a1")
    quiet = spans(t).filter(F.col("value") <= 20).select("series_id", F.col("a0").alias("lo"),
                                                         F.col("id").alias("settle_id"))
    return J.asof_forward(events, quiet, "series_id", ["series_id", "id"], "a1", "lo", "settle_id",
                          10800.0).select("series_id", "id", "first_settle_id")


@plan("asof_snap", f"""WITH {SPANS_SQL},
  bounds AS (SELECT DISTINCT user_id AS series_id, epoch_us(ts) / 1000000.0::DOUBLE AS b FROM events
             WHERE event_type = 'view')
  SELECT s.series_id, s.id,
         (SELECT max(b) FROM bounds WHERE bounds.series_id = s.series_id AND b <= s.a0) AS below,
         (SELECT min(b) FROM bounds WHERE bounds.series_id = s.series_id AND b >= s.a0) AS above
  FROM spans s""")
def asof_snap(t: Tables):
    points = spans(t).select("series_id", F.col("a0").alias("x"), "id")
    bounds = spans(t).filter(F.col("event_type") == "view").select(
        "series_id", F.col("a0").alias("b")).distinct()
    return J.nearest_bounds(points, bounds, "series_id", "x", "b", 86400.0).select(
        "series_id", "id", "below", "above")


@plan("unit_ref_join", """
  WITH units AS (SELECT l_orderkey AS item, l_quantity AS lo, l_quantity + l_linenumber AS hi,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey) AS n FROM lineitem),
  refs AS (SELECT o_orderkey AS item, CAST(extract(month FROM o_orderdate) AS BIGINT) AS f,
                  CAST(extract(day FROM o_orderdate) AS BIGINT) % 7 AS g FROM orders)
  SELECT r.item, a.lo AS start_ts, b.hi AS end_ts FROM refs r
  JOIN units a ON a.item = r.item AND a.n = least(r.f, r.g)
  JOIN units b ON b.item = r.item AND b.n = greatest(r.f, r.g)""")
def unit_ref_join(t: Tables):
    from keepsake.operators.classify import number_units

    units = number_units(t.lineitem.select(
        F.col("l_orderkey").alias("item"), F.col("l_quantity").alias("lo"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("hi"), "l_partkey", "l_suppkey"),
        "item", ["lo", "l_partkey", "l_suppkey"], F.floor(F.col("lo") / 10)).select("item", "n", "lo", "hi")
    refs = t.orders.select(F.col("o_orderkey").alias("item"), F.month("o_orderdate").cast("long").alias("f"),
                           (F.dayofmonth("o_orderdate") % 7).cast("long").alias("g"))
    first = units.select("item", F.col("n").alias("n1"), F.col("lo").alias("start_ts"))
    last = units.select("item", F.col("n").alias("n2"), F.col("hi").alias("end_ts"))
    refs = refs.select("item", F.least("f", "g").alias("n1"), F.greatest("f", "g").alias("n2"))
    return refs.join(first, ["item", "n1"]).join(last, ["item", "n2"]).select("item", "start_ts", "end_ts")


@plan("band_exclusion", """
  SELECT p_partkey AS id, p_size::BIGINT AS size FROM part WHERE NOT EXISTS (
    SELECT 1 FROM nation WHERE (p_size / 50.0 + p_size / 50.0 + 0.02) / 2
      BETWEEN n_nationkey / 25.0 AND n_nationkey / 25.0 + 0.015)""")
def band_exclusion(t: Tables):
    lines = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"),
                          (F.col("p_size") / 50.0).alias("y0"), (F.col("p_size") / 50.0 + 0.02).alias("y1"))
    bands = t.nation.select((F.col("n_nationkey") / 25.0).alias("lo"),
                            (F.col("n_nationkey") / 25.0 + 0.015).alias("hi"))
    return J.outside_bands(lines, bands, "y0", "y1").select("id", "size")


#: Parts as items and customers as rules of every kind.
RULES_SQL = """rules AS (
    SELECT c_custkey AS rule_id, c_nationkey::BIGINT AS priority, 'profile_' || c_nationkey AS prompt_name,
      CASE c_custkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'up_set' WHEN 2 THEN 'domain'
           WHEN 3 THEN 'source_type' ELSE 'keyword' END AS kind,
      CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_custkey || ', ' || (c_custkey + 7)
           WHEN 2 THEN 'Brand#' || (c_custkey % 31) WHEN 3 THEN 'TYPE' || (c_custkey % 9)
           ELSE CASE c_nationkey % 4 WHEN 0 THEN 'hot r' WHEN 1 THEN 'small' WHEN 2 THEN 'widget' ELSE 'zzz' END END
        AS target
    FROM customer WHERE c_acctbal > 0),
  item AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS owner_id, p_brand AS domain,
                  p_type AS source_type, p_name AS title FROM part)"""


def rules(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    m = k % 5
    word = (F.when(n % 4 == 0, "hot r").when(n % 4 == 1, "small").when(n % 4 == 2, "widget")
            .otherwise("zzz"))
    text = lambda c: c.cast("string")
    return t.customer.select(
        k.alias("id"), n.cast("long").alias("priority"),
        F.concat(F.lit("profile_"), text(n)).alias("prompt_name"),
        (F.col("c_acctbal") > 0).cast("int").alias("enabled"),
        F.when(m == 0, "up").when(m == 1, "up_set").when(m == 2, "domain").when(m == 3, "source_type")
        .otherwise("keyword").alias("kind"),
        F.when(m == 0, text(k)).when(m == 1, F.concat(text(k), F.lit(", "), text(k + 7)))
        .when(m == 2, F.concat(F.lit("Brand#"), text(k % 31)))
        .when(m == 3, F.concat(F.lit("TYPE"), text(k % 9))).otherwise(word).alias("target"))


def rule_items(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("owner_id"),
                         F.col("p_brand").alias("domain"), F.col("p_type").alias("source_type"),
                         F.col("p_name").alias("title"))


MATCHES_SQL = f"""{RULES_SQL},
  matched AS (SELECT id, rule_id, priority, prompt_name,
      row_number() OVER (PARTITION BY id ORDER BY priority DESC, rule_id) AS r
    FROM item JOIN rules ON (kind = 'up' AND target = owner_id)
      OR (kind = 'up_set' AND list_contains([trim(x) FOR x IN string_split(target, ',')], owner_id))
      OR (kind = 'domain' AND target = domain) OR (kind = 'source_type' AND target = source_type)
      OR (kind = 'keyword' AND contains(title, target)))"""


@plan("rule_match_theta", f"WITH {MATCHES_SQL} SELECT id, rule_id, prompt_name FROM matched WHERE r = 1")
def rule_match_theta(t: Tables):
    return J.match_rules(rule_items(t), rules(t)).select("id", "rule_id", "prompt_name")
