"""Text, date, number, JSON and map queries."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.functions import text as X
from keepsake.operators import textual as T
from keepsake.plans import mapping as M
from keepsake.plans.ingest import STRIP
from keepsake.plans.registry import Tables, plan

_TAILS = "|".join(X.GENERIC_TAILS)
_FILL = "|".join(sorted(X.FILLER_TAILS, key=len, reverse=True))


@plan("extraction_text", f"""
  WITH s AS (SELECT doc_id AS id, {STRIP.format("text")} AS t FROM documents),
  r AS (SELECT id, t, length(t) AS n, substring(t, 1201, length(t)) AS rest,
          greatest(1, (length(t) - 1200) // 6) AS span FROM s),
  g AS (SELECT chr(10) || '……(省略)……' || chr(10) AS sep)
  SELECT id, CASE WHEN n <= 3000 THEN t ELSE concat_ws(sep, substring(t, 1, 1200),
      {", ".join(f"nullif(substring(rest, span * {i} + 1, least(span, 290)), '')" for i in range(5))},
      substring(rest, greatest(length(rest) - 289, 1), 290)) END AS text FROM r, g""")
def extraction_text(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), X.extraction_text("text").alias("text"))


@plan("profile_text", f"""
  SELECT d.doc_id AS id, substring(CASE WHEN l.doc_id IS NOT NULL
      THEN substring(text, 1, 40) || chr(10) || l.quality || chr(10) || l.toxic
      ELSE coalesce(nullif(substring({STRIP.format("text")}, 1, 600), ''), substring(text, 1, 40)) END, 1, 600) AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def profile_text(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    attrs = F.when(F.col("quality").isNotNull(), F.create_map(
        F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")))
    attrs = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    return d.select(F.col("doc_id").alias("id"), X.profile_text(
        F.substring("text", 1, 40), F.col("text"), attrs).alias("text"))


@plan("content_rollup", f"""
  SELECT conv_id AS item_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn) AS line_no, text AS line
  FROM conversations WHERE {STRIP.format("text")} <> ''""")
def content_rollup(t: Tables):
    lines = t.conversations.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"),
                                   F.when(F.col("role") == "user", 0).otherwise(1).alias("section"), "text")
    return T.body_lines(lines, "item_id", "section", "seq", "text").select(
        "item_id", "line_no", F.col("text").alias("line"))


@plan("row_to_text", """
  WITH r AS (SELECT o_orderstatus AS sheet, o_orderkey || ' | ' || o_custkey || ' | ' || o_orderpriority AS line,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
  SELECT sheet, '[工作表:' || sheet || ']' || chr(10) || string_agg(line, chr(10) ORDER BY k)
    || CASE WHEN max(n) > 200 THEN chr(10) || '...(截断)' ELSE '' END AS text
  FROM r WHERE k <= 200 GROUP BY sheet""")
def row_to_text(t: Tables):
    rows = t.orders.select(F.col("o_orderstatus").alias("sheet"), "o_orderkey", "o_custkey", "o_orderpriority")
    return T.sheet_text(rows, "sheet", [F.col("o_orderkey")],
                        [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")], T.SHEET_ROWS)


@plan("sheet_lines", """
  SELECT o_orderstatus AS sheet, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS line_no,
    o_orderkey || ' | ' || o_custkey || ' | ' || o_orderpriority AS line FROM orders""")
def sheet_lines(t: Tables):
    rows = t.orders.select(F.col("o_orderstatus").alias("sheet"), "o_orderkey", "o_custkey", "o_orderpriority")
    return T.sheet_lines(rows, "sheet", ["o_orderkey"],
                         [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")],
                         F.floor(F.col("o_orderkey") / 4000))


_LABEL = "printf('%02d:%02d', CAST(floor({0}) AS BIGINT) // 60, CAST(floor({0}) AS BIGINT) % 60)"


@plan("unit_text", f"""
  SELECT event_id AS id, '[单元 ' || {_LABEL.format("value")} || '-' || {_LABEL.format("(value * 2)")} || ']' || chr(10)
    || concat_ws(chr(10), CASE WHEN event_type = 'click' THEN '字幕:' || event_type END,
                 CASE WHEN value > 30 THEN '语音:' || props END) AS text
  FROM events WHERE event_type = 'click' OR value > 30""")
def unit_text(t: Tables):
    text = X.unit_text(S.fmt_ts("value"), S.fmt_ts(F.col("value") * 2),
                       F.when(F.col("event_type") == "click", F.col("event_type")),
                       F.when(F.col("value") > 30, F.col("props")))
    return t.events.select(F.col("event_id").alias("id"), text.alias("text")).filter(F.col("text").isNotNull())


#: Reasons built from product names: strong, weak and no wording.
_REASON_SQL = """SELECT p_partkey AS id, CASE p_partkey % 4
    WHEN 0 THEN '建议新增「' || replace(p_name, ' ', '') || '范畴」更好' WHEN 1 THEN '属于' || replace(p_name, ' ', '') || '最合适'
    WHEN 2 THEN '归入 ' || p_type || '标签' ELSE '没有' || p_name END AS reason FROM part"""


def reasons(t: Tables):
    k, plain = F.col("p_partkey") % 4, F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    return t.part.select(F.col("p_partkey").alias("id"), F.when(
        k == 0, F.concat(F.lit("建议新增「"), plain, F.lit("范畴」更好")))
        .when(k == 1, F.concat(F.lit("属于"), plain, F.lit("最合适")))
        .when(k == 2, F.concat(F.lit("归入 "), F.col("p_type"), F.lit("标签")))
        .otherwise(F.concat(F.lit("没有"), F.col("p_name"))).alias("reason"))


_CLEAN = (f"nullif(regexp_replace(regexp_replace(regexp_replace(%s, '[{X.TRAILING_CHARS}]+$', ''), "
          f"'({_FILL})$', ''), '^(.{{2,}})({_TAILS})$', '\\1'), '')")


@plan("proposal_parse", f"""WITH r AS ({_REASON_SQL}),
  m AS (SELECT *, nullif(regexp_extract(reason, '{X.STRONG_PROPOSAL.removeprefix('(?U)').replace("'", "''")}', 1), '') AS strong,
          nullif(regexp_extract(reason, '{X.WEAK_PROPOSAL.removeprefix('(?U)').replace("'", "''")}', 1), '') AS weak FROM r)
  SELECT id, {_CLEAN % "coalesce(strong, weak)"} AS name, strong IS NOT NULL AS explicit FROM m""")
def proposal_parse(t: Tables):
    return reasons(t).select("id", X.proposal_name("reason").alias("name"),
                             X.proposal_strong("reason").isNotNull().alias("explicit"))


_RAW_SQL = """SELECT p_partkey AS id, p_type || CASE p_partkey % 4 WHEN 0 THEN '主题最合适' WHEN 1 THEN '类目'
    WHEN 2 THEN '比较合适' ELSE '内容' END AS raw FROM part"""


@plan("proposal_clean", f"WITH r AS ({_RAW_SQL}) SELECT id, {_CLEAN % 'raw'} AS name FROM r")
def proposal_clean(t: Tables):
    k = F.col("p_partkey") % 4
    raw = F.concat("p_type", F.when(k == 0, "主题最合适").when(k == 1, "类目").when(k == 2, "比较合适")
                   .otherwise("内容"))
    return t.part.select(F.col("p_partkey").alias("id"), X.proposal_clean(raw).alias("name"))


@plan("fmt_ts", f"""
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '--:--' ELSE {_LABEL.format("value * 40")} END AS label
  FROM events""")
def fmt_ts(t: Tables):
    sec = F.when(F.col("event_type") != "error", F.col("value") * 40)
    return t.events.select(F.col("event_id").alias("id"), S.fmt_ts(sec).alias("label"))


@plan("jump_link", """
  SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN
    'https://www.bilibili.com/video/BV' || lpad(CAST(page_id AS VARCHAR), 10, '0')
    || CASE WHEN page_id % 3 = 0 THEN '' ELSE '?t=' || page_id END END AS jump FROM pages""")
def jump_link(t: Tables):
    p = F.col("page_id")
    ref = F.concat("url", F.when(p % 2 == 0, F.concat(F.lit("/BV"), F.lpad(p.cast("string"), 10, "0")))
                   .otherwise(""))
    at = F.when(p % 3 != 0, p + 0.7)
    return t.pages.select(p.alias("id"), X.jump_link(ref, at).alias("jump"))


@plan("media_url", """
  SELECT page_id AS id, CASE WHEN starts_with(url, 'https://') THEN
    '/media/' || replace(substring(url, 9), chr(92), '/') END AS media FROM pages""")
def media_url(t: Tables):
    stored = F.regexp_replace("url", "^https://", "/vault/media/")
    return t.pages.select(F.col("page_id").alias("id"), X.media_url(stored, "/vault/media").alias("media"))


@plan("id_from_url", r"""
  SELECT page_id AS id, coalesce(nullif(regexp_extract(url, 'example\.[a-z]+/[a-z]+/(\d+)', 1), ''), NULL) AS found,
    CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS plain FROM pages""")
def id_from_url(t: Tables):
    plain = F.concat(F.lit(" "), F.col("page_id").cast("string"),
                     F.when(F.col("page_id") % 2 == 0, " ").otherwise("x"))
    return t.pages.select(F.col("page_id").alias("id"),
                          X.id_from_url("url", r"example\.[a-z]+/[a-z]+/(\d+)").alias("found"),
                          X.id_from_url(plain).alias("plain"))


@plan("dedup_hash", "SELECT page_id AS id, substring(sha1('page|' || url || '|' || html), 1, 16) AS dedup_key FROM pages")
def dedup_hash(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"),
                          X.dedup_hash(F.lit("page"), "url", "html").alias("dedup_key"))


@plan("tree_text", f"""WITH {M.CATEGORIES_SQL}
  SELECT domain, id, '- id=' || id || ' ' || name || CASE WHEN status = 'proposed' THEN '(待确认)' ELSE '' END AS line
  FROM cats WHERE status <> 'archived'""")
def tree_text(t: Tables):
    return T.category_lines(M.categories(t)).select("domain", "id", "line")


@plan("item_text", """
  SELECT doc_id AS id, '标题:' || substring(text, 1, 40) || chr(10) || '类型:' || source
    || CASE WHEN text <> '' THEN chr(10) || '内容:' || substring(text, 1, 1500) ELSE '' END AS text FROM documents""")
def item_text(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), X.item_text(
        F.substring("text", 1, 40), F.col("source"), F.col("text")).alias("text"))


@plan("ad_word_hit", """
  SELECT event_id AS id, event_type IN ('click', 'purchase') AS hit FROM events""")
def ad_word_hit(t: Tables):
    comment = F.when(F.col("event_type") == "click", "又接广了吧").when(
        F.col("event_type") == "purchase", "软广+带货").otherwise(F.col("event_type"))
    return t.events.select(F.col("event_id").alias("id"), X.contains_any(comment).alias("hit"))


@plan("payload_summary", """
  SELECT event_id AS id, 'k=' || json_extract_string(props, '$.k') AS summary FROM events""")
def payload_summary(t: Tables):
    return t.events.select(F.col("event_id").alias("id"), X.payload_summary("props").alias("summary"))


@plan("prompt_render", """
  SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'About ' || p_type || ': POLICY'
    ELSE 'On ' || p_type || chr(10) || '- POLICY' END AS prompt FROM part""")
def prompt_render(t: Tables):
    template = F.when(F.col("p_size") > 25, "About {category}: {ads_policy}").otherwise("On {category}")
    return t.part.select(F.col("p_partkey").alias("id"),
                         X.prompt_render(template, "p_type", F.lit("POLICY")).alias("prompt"))


# ---- scalars --------------------------------------------------------------

@plan("ts_normalize", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def ts_normalize(t: Tables):
    legacy = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select(F.col("event_id").alias("id"), S.ts_text(S.parse_ts(legacy)).alias("ts"))


@plan("time_bucket", "SELECT epoch_us(ts) // 1800000000 AS bucket, count(*) AS n FROM events GROUP BY 1")
def time_bucket(t: Tables):
    return t.events.groupBy(S.time_bucket("ts", 1800).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan("duration_label", """
  SELECT event_id AS id, CASE WHEN floor(value) < 120 THEN CAST(floor(value) AS BIGINT) || ' 秒'
    ELSE CAST(CAST(round_even(floor(value) / 60.0, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' 分钟' END AS label FROM events""")
def duration_label(t: Tables):
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    end = F.timestamp_seconds(F.unix_timestamp(start) + F.floor("value"))
    return t.events.select(F.col("event_id").alias("id"), S.duration_label(start, end).alias("label"))


@plan("cosine_similarity", f"""WITH {M.VECTORS_SQL}, q AS (SELECT e AS qe FROM vectors WHERE chunk_id = 0)
  SELECT chunk_id, round(list_dot_product(e, qe), 6) AS sim FROM vectors, q""")
def cosine_similarity(t: Tables):
    v = M.vectors(t)
    q = F.broadcast(v.filter(F.col("chunk_id") == 0).select(F.col("embedding").alias("qe")))  # one row
    return v.join(q).select("chunk_id", F.round(S.dot("embedding", "qe"), 6).alias("sim"))


@plan("l2_normalize", f"""WITH {M.VECTORS_SQL},
  n AS (SELECT chunk_id, list_transform(e, lambda x: x * 3 / sqrt(list_dot_product(e, e) * 9)) AS u FROM vectors)
  SELECT chunk_id, round(u[1], 6) AS first_cell, round(list_dot_product(u, u), 6) AS norm FROM n""")
def l2_normalize(t: Tables):
    u = M.vectors(t).select("chunk_id", S.l2_normalize(
        F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return u.select("chunk_id", F.round(F.element_at("u", 1), 6).alias("first_cell"),
                    F.round(S.dot("u", "u"), 6).alias("norm"))


@plan("band_rescale", "SELECT p_partkey AS id, round(0.5 + p_size / 50.0 * (0.75 - 0.5), 6)::DOUBLE AS y FROM part")
def band_rescale(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.round(S.band_rescale(
        F.col("p_size") / 50.0, F.lit(0.5), F.lit(0.75)), 6).alias("y"))


@plan("rrf_term", "SELECT l_linenumber::BIGINT AS rank, round(sum(1.0::DOUBLE / (60 + l_linenumber)), 6) AS total "
                  "FROM lineitem GROUP BY 1")
def rrf_term(t: Tables):
    return t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("rank")).agg(
        F.round(F.sum(S.rrf_term("l_linenumber")), 6).alias("total"))


@plan("json_field", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(t: Tables):
    return t.events.groupBy(S.json_field("props", "k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@plan("json_safe", """
  SELECT event_id AS id, CASE WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') END AS k,
    CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS n_keys FROM events""")
def json_safe(t: Tables):
    m = F.col("event_id") % 3
    broken = F.when(m == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(m == 1, F.col("props"))
    return t.events.select(F.col("event_id").alias("id"), S.json_safe(broken).alias("m")).select(
        "id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").cast("long").alias("n_keys"))


@plan("json_lenient", """
  SELECT event_id AS id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def json_lenient(t: Tables):
    m, p = F.col("event_id") % 4, F.col("props")
    reply = (F.when(m == 0, p).when(m == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\ndone")))
             .when(m == 2, F.concat(F.lit("I think "), p, F.lit(" fits"))).otherwise("no json here"))
    return t.events.select(F.col("event_id").alias("id"),
                           F.get_json_object(S.json_lenient(reply), "$.k").alias("k"))


def _attrs(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.create_map(
        F.lit("status"), F.col("o_orderstatus"),
        F.lit("note"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")),
        F.lit("商品"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))).alias("m"),
        F.when(F.col("o_custkey") % 5 == 0, "product").otherwise("note").alias("type"))


@plan("map_non_null", """
  SELECT o_orderkey AS id, (1 + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END
    + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_keys FROM orders""")
def map_non_null(t: Tables):
    return _attrs(t).select("id", F.size(S.map_non_null("m")).cast("long").alias("n_keys"))


@plan("schema_shape_check", "SELECT o_orderkey AS id, o_custkey % 3 = 0 AS fits FROM orders")
def schema_shape_check(t: Tables):
    # The keys one of which a reply must carry.
    return _attrs(t).select("id", S.has_any_key(
        S.map_non_null("m"), ["商品", "卖点", "内容标签", "目标人群", "内容结构"]).alias("fits"))


@plan("map_remap", """
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus END AS attrs_json,
    CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus END AS attrs_ai FROM orders""")
def map_remap(t: Tables):
    from keepsake.operators.mutate import migrate_attrs

    items = _attrs(t).select("id", "type", F.element_at("m", "status").alias("attrs_json"),
                             F.lit(None).cast("string").alias("attrs_ai"))
    return migrate_attrs(items).select("id", "attrs_json", "attrs_ai")


@plan("array_media", f"""WITH {M.ITEMS_DOCS_SQL}
  SELECT id, json_extract_string(media_paths, '$[0]') AS first_path FROM items""")
def array_media(t: Tables):
    return M.items_docs(t).select("id", S.first_media("media_paths").alias("first_path"))


@plan("toggle_flag", "SELECT s_suppkey AS id, (CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END)::BIGINT AS enabled FROM supplier")
def toggle_flag(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("id"),
                             S.toggle_flag((F.col("s_acctbal") > 0).cast("long")).alias("enabled"))


@plan("config_off", """
  SELECT o_orderkey AS id, o_custkey % 6 IN (0, 1, 2, 3) AS off FROM orders""")
def config_off(t: Tables):
    m = F.col("o_custkey") % 6
    value = (F.when(m == 0, "off").when(m == 1, " False ").when(m == 2, "Disabled").when(m == 3, F.lit(None))
             .when(m == 4, "auto").otherwise("on"))
    return t.orders.select(F.col("o_orderkey").alias("id"), S.is_off_column(value).alias("off"))
