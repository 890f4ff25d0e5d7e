"""Retrieval and link queries."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators import links as K
from keepsake.operators import retrieval as Q
from keepsake.operators import textual as T
from keepsake.operators.lookup import latest_per_key
from keepsake.operators.lsh import lsh_topk
from keepsake.plans import mapping as M
from keepsake.plans.registry import Tables, plan

#: Every embedding row is the vector of the document with the same number.
_V = """v AS (SELECT e.vec_id AS chunk_id, e.embedding::DOUBLE[] AS e, d.lang AS domain, e.label::BIGINT AS label
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""


def doc_vectors(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("domain"))
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding",
                               F.col("label").cast("long").alias("label")).join(d, "chunk_id", "left")


def one_query(t: Tables, vec_id: int):
    return t.embeddings.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qe"))


@plan("vector_topk", f"""WITH {_V}, q AS (SELECT e AS qe FROM v WHERE chunk_id = 0)
  SELECT chunk_id, row_number() OVER (ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS rank,
    round(list_dot_product(e, qe), 6) AS sim FROM v, q WHERE domain = 'en' ORDER BY rank LIMIT 10""")
def vector_topk(t: Tables):
    hits = Q.vector_topk(doc_vectors(t), one_query(t, 0), 10, F.col("domain") == "en")
    return hits.select("chunk_id", "rank", F.round("sim", 6).alias("sim"))


@plan("image_topk", f"""WITH {_V}, q AS (SELECT e AS qe FROM v WHERE chunk_id = 7)
  SELECT chunk_id, round(list_dot_product(e, qe), 4) AS score FROM v, q
  ORDER BY list_dot_product(e, qe) DESC, chunk_id LIMIT 12""")
def image_topk(t: Tables):
    return Q.vector_topk(doc_vectors(t), one_query(t, 7), 12).select("chunk_id", F.round("sim", 4).alias("score"))


@plan("similar_from_row", f"""WITH {_V}, q AS (SELECT e AS qe FROM v WHERE chunk_id = 3)
  SELECT chunk_id, round(list_dot_product(e, qe), 6) AS sim FROM v, q WHERE chunk_id <> 3
  ORDER BY list_dot_product(e, qe) DESC, chunk_id LIMIT 8""")
def similar_from_row(t: Tables):
    return Q.similar_rows(doc_vectors(t), 3, 8).select("chunk_id", F.round("sim", 6).alias("sim"))


@plan("feedback_topk", f"""WITH {_V}, q AS (SELECT e AS qe, label AS ql FROM v WHERE chunk_id = 5)
  SELECT chunk_id AS feedback_id, row_number() OVER (ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS rank
  FROM v, q WHERE label = ql ORDER BY rank LIMIT 3""")
def feedback_topk(t: Tables):
    v = doc_vectors(t)
    label = F.broadcast(v.filter(F.col("chunk_id") == 5).select("label"))     # one row
    same = v.join(label, "label", "left_semi")
    return Q.vector_topk(same, one_query(t, 5), 3).select(F.col("chunk_id").alias("feedback_id"), "rank")


def _hybrid_sql(queries: str, k: int, out: str) -> str:
    return f"""WITH {_V}, queries AS ({queries}),
  vh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
      ORDER BY list_dot_product(v.e, queries.qe) DESC, chunk_id) AS rank FROM queries JOIN v
      ON queries.domain IS NULL OR v.domain = queries.domain WHERE qe IS NOT NULL),
  kh AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
    FROM queries JOIN documents ON contains(lower(text), lower(trim(query)))),
  f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l) AS l FROM (
      SELECT *, 0 AS l FROM vh WHERE rank <= {2 * k} UNION ALL SELECT *, 1 FROM kh WHERE rank <= {2 * k}) GROUP BY 1, 2),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, chunk_id) AS r FROM f),
  j AS (SELECT f2.query_id, f2.chunk_id, f2.score, f2.l, d.lang AS domain, d.source AS type FROM f2
    JOIN documents d ON d.doc_id = f2.chunk_id JOIN queries q ON q.query_id = f2.query_id
    WHERE r <= {2 * k} AND (q.domain IS NULL OR q.domain = d.lang)),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, chunk_id) AS rank FROM j)
  {out} WHERE rank <= {k}"""


_HITS = "SELECT query_id, rank, chunk_id, chunk_id AS item_id, domain, type, round(score, 6) AS score FROM h"
_BATCH = """SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS qe,
    CASE b.item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS domain
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""


def chunk_table(t: Tables):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("item_id"),
                              F.col("text").alias("content"))


def item_table(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"),
                              F.col("source").alias("type"))


def batch_queries(t: Tables):
    m = F.col("item_id") % 3
    e = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qe"))
    return t.benchmark.join(e, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "qe",
        F.when(m == 0, "en").when(m == 1, "fr").alias("domain"))


@plan("hybrid_search_batch", _hybrid_sql(_BATCH, 8, _HITS))
def hybrid_search_batch(t: Tables):
    return Q.hybrid_search(chunk_table(t), doc_vectors(t), item_table(t), batch_queries(t), 8)


def _typed_sql(queries: str, k: int, out: str) -> str:
    """As ``_hybrid_sql`` with three filters; the category of a document is its length modulo 4."""
    ok = " AND ".join(f"(queries.{c} IS NULL OR {{0}}.{c} = queries.{c})" for c in Q.FILTERS)
    return f"""WITH d AS (SELECT doc_id, text, lang AS domain, source AS type, n_chars % 4 AS category_id FROM documents),
  v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, d.* FROM embeddings LEFT JOIN d ON doc_id = vec_id),
  queries AS ({queries}),
  vh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
      ORDER BY list_dot_product(v.e, queries.qe) DESC, chunk_id) AS rank FROM queries JOIN v
      ON {ok.format("v")} WHERE qe IS NOT NULL),
  kh AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
    FROM queries JOIN d ON contains(lower(text), lower(trim(query)))),
  f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l) AS l FROM (
      SELECT *, 0 AS l FROM vh WHERE rank <= {2 * k} UNION ALL SELECT *, 1 FROM kh WHERE rank <= {2 * k}) GROUP BY 1, 2),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, chunk_id) AS r FROM f),
  j AS (SELECT f2.query_id, f2.chunk_id, f2.score, f2.l, d.domain, d.type FROM f2
    JOIN d ON d.doc_id = f2.chunk_id JOIN queries USING (query_id) WHERE r <= {2 * k} AND {ok.format("d")}),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, chunk_id) AS rank FROM j)
  {out} WHERE rank <= {k}"""


_TYPED = """SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS qe,
    CASE b.item_id % 3 WHEN 0 THEN 'en' END AS domain, CASE b.item_id % 4 WHEN 1 THEN 'src' || (b.item_id % 20) END AS type,
    CASE b.item_id % 2 WHEN 0 THEN b.item_id % 4 END AS category_id
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""


def typed_items(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.col("source").alias("type"),
                              (F.col("n_chars") % 4).alias("category_id"))


def typed_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding").join(typed_items(t), "id", "left").withColumnRenamed(
        "id", "chunk_id")


@plan("hybrid_search_batch_typed", _typed_sql(_TYPED, 8, _HITS))
def hybrid_search_batch_typed(t: Tables):
    i = F.col("item_id")
    asked = t.benchmark.join(t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qe")),
                             "item_id", "left").select(
        i.alias("query_id"), F.col("text").alias("query"), "qe", F.when(i % 3 == 0, "en").alias("domain"),
        F.when(i % 4 == 1, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("type"),
        F.when(i % 2 == 0, i % 4).alias("category_id"))
    return Q.hybrid_search(chunk_table(t), typed_vectors(t), typed_items(t), asked, 8)


_TYPED_ONE = """SELECT 0 AS query_id, 'the' AS query, embedding::DOUBLE[] AS qe, 'en' AS domain, 'src0' AS type,
    2 AS category_id FROM embeddings WHERE vec_id = 0"""


@plan("hybrid_search_typed", _typed_sql(_TYPED_ONE, 8, _HITS.replace("query_id, ", "")))
def hybrid_search_typed(t: Tables):
    return Q.hybrid_search_one(chunk_table(t), typed_vectors(t), typed_items(t), "the", one_query(t, 0), 8, "en", "src0", 2)


_SINGLE = "SELECT 0 AS query_id, 'the' AS query, embedding::DOUBLE[] AS qe, 'en' AS domain FROM embeddings WHERE vec_id = 0"


def _hybrid_one(t: Tables, k: int, vector: bool = True):
    return Q.hybrid_search_one(chunk_table(t), doc_vectors(t), item_table(t), "the",
                               one_query(t, 0) if vector else None, k, "en")


@plan("hybrid_search", _hybrid_sql(_SINGLE, 8, _HITS.replace("query_id, ", "")))
def hybrid_search(t: Tables):
    return _hybrid_one(t, 8)


@plan("keyword_only_fallback", _hybrid_sql(_SINGLE.replace("embedding::DOUBLE[]", "NULL::DOUBLE[]"), 8,
                                           _HITS.replace("query_id, ", "")))
def keyword_only_fallback(t: Tables):
    return _hybrid_one(t, 8, False)


@plan("search_page", _hybrid_sql(_SINGLE, 20, "SELECT rank, chunk_id FROM h") + " AND rank > 10")
def search_page(t: Tables):
    return Q.search_page(_hybrid_one(t, 20), 2, 10).select("rank", "chunk_id")


@plan("win_rank_rrf", f"""WITH {_V}, q AS (SELECT e AS qe FROM v WHERE chunk_id = 2),
  r AS (SELECT chunk_id, row_number() OVER (ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS rank FROM v, q)
  SELECT chunk_id, rank, round(1.0::DOUBLE / (60 + rank), 6) AS score FROM r WHERE rank <= 16""")
def win_rank_rrf(t: Tables):
    return Q.vector_topk(doc_vectors(t), one_query(t, 2), 16).select(
        "chunk_id", "rank", F.round(S.rrf_term("rank"), 6).alias("score"))


_FUSE_SQL = f"""WITH {_V}, q AS (SELECT e AS qe FROM v WHERE chunk_id = 2),
  a AS (SELECT chunk_id, row_number() OVER (ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS rank FROM v, q),
  b AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), 'ing')),
  u AS (SELECT *, 'vector' AS src FROM a WHERE rank <= 16 UNION ALL SELECT *, 'keyword' FROM b WHERE rank <= 16)"""


def _recall_lists(t: Tables):
    vec = Q.vector_topk(doc_vectors(t), one_query(t, 2), 16).select("chunk_id", "rank")
    return vec, Q.keyword_topk(chunk_table(t), " Ing ", 16)


@plan("fused_score", f"{_FUSE_SQL} SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY 1")
def fused_score(t: Tables):
    return Q.fuse(list(_recall_lists(t)), []).select("chunk_id", F.round("score", 6).alias("score"))


@plan("union_recall", f"{_FUSE_SQL} SELECT chunk_id, count(*) AS n_lists, min(rank) AS best_rank FROM u GROUP BY 1")
def union_recall(t: Tables):
    a, b = _recall_lists(t)
    return a.unionByName(b).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_lists"), F.min("rank").alias("best_rank"))


@plan("skill_scoping", f"""WITH {M.LOGS_SQL}, s(skill, domain, days) AS (
    VALUES ('general', NULL, 7), ('fitness', 'click', 14), ('shopping', 'purchase', 7))
  SELECT skill, count(*) AS n FROM logs JOIN s ON s.domain IS NULL OR s.domain = logs.domain
  WHERE happened_at >= (SELECT max(ts) FROM events) - to_days(days) GROUP BY skill""")
def skill_scoping(t: Tables):
    # Windows per skill; the domains are those of the test table.
    skills = t.spark.createDataFrame([("general", None, 7), ("fitness", "click", 14), ("shopping", "purchase", 7)],
                                     "skill string, scope string, days int")
    logs = M.logs(t).select("domain", "happened_at")
    latest = F.broadcast(logs.agg(F.max("happened_at").alias("as_of")))        # one row
    inside = F.col("happened_at") >= F.col("as_of") - F.make_dt_interval(F.col("days"))
    scoped = logs.join(latest).join(
        F.broadcast(skills), (F.col("scope").isNull() | (F.col("scope") == F.col("domain"))) & inside)
    return scoped.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


@plan("context_assembly", """
  WITH p AS (SELECT user_id, string_agg('- ' || event_type || '/' || key || ': ' || value, chr(10) ORDER BY event_type, key) AS x
    FROM (SELECT user_id, event_type, 'last' AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT user_id, string_agg('- ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type, chr(10) ORDER BY r) AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1),
  h AS (SELECT conv_id AS user_id, string_agg('- [' || role || '] ' || replace(substring(text, 1, 120), chr(10), ' '), chr(10) ORDER BY turn) AS x
    FROM conversations WHERE turn < 6 GROUP BY 1)
  SELECT user_id, concat_ws(chr(10) || chr(10), '画像:' || chr(10) || p.x, '近期日志:' || chr(10) || l.x,
    '相关条目:' || chr(10) || h.x) AS context FROM p FULL JOIN l USING (user_id) FULL JOIN h USING (user_id)""")
def context_assembly(t: Tables):
    ev = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    profile = latest_per_key(ev, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", F.col("event_type").alias("domain"), F.lit("last").alias("key"),
        F.col("value").cast("string").alias("value"))
    logs = ev.select("user_id", "ts", "event_id", S.ts_text("ts").alias("happened_text"),
                     F.col("event_type").alias("content_text"))
    hits = t.conversations.filter(F.col("turn") < 6).select(      # a hit list of six per user
        F.col("conv_id").alias("user_id"), F.col("turn").alias("rank"), F.col("role").alias("title"),
        F.col("text").alias("content"))
    return T.context_assembly(profile, logs, hits, "user_id", [F.desc("ts"), F.desc("event_id")])


_SEARCH_HITS = _hybrid_sql(_BATCH, 8, "SELECT query_id, rank, chunk_id, domain FROM h")


@plan("search_context", f"""
  WITH p AS (SELECT user_id, string_agg('- ' || event_type || '/' || key || ': ' || value, chr(10) ORDER BY event_type, key) AS x
    FROM (SELECT user_id, event_type, 'last' AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT user_id, string_agg('- ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type, chr(10) ORDER BY r) AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1),
  s AS ({_SEARCH_HITS}),
  h AS (SELECT query_id AS user_id, string_agg('- [' || domain || '] ' || replace(substring(coalesce(text, ''), 1, 120),
      chr(10), ' '), chr(10) ORDER BY rank) AS x FROM s JOIN documents ON doc_id = chunk_id GROUP BY 1)
  SELECT user_id, concat_ws(chr(10) || chr(10), '画像:' || chr(10) || p.x, '近期日志:' || chr(10) || l.x,
    '相关条目:' || chr(10) || h.x) AS context FROM p FULL JOIN l USING (user_id) FULL JOIN h USING (user_id)""")
def search_context(t: Tables):
    """The context of ``context_assembly`` with what a hybrid search found: user n asks benchmark question n."""
    ev = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    newest = [F.desc("ts"), F.desc("event_id")]
    profile = latest_per_key(ev, ["user_id", "event_type"], newest).select(
        "user_id", F.col("event_type").alias("domain"), F.lit("last").alias("key"),
        F.col("value").cast("string").alias("value"))
    logs = ev.select("user_id", "ts", "event_id", S.ts_text("ts").alias("happened_text"),
                     F.col("event_type").alias("content_text"))
    found = Q.hybrid_search(chunk_table(t), doc_vectors(t), item_table(t), batch_queries(t), 8)
    hits = found.join(chunk_table(t).select("chunk_id", "content"), "chunk_id").select(
        F.col("query_id").alias("user_id"), "rank", F.col("domain").alias("title"), "content")
    return T.context_assembly(profile, logs, hits, "user_id", newest)


# ---- embedding ------------------------------------------------------------

@plan("text_embed", """
  SELECT doc_id AS id, 64::BIGINT AS dim, 1.0::DOUBLE AS norm FROM documents""")
def text_embed(t: Tables):
    out = Q.embed(t.documents.select(F.col("doc_id").alias("id"), "text"), "text", Q.HashEncoder)
    return out.select("id", F.size("embedding").cast("long").alias("dim"),
                      F.round(F.sqrt(S.dot("embedding", "embedding")), 4).alias("norm"))


@plan("reindex", """
  SELECT conv_id, turn, 'done' AS embed_status, 64::BIGINT AS dim FROM conversations""")
def reindex(t: Tables):
    out = Q.reindex(t.conversations.select("conv_id", "turn", F.col("text").alias("content")), Q.HashEncoder)
    return out.select("conv_id", "turn", "embed_status", F.size("embedding").cast("long").alias("dim"))


@plan("image_backfill", """
  SELECT CASE WHEN n_chars > 500 THEN 'done' ELSE 'skipped' END AS embed_status, count(*) AS n FROM documents GROUP BY 1""")
def image_backfill(t: Tables):
    paths = t.documents.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(
        F.col("n_chars") > 500, ".jpg").otherwise(".bin")).alias("media_path"))
    return Q.image_backfill(paths, Q.HashEncoder).groupBy("embed_status").agg(F.count(F.lit(1)).alias("n"))


# ---- links ----------------------------------------------------------------

LOW = 0.25      # the random test vectors are far apart

_NEAR_SQL = f"""{M.VECTORS_SQL},
  pr AS (SELECT item_id AS a, e AS qe FROM vectors WHERE chunk_id % 10 = 0),
  s AS (SELECT a, item_id AS b, chunk_id, list_dot_product(e, qe) AS sim, row_number() OVER (PARTITION BY a
      ORDER BY list_dot_product(e, qe) DESC, chunk_id) AS r FROM pr JOIN vectors ON item_id <> a),
  near AS (SELECT * FROM s WHERE r <= 40)"""

_LINKS_SQL = f"""{_NEAR_SQL},
  m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sim DESC, chunk_id) AS k FROM near),
  sc AS (SELECT a, b, avg(sim) AS score FROM m WHERE k <= 3 GROUP BY 1, 2 HAVING avg(sim) >= {LOW}),
  rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM sc),
  links AS (SELECT a AS item_a, b AS item_b, round_even(score, 4) AS score FROM rk WHERE k <= 3)"""


def profiles(t: Tables):
    """The profile vector of an item is its first chunk's vector."""
    return M.vectors(t).filter(F.col("chunk_id") % 10 == 0).select("item_id", "embedding")


def links_of(t: Tables):
    out = K.build_links(profiles(t), M.vectors(t), threshold=LOW)
    return out.select(F.col("item_id").alias("item_a"), F.col("related_id").alias("item_b"),
                      F.bround("score", 4).alias("score"))


@plan("vector_join", f"WITH {_NEAR_SQL} SELECT a AS item_id, chunk_id, round(sim, 6) AS sim FROM near")
def vector_join(t: Tables):
    p = profiles(t)
    near = K.knn_join(p.select(F.col("item_id").alias("qid"), F.col("item_id").alias("qgroup"),
                               F.col("embedding").alias("qvec")),
                      M.vectors(t).select(F.col("chunk_id").alias("cid"), F.col("item_id").alias("cgroup"),
                                          F.col("embedding").alias("cvec")), 40)
    return near.select(F.col("qid").alias("item_id"), F.col("cid").alias("chunk_id"), F.round("sim", 6).alias("sim"))


@plan("knn_visits")
def knn_visits(t: Tables):
    """Cells, visits and compared pairs of ``vector_join``, against all pairs."""
    p, v = profiles(t), M.vectors(t)
    return K.place(p.select(F.col("item_id").alias("qid"), F.col("item_id").alias("qgroup"),
                            F.col("embedding").alias("qvec")),
                   v.select(F.col("chunk_id").alias("cid"), F.col("item_id").alias("cgroup"),
                            F.col("embedding").alias("cvec")), 40).report()


@plan("vector_topk_lsh")
def vector_topk_lsh(t: Tables):
    """Likely neighbours of every 20th vector, and how many rows each was compared with."""
    v = t.embeddings.select(F.col("vec_id").cast("long").alias("cid"), F.col("embedding").alias("cvec"))
    asked = v.filter(F.col("cid") % 20 == 0).toDF("qid", "qvec")
    return lsh_topk(asked, v, 10).select("qid", "cid", F.round("sim", 6).alias("sim"), "rank", "compared")


@plan("build_links", f"WITH {_LINKS_SQL} SELECT * FROM links")
def build_links(t: Tables):
    return links_of(t)


@plan("win_topn_per_item", f"WITH {_LINKS_SQL} SELECT item_a, count(*) AS n, max(score) AS best FROM links GROUP BY 1")
def win_topn_per_item(t: Tables):
    return links_of(t).groupBy("item_a").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


#: A stored link table derived from the orders: customer pairs with scores, some not positive.
_STORED_SQL = """stored AS (SELECT o_custkey AS item_a, (o_orderkey * 7) % 1500 AS item_b,
    max(round_even(o_totalprice / 500000.0, 4) - 0.1)::DOUBLE AS score FROM orders GROUP BY 1, 2)"""


def stored_links(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("item_a"), ((F.col("o_orderkey") * 7) % 1500).alias("item_b")).agg(
        F.max(F.bround(F.col("o_totalprice") / 500000.0, 4) - 0.1).alias("score"))


_BOTH_SQL = f"""{_STORED_SQL}, two AS (SELECT item_a, item_b, max(score) AS score FROM (
    SELECT * FROM stored UNION ALL SELECT item_b, item_a, score FROM stored) GROUP BY 1, 2)"""


@plan("union_symmetric_links", f"WITH {_BOTH_SQL} SELECT item_a, item_b, round(score, 6) AS score FROM two")
def union_symmetric_links(t: Tables):
    return K.both_ways(stored_links(t)).withColumn("score", F.round("score", 6))


@plan("links_read", f"""WITH {_BOTH_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS k FROM two WHERE score > 0)
  SELECT item_a, item_b AS related_id, round(score, 6) AS score, coalesce(c_name, '#' || item_b) AS title
  FROM r LEFT JOIN customer ON c_custkey = item_b AND c_acctbal > 0 WHERE k <= 3""")
def links_read(t: Tables):
    items = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return K.links_read(stored_links(t), items).select("item_a", "related_id", F.round("score", 6).alias("score"), "title")


@plan("links_replace", f"""WITH {_STORED_SQL}
  SELECT item_a, item_b, round(score, 6) AS score FROM stored WHERE item_a % 3 <> 0
  UNION ALL SELECT o_custkey, o_custkey + 1, round_even(max(o_totalprice) / 600000.0::DOUBLE, 4)
    FROM orders WHERE o_custkey % 6 = 0 GROUP BY 1""")
def links_replace(t: Tables):
    again = t.customer.filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("item_a"))
    new = t.orders.filter(F.col("o_custkey") % 6 == 0).groupBy(F.col("o_custkey").alias("item_a")).agg(
        (F.max("o_totalprice") / 600000.0).alias("score")).withColumn("item_b", F.col("item_a") + 1)
    return K.replace_links(stored_links(t), new.select("item_a", "item_b", "score"), again).withColumn(
        "score", F.round("score", 6))


