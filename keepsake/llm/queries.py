"""Registered queries of this folder, over the whole given tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"
SEQUENCE = 1024
END_ID = 2
WINDOW = 13
CONTAMINATED_SHARE = 20
EDITED_SHARE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def op1_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), SEQUENCE, END_ID)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import near_duplicates

    classes = near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op3_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import language

    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import license_scan

    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import quality

    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    return decontaminate.contamination(found, CONTAMINATED_SHARE).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import token_counts

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > SEQUENCE)


def op8_block_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import html_main

    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op9_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import substrings

    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), WINDOW)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import fingerprints

    return fingerprints.edit_robustness(table(spark, sf_dir, "documents"), EDITED_SHARE)


def op11_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import boosted_rules

    return boosted_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_itemset_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepsake.llm import prefix_trie

    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_two_fit": op1_best_two_fit,
    "op2_order_minhash": op2_order_minhash,
    "op3_evidence_fusion": op3_evidence_fusion,
    "op4_diagonal_voting": op4_diagonal_voting,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_fm_index": op6_fm_index,
    "op7_token_counts": op7_token_counts,
    "op8_block_field": op8_block_field,
    "op9_level_doubling": op9_level_doubling,
    "op10_i_match": op10_i_match,
    "op11_boosted_rules": op11_boosted_rules,
    "op12_itemset_counting": op12_itemset_counting,
    "op13_prefix_trie": op13_prefix_trie,
}

OP9_SQL = r"""
  WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 12], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
  f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
  c AS (SELECT g.doc_id, list(g.p) AS ps FROM g JOIN f USING (h) WHERE g.doc_id > f.least GROUP BY g.doc_id),
  x AS (SELECT g.doc_id, unnest(range(g.p, g.p + 13)) AS i FROM g JOIN f USING (h) WHERE g.doc_id > f.least),
  r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM x GROUP BY doc_id),
  k AS (SELECT d.doc_id, d.w, r.gone FROM d LEFT JOIN r USING (doc_id)),
  o AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed,
               CASE WHEN gone IS NULL THEN w
                    ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM k)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
         sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
  FROM o"""

OP12_SQL = r"""
  WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
             FROM documents),
  s AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
        FROM d),
  g AS (SELECT lang, k, w[i:i + k - 1] AS ws
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
              FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, ws, f AS a FROM f WHERE k >= 2 AND f >= 100),
  x AS (SELECT c.lang, c.ws, c.k, c.a, n.n, j, l.f AS l, r.f AS r,
               (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
        JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:j] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[j + 1:]),
  w AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
  i AS (SELECT lang, ws[b:b + m - 1] AS ws, max(a) AS longer
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS b
              FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
  o AS (SELECT w.lang, array_to_string(w.ws, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM w LEFT JOIN i ON i.lang = w.lang AND i.ws = w.ws WHERE longer IS NULL OR 100 * longer < 100 * a)
  SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
  WHERE rank <= 2000"""

OP13_SQL = r"""
  WITH c AS (SELECT conv_id, list({r: coalesce(role, ''), x: coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, t, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                          lambda s: CAST(ascii(s) AS BIGINT))),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                                   lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4
          AS h FROM c),
  b AS (SELECT h.conv_id, coalesce(o.t[1:h.h], []) || h.t[h.h + 1:] AS t
        FROM h LEFT JOIN c o ON o.conv_id = h.conv_id - h.conv_id % 20),
  m AS (SELECT conv_id, d, len(t) AS n, t[1:d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM b)),
  p AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS e
        FROM m GROUP BY p, d),
  k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL),
  q AS (SELECT p.*, coalesce(n_children, 0) AS n_children,
               CASE WHEN p.d = 0 THEN 0
                    ELSE (n_convs - 1) * len(regexp_extract_all(p.p[p.d].x, '[^\x20\x09-\x0D]+')) END AS saved
        FROM p LEFT JOIN k ON k.d = p.d AND k.p = p.p),
  u AS (SELECT p[1:a] AS p, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM q) GROUP BY ALL)
  SELECT q.conv_id, CAST(q.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, q.n_convs,
         CAST(q.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
         CAST(u.saved_tokens AS BIGINT) AS saved_tokens, q.e AS ends_sha256
  FROM q JOIN u ON u.d = q.d AND u.p = q.p LEFT JOIN p o ON o.d = q.d - 1 AND o.p = q.p[1:q.d - 1]"""

ORACLES: dict[str, str] = {"op9_level_doubling": OP9_SQL, "op12_itemset_counting": OP12_SQL,
                           "op13_prefix_trie": OP13_SQL}
