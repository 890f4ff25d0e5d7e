"""Rules that share a substring."""

from pyspark.sql import functions as F

from keepsake.operators import joins as J
from keepsake.operators import keyword as K


def test_one_rule_for_each_substring_meets_the_titles(spark, monkeypatch):
    sizes, find = [], K.match_terms

    def watched(texts, text_id, text, terms, *more, **how):
        sizes.append(terms.count())
        return find(texts, text_id, text, terms, *more, **how)

    monkeypatch.setattr(K, "match_terms", watched)
    items = spark.range(20).select("id", F.lit("o").alias("owner_id"), F.lit("d").alias("domain"),
                                   F.lit("s").alias("source_type"), F.lit("a small hot ring").alias("title"))
    rules = spark.range(400).select(
        "id", (F.col("id") % 7).alias("priority"), F.concat(F.lit("p"), "id").alias("prompt_name"),
        F.lit(1).alias("enabled"), F.lit("keyword").alias("kind"),
        F.when(F.col("id") % 2 == 0, "small").otherwise("hot r").alias("target"))
    got = {(r.rule_id, r.priority) for r in J.match_rules(items, rules).collect()}
    assert got == {(6, 6)} and sizes == [2]
