"""Many-pattern substring matching: one pass over the texts for a whole set of terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Terms compiled into one automaton at a time, by characters. A larger term table is
#: matched in several passes, so no task ever holds more than this.
MAX_TERM_CHARS = 4_000_000

#: Up to this many distinct terms the match is a plain expression without Python.
FEW_TERMS = 16


def _matcher(terms: list[str]):
    """Function text -> contained terms."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {x for x in terms if x in text}
    automaton = ahocorasick.Automaton()
    for x in terms:
        automaton.add_word(x, x)
    automaton.make_automaton()
    return lambda text: {x for _, x in automaton.iter(text)} if terms else set()


def match_terms(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str,
                term: str, fold_case: bool = True) -> DataFrame:
    """All pairs (text id, term id) where the whole text contains the term.

    The term table is the small side (queries, rules). Equal terms are searched once. Its
    size is measured first: a handful of terms become plain ``contains`` expressions; more
    are shipped to the tasks in parts of at most ``MAX_TERM_CHARS`` characters, one scan of
    the texts per part. Lower-casing happens in Spark on both sides.
    """
    spark = texts.sparkSession
    fold = F.lower if fold_case else (lambda c: c)
    owners = terms.select(F.col(term_id), fold(F.col(term)).alias("term")).filter(
        F.coalesce("term", F.lit("")) != "")
    distinct = owners.select("term").distinct()
    few = [r.term for r in distinct.limit(FEW_TERMS + 1).collect()]
    source = texts.select(F.col(text_id), fold(F.col(text)).alias("_t")).filter(F.col("_t").isNotNull())
    if len(few) <= FEW_TERMS:
        found = F.array_compact(F.array(*[
            F.when(F.contains("_t", F.lit(x)), F.lit(x)) for x in few])) if few else F.array().cast("array<string>")
        hits = source.select(text_id, F.explode(found).alias("term"))
        return hits.join(owners, "term").select(text_id, term_id)
    size = distinct.agg(F.sum(F.length("term") + 32)).first()[0]
    parts = max(1, -(-int(size) // MAX_TERM_CHARS))
    schema = StructType([StructField(text_id, texts.schema[text_id].dataType), StructField("term", StringType())])
    out = None
    for part in range(parts):
        chosen = distinct if parts == 1 else distinct.filter(
            F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        table = spark.sparkContext.broadcast([r.term for r in chosen.collect()])

        def scan(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            find = _matcher(table.value)
            for batch in batches:
                pairs = [(i, q) for i, t in zip(batch[text_id], batch["_t"]) for q in find(t)]
                yield pd.DataFrame(pairs, columns=[text_id, "term"])

        hits = source.mapInPandas(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out.join(owners, "term").select(text_id, term_id)
