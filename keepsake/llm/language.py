"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence speak about a page: its text (likelihoods of hashed byte runs, fitted on a bounded sample of
labelled documents), the language its markup declares, the ending of its address, and where it comes from. The last
three are learned from the table itself by grouped aggregation: every page counts for the language its text suggests,
and the counts say how often a declared language or an address ending goes with each language, and what a host, its
registered domain, its ending and the whole web usually hold. Host counts are smoothed by the domain's share, the
domain's by the ending's, the ending's by the global one. A page's own count is taken out of everything it is judged by.
The posterior is the normalised product.

The text weighs at most ``TEXT_RUNS`` runs, whatever its length: neighbouring runs are not independent. One scan; all
counts are summed before the shuffle, and a hot host is one row of its count table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm import html_main as H
from keepsake.llm import kernels as K
from keepsake.llm.ranks import shared_write, smallest_hashes

SAMPLE_ROWS = 5_000
#: documents of each language that the sample has at least, as far as there are so many
LEAST_ROWS = 50
RUN, BUCKETS, TEXT_RUNS = 4, 1 << 15, 60.0
#: pseudo-counts of the level above, of an unseen value, and of byte runs
STRENGTH, UNSEEN, RUN_PRIOR = 8.0, 0.5, 0.5
LEVELS = ("suffix", "domain", "host")
_ASIDE = frozenset(("nav", "footer", "aside", "form", "button", "label"))
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every run of ``RUN`` letters, and n+1 row limits."""
    size = len(data) - RUN + 1
    count = np.maximum(np.diff(offsets) - RUN + 1, 0)
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = _LETTERS[data].astype(np.uint64)
    h = b[:size]
    for i in range(1, RUN):
        h = h * np.uint64(257) + b[i:i + size]
    h = (K.mix(h) >> np.uint64(49)).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[:size] - np.arange(size)
    return h[left >= RUN], np.r_[0, np.cumsum(count)]


@dataclass(frozen=True)
class TextModel:
    """Log-likelihoods of byte runs by language; its size depends on nothing but the number of languages."""

    languages: tuple[str, ...]
    runs: np.ndarray

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): tempered log-likelihoods; zeros without text."""
        h, limits = byte_runs(data, offsets)
        total = np.vstack([np.zeros(len(self.languages)), np.cumsum(self.runs[h], axis=0)])
        count = np.diff(limits)
        return (total[limits[1:]] - total[limits[:-1]]) * np.minimum(1.0, TEXT_RUNS / np.maximum(count, 1))[:, None]


def fit_text(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
             sample: int = SAMPLE_ROWS, least: int = LEAST_ROWS) -> TextModel:
    """Fit on the ``sample`` labelled documents with the smallest hash of their id (a documented bound).

    Of each language the ``least`` documents with the smallest hash are added, so that all languages are in the model;
    its size grows with their number only.
    """
    known = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(id).alias("h"), F.lower(lang).alias("lang"), F.col(text).alias("text"))
    rows = smallest_hashes(known, "h", sample, F.xxhash64("text"))
    tie = F.xxhash64("text").alias("tie")
    keys = known.select("lang", "h", tie).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy("h", "tie"))).filter(F.col("rank") <= least).drop("rank")
    # ``least`` keys a language: less than the model has
    own = known.select("h", "lang", "text", tie).join(F.broadcast(keys), ["lang", "h", "tie"], "left_semi")
    rows = rows.unionByName(own.drop("tie")).distinct()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in K.slices(batch, "text"):
                h, limits = byte_runs(*K.text_bytes(part.column("text")))
                for i, name in enumerate(part.column("lang").to_pylist()):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(h[limits[i]:limits[i + 1]], minlength=BUCKETS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             ["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    table = summed.toArrow()      # at most BUCKETS numbers for each of the sample's languages
    names = np.array(table.column("lang").to_pylist(), object)
    languages = tuple(sorted(set(names)))
    counts = np.zeros((BUCKETS, len(languages)))
    for i, name in enumerate(languages):
        own = names == name
        counts[table.column("bucket").to_numpy()[own], i] = table.column("n").to_numpy()[own]
    counts += RUN_PRIOR
    return TextModel(languages, np.log(counts / counts.sum(0)) if languages else counts)


def page_text(page: str) -> str:
    """Visible text that stands in nothing around an article."""
    return "\n".join(b.text for b in H.leaf_blocks(page) if not any(tag in _ASIDE for tag, _ in b.path))


def page_evidence(pages: DataFrame, model: TextModel, id: str = "page_id", url: str = "url",
                  source: str = "html") -> DataFrame:
    """``page_id, url, declared, evidence`` of every page (``evidence``: one number for each language)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(source).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "html", H.SLICE_BYTES):
                sources = [p or "" for p in part.column("html").to_pylist()]
                texts = pa.array([page_text(p) for p in sources], pa.string())
                found = [_LANG.search(p) for p in sources]
                values = shared.value.evidence(*K.text_bytes(texts))
                ends = np.arange(len(sources) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"),
                     pa.array([m[1].lower() if m else None for m in found], pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))],
                    ["page_id", "url", "declared", "evidence"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, declared string, "
                                "evidence array<double>")


def with_address(pages: DataFrame) -> DataFrame:
    """Add ``host``, ``domain`` (its last two labels), ``suffix`` (the last) and ``address`` (ending and language path)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    named = pages.withColumn("host", F.coalesce(host, F.lit("")))
    return named.withColumns({
        "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("host", r"([^.]+)$", 1),
        "address": F.concat(F.regexp_extract("host", r"([^.]+)$", 1), F.lit("/"), F.coalesce(path, F.lit("")))})


def fuse(pages: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Fuse the evidence of ``page_id, url, declared, evidence``; see ``identify`` for the result."""
    n = len(languages)
    each = range(n)
    own = F.array_position("evidence", F.array_max("evidence")).cast("int") - 1
    rows = with_address(pages).withColumns({"own": own, "declared": F.coalesce("declared", F.lit(""))})
    one = F.broadcast(rows.agg(*[F.coalesce(F.sum((F.col("own") == i).cast("long")), F.lit(0)).alias(f"all_{i}")
                                 for i in each], *[F.count_distinct(c).alias(f"kinds_{c}")
                                                   for c in ("declared", "address")]))      # one row
    judged = rows.join(one)
    for level in (*LEVELS, "declared", "address"):
        table = rows.groupBy(level).agg(*[F.sum((F.col("own") == i).cast("long")).alias(f"{level}_{i}")
                                          for i in each])
        judged = judged.join(table, level)
    mine = [(F.col("own") == i).cast("long") for i in each]

    def total(columns: list[Column]) -> Column:
        out = F.lit(0.0)
        for c in columns:
            out = out + c
        return out

    # from the whole web down to the host, each level smoothed by the one above, without the page itself
    counts = [F.col(f"all_{i}") - mine[i] for i in each]
    judged = judged.withColumn("sum_all", total(counts))
    prior = [(counts[i] + 1.0) / (F.col("sum_all") + float(n)) for i in each]
    for level in LEVELS:
        judged = judged.withColumns({f"prior_{level}_{i}": prior[i] for i in each})
        above = [F.col(f"prior_{level}_{i}") for i in each]
        counts = [F.col(f"{level}_{i}") - mine[i] for i in each]
        judged = judged.withColumn(f"sum_{level}", total(counts))
        prior = [(counts[i] + above[i] * STRENGTH) / (F.col(f"sum_{level}") + STRENGTH) for i in each]
    weights = []
    for i in each:
        value = F.log(prior[i]) + F.col("evidence")[i]
        for kind in ("declared", "address"):
            seen, all_ = F.col(f"{kind}_{i}") - mine[i], F.col(f"all_{i}") - mine[i]
            value = value + F.log((seen + UNSEEN) / (all_ + F.col(f"kinds_{kind}") * UNSEEN))
        weights.append(value)
    judged = judged.withColumns({"_weights": F.array(*weights)}).withColumn("_most", F.array_max("_weights"))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_position("_weights", F.col("_most")).cast("int")
    scale = F.aggregate("_weights", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most")))
    return judged.select("page_id", "url", F.element_at(names, best).alias("lang"), (1.0 / scale).alias("score"),
                         F.element_at(names, F.col("own") + 1).alias("text_lang"),
                         F.nullif("declared", F.lit("")).alias("declared_lang"), "host")


def identify(pages: DataFrame, documents: DataFrame, id: str = "page_id", url: str = "url",
             source: str = "html") -> DataFrame:
    """``page_id, url, lang, score`` (its posterior), ``text_lang, declared_lang, host`` of every page.

    Equal posteriors go to the language that comes first in the alphabet. A null or empty page has no text evidence; a
    null or strange address counts as the host "". Null ids and repeated rows come back each; other columns are
    ignored; an empty table gives an empty one. Without labelled documents the language is null and the score 0.
    """
    model = fit_text(documents)
    if not model.languages:
        return with_address(pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"))).select(
            "page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared_lang"), "host")
    return fuse(shared_write(page_evidence(pages, model, id, url, source)), model.languages)
