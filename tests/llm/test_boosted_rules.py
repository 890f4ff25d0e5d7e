"""Boosted quality rules against plain counts, held-out labels and their own constraints."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsake.llm import boosted_rules as B
from keepsake.llm import kernels as K
from keepsake.llm.quality import held_out

TEXTS = [None, "", "   \n\t", "a", "a a a a", "a b c a b c a b", "x\nx\n\nx\r\n \n \n", "# * $ % & | < >", "é ü z é",
         "one two three\nfour one two three", "word " * 60, " ".join(f"w{i}" for i in range(60)), "a\x0bb\x1cc d"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated)]


def counts_of(texts):
    raw = [(t or "").encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    return B.measure(np.frombuffer(b"".join(raw), np.uint8), offsets)


def test_counts_of_odd_texts():
    counts, statistics = counts_of(TEXTS)
    assert counts.tolist() == [plain(t) for t in TEXTS]
    assert np.isfinite(statistics).all() and not statistics[:2].any()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab#\n \té\r", max_size=60), min_size=1, max_size=5))
def test_counts_of_made_texts(texts):
    assert counts_of(texts)[0].tolist() == [plain(t) for t in texts]


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in B.judge_documents(docs, labels).collect()}
    for row in docs.collect():
        want, mine = plain(row.text), got[row.doc_id]
        assert [mine[c] for c in B.COUNTS] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert mine.base_failed == failed and mine.kept == (not failed and mine.score >= B.THRESHOLD)


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = B.judge_documents(docs, labels).join(labels, "doc_id").filter(held_out()).select("score", "quality", "kept",
                                                                                              "base_failed")
    rows = judged.toPandas().sort_values("score")
    good = rows.quality.to_numpy() == 1
    rank = np.arange(1, len(rows) + 1)
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97
    passed = rows[~rows.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.98 and passed[passed.quality == 0].kept.mean() < 0.1


def test_score_never_rises_with_constrained_statistics():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(B.STATISTICS)))
    bad = [B.STATISTICS.index(s) for s in B.CONSTRAINTS]
    # labels that would have the score rise with a constrained statistic in places
    y = ((np.sin(9 * x[:, bad[0]]) + x[:, 0] - x[:, bad[1]] * (x[:, 5] > 0.5) + rng.normal(0, 0.2, 3000)) > 0.4) * 1.0
    forest = B.fit(x, y)
    assert len(forest.roots) == B.TREES and (forest.statistic == bad[0]).any()
    for s in bad:
        at = np.repeat(rng.random((40, x.shape[1])), 50, axis=0)
        at[:, s] = np.tile(np.linspace(-0.1, 1.1, 50), 40)
        steps = np.diff(forest.score(at).reshape(40, 50), axis=1)
        assert (steps <= 1e-12).all()


def test_flattened_trees_score_as_walked_ones():
    rng = np.random.default_rng(5)
    x = rng.random((500, len(B.STATISTICS)))
    forest = B.fit(x, (x[:, 6] + x[:, 0] > 1).astype(float), trees=5)

    def walk(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = (forest.left if row[forest.statistic[node]] <= forest.threshold[node] else forest.right)[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1, 2), (1, None, 1, 2), (1, "a " * 60, None, 2), (1, "a " * 60, None, 2),
                                  (2, " ".join(f"w{i}" for i in range(55)), 7, 2)],
                                 "doc_id long, text string, n_words int, score int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = sorted(B.judge_documents(docs, labels).collect(), key=str)
    assert len(rows) == 5 and all(r.score is None for r in rows)
    assert [r.kept for r in rows if r.doc_id == 2] == [True]
    assert [r.n_repeat_words for r in rows if r.doc_id == 1] .count(60) == 2
    assert B.judge_documents(docs.limit(0), labels).count() == 0
    assert B.judge_documents(docs, labels.limit(0)).count() == 5


@pytest.mark.parametrize("words", [400_000])
def test_one_very_long_text(spark, words):
    text = " ".join(f"w{i % 7919}" for i in range(words))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    row = B.judge(docs, None).first()
    assert row.n_words == words and row.n_repeat_words == words and row.base_failed
    assert K.SLICE_BYTES < len(text)
