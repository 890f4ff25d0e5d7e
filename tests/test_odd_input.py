"""Ordinary data that once broke a query: flat frames, one-sample series, broken JSON and images, doubled keys."""

import html

import pytest
from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.functions import text as X
from keepsake.operators import mutate, retrieval
from keepsake.sources import files


def test_flat_frames_correlate_fully(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0, 2.0], [3.0, 3.0]),
                                ([], []), ([1.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.correlation("a", "b")).collect()] == [1.0, pytest.approx(1.0), 1.0, 1.0, 1.0]
    assert [r[0] for r in df.select(S.change_ratio("a", "b", 0.5)).collect()] == [0.0, 1.0, 1.0, 0.0, 0.0]


def test_character_references(spark):
    texts = ["caf&eacute; &#8217;x&mdash;", "&amp;lt; &lt;b&gt;", "&copy 2020 &notit; &nope; & &", "&#x41;&#66;&#0;",
             "&#150;&#xD800;&#99999999;", "no reference", "&hearts;&NotEqualTilde;", "", "a&b;c &ampx"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert [r[0] for r in df.select(X.unescape("t")).collect()] == [html.unescape(t) for t in texts] + [None]


def test_proposals_with_wide_spaces(spark):
    df = spark.createDataFrame([("建议新增　美食　其他",)], "t string")
    assert df.select(F.regexp_extract("t", X.STRONG_PROPOSAL, 1)).first()[0] == "美食"


def test_broken_images_are_skipped(spark):
    class Picky(retrieval.HashEncoder):
        def __call__(self, texts):
            if any("broken" in t for t in texts):
                raise OSError(texts)
            return super().__call__(texts)

    df = spark.createDataFrame([("a.jpg",), ("broken.png",), ("broken.bin",), (None,)], "media_path string")
    got = retrieval.image_backfill(df, Picky).select("media_path", "embed_status").collect()
    assert {r[0]: r[1] for r in got} == {"a.jpg": "done", "broken.png": "skipped", "broken.bin": "skipped",
                                         None: "skipped"}


def test_doubled_keys_stay_single(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, kept string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "e")], "id long, name string")
    got = sorted(tuple(r) for r in mutate.upsert_merge(old, new, ["id"]).collect())
    assert got == [(1, "a", "x"), (2, "d", "y"), (3, "e", None)]
    vectors = spark.createDataFrame([(1, [0.5]), (1, [0.7])], "chunk_id long, embedding array<double>")
    assert files.upsert_vectors(vectors.limit(0), vectors).count() == 1
    items = spark.createDataFrame([(1, None, None, None, "inbox")],
                                  "id long, category_id long, category_conf double, auto_note string, status string")
    twice = spark.createDataFrame([(1, 4, 0.5, "n"), (1, 5, 0.9, "m")],
                                  "id long, category_id long, confidence double, note string")
    (row,) = mutate.assign_category(items, twice).collect()
    assert (row.category_id, row.status) == (5, "filed")
    assert mutate.affected(old, F.col("name") == "a").first()[0] == 1
