"""Searches limited by domain, type and category, alone and together."""

import itertools

import pytest

from keepsake.operators import retrieval as Q


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], i % 4 or None) for i in range(24)]
    items = spark.createDataFrame(rows, "id long, domain string, type string, category_id long").repartition(3)
    vectors = spark.createDataFrame([(i, [1.0 - i / 50, (1 - (1 - i / 50) ** 2) ** 0.5], *r) for i, *r in rows],
                                    "chunk_id long, embedding array<float>, domain string, type string, category_id long")
    chunks = spark.createDataFrame([(i, i, "some words" if i % 5 == 0 else "other") for i in range(24)],
                                   "chunk_id long, item_id long, content string")
    return rows, chunks, vectors, items


@pytest.mark.parametrize("prefilter", [False, True])
def test_every_combination(spark, tables, prefilter):
    rows, chunks, vectors, items = tables
    wanted = list(itertools.product([None, "a"], [None, "y"], [None, 2]))
    q = spark.createDataFrame([(n, "words", [1.0, 0.0], *w) for n, w in enumerate(wanted)],
                              "query_id long, query string, qe array<float>, domain string, type string, category_id long")
    got = {}
    for r in sorted(Q.hybrid_search(chunks, vectors, items, q, 3, prefilter).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.item_id)
    for n, w in enumerate(wanted):
        ok = [i for i, *r in rows if all(x is None or x == y for x, y in zip(w, r))]
        near, named = ok[:6], [i for i in (ok if prefilter else range(24)) if i % 5 == 0][:6]
        score = {i: sum(1 / (60 + r.index(i) + 1) for r in (near, named) if i in r) for i in {*near, *named}}
        fused = sorted(score, key=lambda i: (-score[i], i not in near, i))[:6]
        assert got.get(n, []) == [i for i in fused if i in ok][:3], w
        if not prefilter:
            one = Q.hybrid_search_one(chunks, vectors, items, "words", q.filter(q.query_id == n).select("qe"), 3, *w)
            assert [r.item_id for r in one.orderBy("rank").collect()] == got.get(n, [])


def test_no_filter_columns_but_the_domain(spark, tables):
    _, chunks, vectors, items = tables
    q = spark.createDataFrame([(1, " ", [1.0, 0.0], None), (2, "words", None, "b")],
                              "query_id long, query string, qe array<float>, domain string")
    got = Q.hybrid_search(chunks, vectors, items, q, 3).collect()
    assert {r.query_id for r in got} == {2} and all(r.domain == "b" for r in got)
