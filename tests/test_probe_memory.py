"""Probes: the table of costs doesn't grow with the planes, and slices don't change the result."""

import numpy as np

from keepsake.operators import lsh


def test_costs_are_bounded():
    for bits in range(1, 63):
        rows = lsh.coded_rows(lsh.TABLES, bits, lsh.PROBES)
        assert rows * lsh.TABLES * 2 ** min(bits, lsh.TURNED) <= lsh.COSTS
    assert lsh.coded_rows(lsh.TABLES, 10, 1) == 1024 and lsh.coded_rows(1 << 30, 10, 2) == 1


def test_slices_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cid long, cvec array<double>").coalesce(1)
    q = c.filter("cid % 3 = 0").toDF("qid", "qvec")
    key = lambda r: (r.qid, r["rank"])      # noqa: E731
    whole = sorted(lsh.lsh_topk(q, c, 5, bucket_rows=4).collect(), key=key)
    monkeypatch.setattr(lsh, "COSTS", 1)
    assert lsh.coded_rows(lsh.TABLES, 7, lsh.PROBES) == 1
    assert sorted(lsh.lsh_topk(q, c, 5, bucket_rows=4).collect(), key=key) == whole and len(whole) > 300
