"""Visits of the nearest-neighbour join."""

import numpy as np
from pyspark.sql import functions as F

from keepsake.operators import links as K


def test_a_query_is_kept_once_for_each_lot_not_for_each_cell(spark):
    """Random vectors: nearly every cell is visited."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, i // 10, [float(x) for x in r]) for i, r in enumerate(v)],
                                   "cid long, cgroup long, cvec array<float>")
    asked = corpus.filter(F.col("cid") % 100 == 0).toDF("qid", "qgroup", "qvec")
    placement = K.place(asked, corpus, 5)
    rows, cells = placement.visits.count(), placement.report().first().visits
    lots = placement.lots.count()
    assert 1 < lots <= 4 and rows <= 30 * lots and cells > 10 * rows
    got = {(r.qid, r.cid) for r in K.multiplied(placement, 5).collect()}
    exact = np.array(corpus.orderBy("cid").select("cvec").toPandas().cvec.tolist())
    want = set()
    for q in range(0, 3000, 100):
        sims = exact @ exact[q]
        sims[np.arange(3000) // 10 == q // 10] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-sims)[:5]}
    assert got == want
