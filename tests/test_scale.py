"""The distributed forms against plain Python, with block sizes small enough to matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import blocks as B
from keepsake.operators import keyword as W
from keepsake.operators import fold
from keepsake.operators import joins as J
from keepsake.operators import links as K
from keepsake.operators import lsh
from keepsake.operators import ranges
from keepsake.operators import retrieval as Q
from keepsake.operators import series as R
from keepsake.sources import files as D
from keepsake.streaming import flows


@pytest.fixture(scope="module")
def walk(spark):
    """One hot series with most rows, a few small ones, ties and gaps in time."""
    rng = random.Random(7)
    rows, i = [], 0
    for key, n in ((1, 400), (2, 40), (3, 1), (None, 15)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0, 0.5, 1, 1, 20])
            rows.append((key, t, i, float(rng.choice([0, 1, 2, 5, 9]))))
            i += 1
    return rows, spark.createDataFrame(rows, "k long, ts double, id long, v double")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_index_and_running(walk):
    rows, df = walk
    blk = F.floor(F.col("ts") / 7)
    out = B.row_index(df, ["k"], ["ts", "id"], blk)
    out = B.running(out, ["k"], ["ts", "id"], blk, last={"hi": F.when(F.col("v") > 4, F.col("id"))}, sums={"s": F.col("v")})
    out = B.previous(out, ["k"], ["ts", "id"], blk, {"prev": F.col("v")})
    got = {r.id: (r.rn, r.hi, r.s, r.prev) for r in out.collect()}
    for series in by_key(rows).values():
        hi, total, prev = None, 0.0, None
        for n, (_, _, i, v) in enumerate(series, 1):
            hi = i if v > 4 else hi
            total += v
            assert got[i] == (n, hi, total, prev)
            prev = v


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_islands(walk, width):
    rows, df = walk
    blk = F.floor(F.col("ts") / width)
    out = B.islands(B.row_index(df, ["k"], ["ts", "id"], blk).filter("v > 0"), ["k"], "rn", blk,
                    lambda p, q: p - q > 1, {"lo": ("min", F.col("rn")), "n": ("sum", F.lit(1))})
    expect = []
    for k, series in by_key(rows).items():
        start = None
        for n, r in enumerate([*series, (k, 0, 0, 0.0)], 1):
            if r[3] > 0:
                start = start or n
            elif start:
                expect.append((k, start, n - start))
                start = None
    assert sorted(((r.k or 0), r.lo, r.n) for r in out.collect()) == sorted((k or 0, a, b) for k, a, b in expect)


def test_percentiles(walk):
    rows, df = walk
    mixed = df.withColumn("x", F.col("v") * F.col("ts") - 3)
    out = {r.k: r for r in B.exact_percentiles(mixed, ["k"], "x", {"a": 0.2, "b": 0.5, "c": 0.99}, total="n").collect()}
    for k, series in by_key(rows).items():
        x = [v * t - 3 for _, t, _, v in series]
        assert [out[k].a, out[k].b, out[k].c] == pytest.approx(list(np.percentile(x, [20, 50, 99])))
        assert out[k].n == len(x)
    picked = {r.k: r.m for r in B.rank_pick(mixed.filter("k is not null"), ["k"], "x", "m", F.floor(F.col("_total") / 2)).collect()}
    for k, series in by_key(rows).items():
        if k is not None:
            assert picked[k] == sorted(v * t - 3 for _, t, _, v in series)[len(series) // 2]


@pytest.mark.parametrize("block_rows", [3, 16, 1000])
def test_merge_segments_any_block(spark, block_rows):
    rng = random.Random(3)
    rows = []
    for key, n in ((1, 120), (2, 9)):
        t = 0.0
        for i in range(n):
            d = rng.choice([1.0, 2.0, 4.0])
            rows.append((key, t, t + d, i, "x" * rng.randint(0, 30)))
            t += d
    df = spark.createDataFrame(rows, "k long, start_s double, end_s double, seq long, text string")
    expect = []
    for key in (1, 2):
        start, text, end = None, "", None
        for _, a, b, _, x in [r for r in rows if r[0] == key]:
            start = a if start is None else start
            text, end = text + x, b
            if len(text) >= 60 or end - start >= 12:
                expect.append((key, start, end, text))
                start, text = None, ""
        if start is not None:
            expect.append((key, start, end, text))
    out = R.merge_segments(df, "k", F.floor(F.col("start_s") / 10), 60, 12.0, block_rows).collect()
    assert sorted(tuple(r) for r in out) == sorted(expect)


def test_spaced_points(spark):
    rng = random.Random(5)
    ts = sorted({round(rng.uniform(0, 60), 2) for _ in range(90)})
    df = spark.createDataFrame([(1, t) for t in ts], "k long, t double")
    kept = []
    for t in ts:
        if not kept or t - kept[-1] >= 1.0:
            kept.append(t)
    out = sorted(r.t for r in R.spaced(df, "k", "t", F.floor(F.col("t") / 5), 1.0, 8).collect())
    assert out == kept


def test_knn_join_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    v = centres[rng.integers(0, 6, 300)] + 0.1 * rng.normal(size=(300, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    group = np.where(np.arange(300) < 100, 0, np.arange(300) // 5)      # one group holds a third
    c = spark.createDataFrame([(i, int(group[i]), v[i].tolist()) for i in range(300)],
                              "cid long, cgroup long, cvec array<float>")
    q = c.filter("cid % 4 = 0").select(F.col("cid").alias("qid"), F.col("cgroup").alias("qgroup"), F.col("cvec").alias("qvec"))
    sims = v.astype(float) @ v.astype(float).T
    expect = {(i, int(j)) for i in range(0, 300, 4) for j in sorted(
        np.flatnonzero(group != group[i]), key=lambda j: (-sims[i, j], j))[:7]}
    for kw in ({"block_rows": 5}, {"block_rows": 20}, {}):
        out = K.knn_join(q, c, 7, **kw)
        assert {(r.qid, r.cid) for r in out.collect()} == expect
    for few in (1, 2, 3, 9):        # the same plan for any number of rows
        some = c.filter(F.col("cid") < few)
        got = {(r.qid, r.cid) for r in K.knn_join(q, some, 7).collect()}
        assert got == {(i, int(j)) for i in range(0, 300, 4) for j in sorted(
            [j for j in range(few) if group[j] != group[i]], key=lambda j: (-sims[i, j], j))[:7]}
    assert K.knn_join(q, c.limit(0), 7).count() == 0 and K.knn_join(q.limit(0), c, 7).count() == 0


def _clustered(n, dim=32, near=20, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // near, dim))
    v = centres[rng.integers(0, n // near, n)] + 0.3 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _vectors(spark, v):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"cid": np.arange(len(v)), "cvec": list(v)}),
                                 "cid long, cvec array<float>").repartition(8)


def _nearest(v, ids, k):
    sims = v[ids].astype(float) @ v.astype(float).T
    sims[np.arange(len(ids)), ids] = -9
    return {int(i): np.lexsort((np.arange(len(v)), -sims[r]))[:k].tolist() for r, i in enumerate(ids)}


def test_two_levels_of_cells_skip_most_pairs(spark):
    report = {}
    for n in (1500, 6000):
        v = _clustered(n, 16, 100)      # about as many clusters as cells
        c = _vectors(spark, v).withColumn("cgroup", F.col("cid"))
        q = c.filter("cid % 20 = 0").select(F.col("cid").alias("qid"), F.col("cid").alias("qgroup"), F.col("cvec").alias("qvec"))
        placement = K.place(q, c, 5)
        got = {}
        for r in sorted(K.multiplied(placement, 5).collect(), key=lambda r: (r.qid, -r.sim, r.cid)):
            got.setdefault(r.qid, []).append(r.cid)
        assert got == _nearest(v, np.arange(0, n, 20), 5)
        report[n] = placement.report().first()
    print(report)
    assert all(r.pairs < 0.5 * r.all_pairs for r in report.values())
    assert report[6000].cells > 1.5 * report[1500].cells


def test_hashed_neighbours_recall(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    compared = {}
    for name, v in (("given", np.array([r.embedding for r in given], np.float32)), ("small", _clustered(3000)),
                    ("large", _clustered(24000))):
        c = _vectors(spark, v)
        ids = np.arange(0, len(v), 20)[:300]
        q = c.filter((F.col("cid") % 20 == 0) & (F.col("cid") < 6000)).toDF("qid", "qvec")
        want, got = _nearest(v, ids, 10), {int(i): [] for i in ids}
        rows = lsh.lsh_topk(q, c, 10).collect()
        for r in rows:
            got[r.qid].append(r.cid)
        assert np.mean([len(set(want[i]) & set(got[i])) / 10 for i in want]) >= 0.9, name
        compared[name] = np.mean([r.compared for r in rows])
    assert compared["large"] < 2 * compared["small"]        # eight times the rows


def test_hashed_neighbours_of_equal_vectors(spark):
    v = _clustered(900)
    v[::3] = v[0]                                           # a third of all rows
    c = _vectors(spark, v)
    q = c.filter("cid % 90 = 0").toDF("qid", "qvec")
    got = {}
    for r in sorted(lsh.lsh_topk(q, c, 8, block_rows=50).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.cid)
    assert got == _nearest(v, np.arange(0, 900, 90), 8)
    none = spark.createDataFrame([(1, None)], "qid long, qvec array<float>")
    assert lsh.lsh_topk(none, c, 3).count() == 0 and lsh.lsh_topk(q, c.limit(0), 3).count() == 0


def test_probes_cross_the_nearest_planes_first():
    margin = np.array([[[0.5, -0.1, 0.2]]])
    code = np.array([[0b101]])
    assert lsh.probe_codes(code, margin, 4)[0, 0].tolist() == [0b101, 0b111, 0b001, 0b011]
    assert sorted(lsh.probe_codes(code, margin, 99)[0, 0].tolist()) == list(range(8))


def test_knn_scan_scopes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist(), "ab"[i % 2]) for i in range(60)],
                               "chunk_id long, embedding array<float>, domain string").repartition(5)
    q = spark.createDataFrame([(0, v[0].tolist(), None), (1, v[1].tolist(), "a")], "query_id long, qe array<float>, domain string")
    sims = v.astype(float) @ v.astype(float).T
    out = sorted((r.query_id, r["rank"], r.chunk_id) for r in Q.knn_scan(df, q, 5, scope="domain").collect())
    expect = [(0, n + 1, int(j)) for n, j in enumerate(np.argsort(-sims[0])[:5])]
    expect += [(1, n + 1, int(j)) for n, j in enumerate([j for j in np.argsort(-sims[1]) if j % 2 == 0][:5])]
    assert out == expect


@pytest.mark.parametrize("few,chars", [(100, 4_000_000), (0, 4_000_000), (0, 40)])
def test_match_terms(spark, monkeypatch, few, chars):
    monkeypatch.setattr(W, "FEW_TERMS", few)
    monkeypatch.setattr(W, "MAX_TERM_CHARS", chars)
    texts = ["The Quick fox", "quicker", "nothing", None, "über THE"]
    terms = ["quick", "THE", "the", "", "zzz", "Über"]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    q = spark.createDataFrame(list(enumerate(terms)), "q long, w string")
    expect = {(i, j) for i, x in enumerate(texts) for j, w in enumerate(terms) if x and w and w.lower() in x.lower()}
    assert {(r.i, r.q) for r in W.match_terms(t, "i", "t", q, "q", "w").collect()} == expect


def test_interval_overlap(spark):
    rng = random.Random(9)
    spans = lambda n: [(rng.randint(1, 2), a, a + rng.choice([0.0, 1.0, 7.0, 40.0])) for a in (
        round(rng.uniform(0, 100), 1) for _ in range(n))]
    a, b = spans(60), spans(60)
    da = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i long, k long, a0 double, a1 double")
    db = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "j long, k long, b0 double, b1 double")
    out = J.interval_overlap(da, db, "k", ("a0", "a1"), ("b0", "b1"), 5.0)
    got = sorted((r.i, r.j) for r in out.collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                         if x[0] == y[0] and y[2] > x[1] and y[1] < x[2])


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = B.top_n(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark):
    from keepsake.operators.lookup import list_items
    from keepsake.plans import Tables
    from keepsake.plans import mapping as M

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = Q.vector_topk(M.vectors(t), t.embeddings.limit(1).select(F.col("embedding").alias("qe")), 3,
                         F.col("chunk_id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(vec_id,5)" in plan
    plan = list_items(M.items_orders(t), M.chunks_lines(t).select("item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


# ---- streams and writes ---------------------------------------------------

def test_incremental_ingest_replay(spark, tmp_path):
    known, new, src = (str(tmp_path / n) for n in ("known", "new", "src"))
    spark.createDataFrame([("a",)], "key string").write.parquet(f"{known}/seed")
    spark.createDataFrame([("a",), ("b",), ("b",)], "key string").write.parquet(src)
    write = flows.incremental_ingest(known, new, "key")
    stream = lambda: spark.readStream.schema("key string").parquet(src)
    flows.run_batches(stream(), write, str(tmp_path / "s1"))
    read = lambda: sorted(r.key for r in spark.read.option("recursiveFileLookup", "true").schema("key string").parquet(new).collect())
    assert read() == ["b"]
    write(spark.read.parquet(src), 0)               # the same batch again leaves the same result
    assert read() == ["b"]
    spark.createDataFrame([("b",), ("c",)], "key string").write.mode("append").parquet(src)
    flows.run_batches(stream(), write, str(tmp_path / "s1"))
    assert read() == ["b", "c"]


def test_first_ingest_needs_no_registry(spark, tmp_path):
    known, new, src = (str(tmp_path / n) for n in ("known", "new", "src"))
    spark.createDataFrame([("a",), ("b",), ("b",)], "key string").write.parquet(src)
    flows.run_batches(spark.readStream.schema("key string").parquet(src), flows.incremental_ingest(known, new, "key"),
                      str(tmp_path / "s"))
    got = spark.read.option("recursiveFileLookup", "true").schema("key string").parquet(new)
    assert sorted(r.key for r in got.collect()) == ["a", "b"]


def test_stream_merge_flushes_idle_series(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "series_id long, start_s double, end_s double, text string, at timestamp"
    sql = "select * from values (%s) t(series_id, start_s, end_s, text, at)"
    for n, row in enumerate((
            "1L, 0D, 5D, 'ab', timestamp'2024-01-01 00:00:00'", "1L, 5D, 9D, 'cd', timestamp'2024-01-01 00:00:10'",
            "2L, 0D, 60D, 'long', timestamp'2024-01-01 02:00:00'")):
        spark.sql(sql % row).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = flows.run_once(flows.merge_segments(stream, arrival="at"), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = {tuple(r) for r in out.collect()}
    assert (2, 0.0, 60.0, "long") in rows               # full by its length
    assert (1, 0.0, 9.0, "abcd") in rows                # flushed by the watermark


def test_write_and_replace(spark, tmp_path):
    items = spark.createDataFrame([(1, "u", "en"), (2, "u", "en"), (3, "w", "fr")], "id long, source_ref string, domain string")
    chunks = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "item_id long, seq int, content string")
    kept = D.newest_per_source(items)
    D.write_items_chunks(kept, D.children_of(chunks, kept), str(tmp_path))
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/items").collect()) == [2, 3]
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/chunks").collect()) == ["b", "c"]


def test_sheet_lines_have_no_cap(spark):
    from keepsake.operators import textual
    rows = spark.range(1000).selectExpr("'a' AS sheet", "id", "CAST(NULL AS STRING) AS none")
    got = textual.sheet_lines(rows, "sheet", ["id"], [F.col("id"), F.col("none")], F.floor(F.col("id") / 100)).collect()
    assert {r["line_no"]: r["line"] for r in got} == {i + 1: str(i) for i in range(1000)}


def _kept(ts, gap):
    kept = []
    for t in ts:
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


def test_evenly_spaced_points_take_few_rounds(spark, monkeypatch):
    """No block forgets its entry here: 196 blocks are still eight rounds, not 196."""
    rounds = []
    whole = fold.reliable
    monkeypatch.setattr(fold, "reliable", lambda df: rounds.append(1) or whole(df))
    df = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("t"))
    out = sorted(r.t for r in R.spaced(df, "k", "t", F.floor(F.col("t") / 5000), 7.0).collect())
    assert out == [float(t) for t in range(0, 100_000, 7)]
    assert len(rounds) <= 20


@pytest.mark.parametrize("gap,block_rows", [(40.0, 4), (3.5, 4), (1000.0, 8), (0.0, 4)])
def test_groups_longer_than_blocks(spark, gap, block_rows):
    rng = random.Random(int(gap))
    rows = [(k, round(rng.uniform(0, 300), 1)) for k in (1, 2, None) for _ in range(120 if k == 1 else 30)]
    df = spark.createDataFrame(rows, "k int, t double").repartition(4)
    out = sorted((r.k or 0, r.t) for r in R.spaced(df, "k", "t", F.floor(F.col("t") / 50), gap, block_rows).collect())
    assert out == sorted((k or 0, t) for k in (1, 2, None) for t in _kept(sorted({t for j, t in rows if j == k}), gap))


def test_segments_that_end_out_of_order(spark):
    """The end of a segment may lie before the end of an earlier one; weights may be zero."""
    rng = random.Random(11)
    rows = [(1, float(i), float(i) + rng.choice([0.5, 3.0, 9.0]), i, "x" * rng.choice([0, 0, 1, 7])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, start_s double, end_s double, seq long, text string")
    want, held = [], []
    for r in rows:
        held.append(r)
        if sum(len(h[4]) for h in held) >= 25 or r[2] - held[0][1] >= 11:
            want.append((1, held[0][1], r[2], "".join(h[4] for h in held)))
            held = []
    if held:
        want.append((1, held[0][1], held[-1][2], "".join(h[4] for h in held)))
    out = R.merge_segments(df, "k", F.floor(F.col("start_s") / 10), 25, 11.0, 4).collect()
    assert sorted(tuple(r) for r in out) == sorted(want)
    assert R.merge_segments(df.limit(0), "k", F.floor(F.col("start_s") / 10)).count() == 0


def test_ranges_spread_one_hot_hour(spark):
    """One series holds most rows, nine in ten of them in one hour: no range holds much more than its share."""
    rng = random.Random(2)
    rows = [(1, rng.uniform(0, 3600) if rng.random() < 0.9 else rng.uniform(0, 1e6), i, float(i % 7)) for i in range(20000)]
    rows += [(k, float(t), t, 1.0) for k in (2, 3, None) for t in range(50)]
    df = spark.createDataFrame(rows, "k int, ts double, id long, value double").repartition(5)
    out = ranges.ranged(df, "k", ["ts", "id"], ["value"], parts=16)
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(rows) / 16
    got = {(r.k, r.id): (r.rn, r.gap, r.part) for r in out.collect()}
    for key in (1, 2, 3, None):
        own = sorted((t, i) for k, t, i, _ in rows if k == key)
        assert [got[key, i][0] for _, i in own] == list(range(1, len(own) + 1))
        gaps = [None] + [b[0] - a[0] for a, b in zip(own, own[1:])]
        assert [got[key, i][1] for _, i in own] == gaps
        parts = [got[key, i][2] for _, i in own]
        assert parts == sorted(parts)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_events_do_not_depend_on_ranges(spark, parts):
    rng = random.Random(8)
    rows = [(k, i * 0.2, i, rng.choice([0.01, 0.02, 0.02, 0.5 if i % 50 < 20 else 0.02])) for k in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ts double, id long, value double")
    one = sorted(tuple(r) for r in R.detect_events(df.coalesce(1), "k").collect())
    numbered = ranges.ranged(df, "k", ["ts", "id"], ["value"], parts=parts)
    assert sorted(tuple(r) for r in R.detect_events(numbered, "k").collect()) == one and len(one) > 4
    still = sorted(tuple(r) for r in R.detect_settle(numbered, "k").collect())
    assert still == sorted(tuple(r) for r in R.detect_settle(df, "k").collect())
    assert R.detect_events(df.limit(0), "k").count() == 0


def test_events_read_the_series_once(spark):
    """The source is numbered and written once; what follows reads that table."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").alias("k"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("id"),
        F.col("event_id").cast("double").alias("value"))
    plan = R.detect_events(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "testdata" not in plan


def _plain_overlap(a, b):
    return sorted((i, j) for i, (k, x0, x1) in enumerate(a) for j, (m, y0, y1) in enumerate(b)
                  if k == m and k is not None and None not in (x0, x1, y0, y1) and y1 > x0 and y0 < x1)


@pytest.mark.parametrize("width,cell_rows", [(1.0, 4096), (60.0, 4), (1e-3, 50)])
def test_overlaps_of_spans_of_any_length(spark, width, cell_rows):
    rng = random.Random(int(width))

    def spans(n):
        out = [(rng.choice([1, 1, 1, 2, None]), t, t + rng.choice([0.0, 0.5, 7.0, 100.0, 3e4, -2.0]))
               for t in (round(rng.uniform(0, 900), 1) for _ in range(n))]
        return out + [(1, -1e8, 3.2e8), (1, None, 3.0), (2, 5.0, None)]      # ten years and more

    a, b = spans(120), spans(90)
    da = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "k int, a0 double, a1 double, i long")
    db = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "k int, b0 double, b1 double, j long")
    out = J.interval_overlap(da, db, "k", ("a0", "a1"), ("b0", "b1"), width, cell_rows)
    assert out.columns == ["k", "a0", "a1", "i", "b0", "b1", "j"]
    assert sorted((r.i, r.j) for r in out.collect()) == _plain_overlap(a, b)
    assert J.interval_overlap(da.limit(0), db, "k", ("a0", "a1"), ("b0", "b1"), width).count() == 0


def test_a_long_span_is_stored_in_two_cells(spark):
    df = spark.createDataFrame([(1, 17.3, 17.3 + 3.2e8), (2, 0.0, 3600.0), (3, 9.9, 9.9)], "k int, a0 double, a1 double")
    own = df.withColumn("own", J._span_level("a0", "a1", 1.0))
    held = J.span_cells(own, "a0", "a1", 1.0, F.array("own")).groupBy("k").count().collect()
    assert all(r["count"] <= 2 for r in held) and len(held) == 3
