"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.functions import text as X
from keepsake.operators import classify as C
from keepsake.operators import joins as J
from keepsake.operators import links as K
from keepsake.operators import mutate as U
from keepsake.operators import retrieval as Q
from keepsake.operators import series as R
from keepsake.sources import capture as P
from keepsake.sources import files as D


def series(spark, values, step=0.2, key=1):
    rows = [(key, i * step, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id long, ts double, id long, value double")


def block():
    return F.floor(F.col("ts") / 2.0)       # two seconds: every series spans several blocks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- series ---------------------------------------------------------------

def test_events_two_bursts(spark):
    s = series(spark, [0.01] * 10 + [0.6] * 15 + [0.01] * 15 + [0.6] * 10)
    stats = R.series_stats(s, "series_id").first()
    assert stats.floor == pytest.approx(0.01)
    assert stats.enter == pytest.approx(0.05)
    assert stats.exit == pytest.approx(0.015)
    out = sorted((r.start_s, r.end_s) for r in R.detect_events(s, "series_id").collect())
    assert len(out) == 2
    assert abs(out[0][0] - 2.0) <= 0.3
    assert abs(out[-1][1] - 10.0) <= 0.3


def test_events_flat_and_empty(spark):
    assert R.detect_events(series(spark, [0.0] * 50), "series_id").isEmpty()
    assert R.detect_events(series(spark, []), "series_id").isEmpty()


def test_settle_between_motion(spark):
    out = R.detect_settle(series(spark, [0.5] * 20 + [0.02] * 15 + [0.5] * 20), "series_id").collect()
    assert len(out) == 1
    assert abs(out[0].lo - 4.0) <= 0.4
    assert abs(out[0].hi - 6.8) <= 0.4


def test_settle_too_short(spark):
    assert R.detect_settle(series(spark, [0.5] * 20 + [0.02] * 2 + [0.5] * 20), "series_id").isEmpty()


def bands(spark, rows):
    return spark.createDataFrame([(1, b, r, m) for b, r, m in rows],
                                 "series_id long, band long, text_rate double, motion double")


def test_bands_active_and_static(spark):
    out = R.classify_bands(bands(spark, [(0, 0.9, 0.056), (12, 0.8, 0.385), (19, 0.4, 0.174)]), "series_id").collect()
    first = [r for r in out if r["rank"] == 1][0]
    assert (first.y0, first.y1) == (0.5, 13 / 24)
    out = R.classify_bands(bands(spark, [(0, 0.9, 0.056), (12, 0.7, 0.385)]), "series_id").collect()
    assert {(r.role, r.y0) for r in out} == {("active", 0.5), ("static", 0.0)}


@pytest.mark.parametrize("rows,reason", [
    ([(0, 0.1, 0.5)], "no_text"), ([(0, 0.9, 0.0), (3, 0.9, 0.0)], "no_motion"),
    ([(0, 0.9, 0.20), (3, 0.9, 0.35)], "not_separated")])
def test_bands_undecidable(spark, rows, reason):
    out = R.classify_bands(bands(spark, rows), "series_id").collect()
    assert {r.reason for r in out} == {reason}
    assert all(r.role != "active" for r in out)


def units(spark, events, settle):
    e = spark.createDataFrame([(1, *map(float, x)) for x in events], "series_id long, start_s double, end_s double")
    s = spark.createDataFrame([(1, *map(float, x)) for x in settle], "series_id long, lo double, hi double")
    return R.build_units(e, s, "series_id")


def test_units_with_speech(spark):
    u = units(spark, [(0, 3), (8.5, 10.2)], [])
    speech = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.2, 2.5, "b"), (1, 2.6, 4.0, "c"), (1, 9.0, 10.0, "d")],
                                   "series_id long, seg_start double, seg_end double, text string")
    pairs = R.unit_speech(u, speech, "series_id", 1.0).orderBy("start_s", "seg_start").collect()
    assert [(r.start_s, r.text) for r in pairs] == [(0.0, "a"), (0.0, "b"), (0.0, "c"), (8.5, "d")]
    assert {r.start_frame for r in u.collect()} == {0.0, 8.5}


def test_units_settle_window(spark):
    assert units(spark, [(0, 2)], [(2.4, 3.6)]).first().end_frame == 3.6
    assert units(spark, [(0, 2)], [(9, 11)]).first().end_frame == 2.0


def test_units_short_dropped_and_rounded(spark):
    assert [r.start_s for r in units(spark, [(0, 0.1), (1, 3)], []).collect()] == [1.0]
    out = {r.start_frame: r.end_frame for r in units(spark, [(0, 3.14159), (8.500000001, 10.2)], []).collect()}
    assert out == {0.0: 3.14, 8.5: 10.2}


def test_even_sample(spark):
    rows = R.indexed(series(spark, range(48)), "series_id", ["ts", "id"], block())
    kept = sorted(r.i for r in R.even_sample(rows, "series_id", 24).collect())
    assert kept == sorted({round(i * 47 / 23) for i in range(24)})
    assert len(kept) == 24 and kept[0] == 0 and kept[-1] == 47


@pytest.mark.parametrize("n,m", [(121, 120), (1000, 7), (50, 49), (13, 5), (5, 5), (3, 9)])
def test_even_sample_is_exact(spark, n, m):
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
    expect = sorted({round(i * (n - 1) / (m - 1)) for i in range(m)}) if n > m else list(range(n))
    assert sorted(r.i for r in R.even_sample(rows, "k", m).collect()) == expect


@pytest.mark.parametrize("mode,band,speech,expect", [
    ("auto", True, 0.07, (True, True, True)), ("auto", True, 0.98, (True, False, True)),
    ("auto", False, 0.85, (False, False, False)), ("auto", False, 0.02, (False, True, False)),
    ("off", True, 0.02, (False, False, False)), ("on", False, 0.9, (True, True, False))])
def test_quadrant(spark, mode, band, speech, expect):
    out = R.decide_quadrant(F.lit(band), F.lit(speech), mode)
    row = spark.range(1).select(*[c.alias(n) for n, c in out.items()]).first()
    assert (row.ocr_band, row.ocr_full, row.unitize) == expect


def test_visual_event_frames(spark):
    v = [0.02] * 600
    v[200:230] = [0.9] * 30
    v[450:470] = [0.9] * 20
    s = series(spark, v)
    settle = spark.createDataFrame([(1, 20.0, 38.0), (1, 100.0, 118.0)], "series_id long, lo double, hi double")
    out = [r.t for r in R.visual_event_frames(s, settle, "series_id", 20).orderBy("t").collect()]
    assert len(out) <= 20
    for lo, hi in ((39.5, 42.5), (89.5, 92.5), (28, 30)):
        assert any(lo <= t <= hi for t in out)
    assert R.visual_event_frames(s, settle, "series_id", 5).count() <= 5


def test_band_exclusion(spark):
    lines = spark.createDataFrame([("mark", .023, .054), ("text", .512, .549)], "t string, y0 double, y1 double")
    bands_ = spark.createDataFrame([(0.0, 0.05)], "lo double, hi double")
    assert [r.t for r in J.outside_bands(lines, bands_, "y0", "y1").collect()] == ["text"]
    assert J.outside_bands(lines, bands_.filter("lo > 1"), "y0", "y1").count() == 2


def test_ad_segments(spark):
    rows = [(1, float(x), "接广了") for x in (175, 176, 180, 178, 184, 339, 349)] + [(1, 100.0, "nice")]
    c = spark.createDataFrame(rows, "stream long, ts double, text string")
    got = lambda n: sorted((r.start_s, r.end_s) for r in R.ad_segments(c, "stream", 10.0, n).collect())
    assert got(2) == [(170.0, 190.0)]
    assert got(3) == [(170.0, 180.0)]
    assert R.ad_segments(c.filter("ts < 0"), "stream").isEmpty()


def test_merge_segments(spark):
    rows = [(1, i * 5.0, i * 5.0 + 5, i, f"t{i:02d}") for i in range(30)]
    s = spark.createDataFrame(rows, "series_id long, start_s double, end_s double, seq long, text string")
    out = R.merge_segments(s, "series_id", F.floor(F.col("start_s") / 10), 60, 20.0).orderBy("start_s").collect()
    assert 5 <= len(out) < 15
    assert out[0].start_s == 0 and out[-1].end_s == 150
    assert "".join(r.text for r in out) == "".join(r[4] for r in rows)


def test_profile_check(spark):
    base = dict(cached_band=.5, band=.5, cached_hz=.2, hz=.2, cached_speech=.08, speech=.08)
    cases = [({}, "ok"), ({"band": .72}, "band_shift"), ({"speech": .75}, "speech"), ({"band": None}, "no_band"),
             ({"cached_band": None}, "no_cache"), ({"hz": .9}, "event_rate")]
    for change, expect in cases:
        row = {**base, **change}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
        assert df.select(R.profile_check().alias("v")).first().v == expect


# ---- clips and classification ---------------------------------------------

def test_clip_snap(spark):
    bounds = spark.createDataFrame([(1, float(b)) for b in (0, 5, 12, 20)], "item_id long, b double")
    raw = [(0.4, 4.6), (6, 11.5), (-3, 2), (5, 5.1), (3, 9)]
    clips = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(raw)],
                                  "item_id long, clip_id long, start_ts double, end_ts double")
    out = C.snap_clips(clips, bounds, "item_id", 4.0).collect()
    assert sorted(r.start_ts for r in out) == [0, 0, 5]
    assert sorted(r.end_ts for r in out) == [5, 12, 12]
    plain = C.snap_clips(clips, bounds.filter("item_id > 1"), "item_id", 4.0).collect()
    assert {(r.start_ts, r.end_ts) for r in plain} == {(0.4, 4.6), (6, 11.5), (3, 9)}


def test_clips_from_units(spark):
    u = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 22.0), (1, 22.0, 30.0)], "item_id long, lo double, hi double")
    n = C.number_units(u, "item_id", ["lo"], F.floor(F.col("lo") / 10))
    refs = spark.createDataFrame([(1, 0, "1", "2"), (1, 1, "3", "3"), (1, 2, "9", "9"), (1, 3, "2", "1")],
                                 "item_id long, ref_id long, from_unit string, to_unit string").withColumns({
                                     "kind": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    out = C.clips_from_units(refs, n, "item_id").orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts) for r in out] == [(0, 22), (22, 30)]


def test_rules_first_match(spark):
    rules = spark.createDataFrame(
        [(1, "up", "123", 5, "p1", 1), (2, "domain", "shopping", 3, "p2", 1), (3, "up_set", "1,2, 2345", 1, "p3", 1),
         (4, "keyword", "race", 9, "p4", 1), (5, "up", "123", 99, "off", 0)],
        "id long, kind string, target string, priority int, prompt_name string, enabled int")
    items = spark.createDataFrame(
        [(1, "123", "shopping", "video", "x"), (2, "9", "shopping", "video", "x"), (3, "9", "general", "video", "x"),
         (4, "2345", "general", "video", "x"), (5, "123", "shopping", "video", "a race day")],
        "id long, owner_id string, domain string, source_type string, title string")
    out = {r.id: r.prompt_name for r in J.match_rules(items, rules).collect()}
    assert out == {1: "p1", 2: "p2", 4: "p3", 5: "p4"}


def test_routing(spark):
    cats = spark.createDataFrame([(1, "general", "影视解读", "active"), (2, "general", "读书", "proposed")],
                                 "id long, domain string, name string, status string")
    verdicts = [(1, 1, None, .9, ""), (2, None, None, .4, ""), (3, None, "新桶", .85, ""), (4, None, "新桶", .65, ""),
                (5, None, "影视解读范畴", .9, ""), (6, None, "影视解读", .6, ""), (7, None, "", .3, "属于读书类"),
                (8, None, "", .2, "建议新增「读书」"), (9, 1, None, .9, "")]
    v = spark.createDataFrame(verdicts, "item_id long, category_id long, new_name string, confidence double, reason string")
    items = spark.createDataFrame([(i, "general", 2 if i == 9 else None, "owner") for i in range(1, 10)],
                                  "id long, domain string, rule_category_id long, rule_owner_name string")
    out = {r.id: (r.action, r.category_id, r.new_category) for r in C.route(items, v, cats).collect()}
    assert out == {1: ("filed", 1, None), 2: ("inbox", None, None), 3: ("proposed", None, "新桶"),
                   4: ("proposed", None, "新桶"), 5: ("filed", 1, None), 6: ("proposed", 1, None),
                   7: ("inbox", None, None), 8: ("proposed", 2, None), 9: ("filed", 2, None)}
    assert C.proposed_categories(C.route(items, v, cats)).count() == 1


@pytest.mark.parametrize("a,b,same", [("影视解读", "影视解读范畴", True), ("影视解读范畴", "影视解读", True),
                                      ("影视解读", "影视旁白", False), ("读书", "读书笔记", False)])
def test_same_name(spark, a, b, same):
    assert one(spark, C.same_name(F.lit(a), F.lit(b))) is same


# ---- retrieval and links --------------------------------------------------

def test_hybrid_search(spark):
    texts = ["深蹲训练 计划", "红烧肉 做法", "another note about squats"]
    domains = ["fitness", "cooking", "fitness"]
    chunks = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, item_id long, content string")
    items = spark.createDataFrame([(i, d, "note") for i, d in enumerate(domains)], "id long, domain string, type string")
    vectors = Q.embed(chunks, "content", Q.HashEncoder).join(
        items.select(F.col("id").alias("chunk_id"), "domain"), "chunk_id").select("chunk_id", "embedding", "domain")
    q = spark.createDataFrame([(1, texts[1], None), (2, "squats", None), (3, "训练", "cooking"), (4, "  ", None)],
                              "query_id long, query string, domain string")
    q = Q.embed(q, "query", Q.HashEncoder, "qe")
    hits = Q.hybrid_search(chunks, vectors, items, q, 2).collect()
    top = {r.query_id: r.chunk_id for r in hits if r["rank"] == 1}
    assert top[1] == 1 and top[2] == 2
    assert {r.domain for r in hits if r.query_id == 3} == {"cooking"}
    assert not [r for r in hits if r.query_id == 4]


def test_links_own_chunks_do_not_crowd_out(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    chunks = [(i, 1, near) for i in range(50)] + [(100, 2, near), (101, 3, far)]
    c = spark.createDataFrame(chunks, "chunk_id long, item_id long, embedding array<float>")
    p = spark.createDataFrame([(1, near), (2, near), (3, far)], "item_id long, embedding array<float>")
    out = {(r.item_id, r.related_id) for r in K.build_links(p, c).collect()}
    assert out == {(1, 2), (2, 1)}


def test_links_chance_match(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    c = spark.createDataFrame([(0, 2, near)] + [(i, 2, far) for i in (1, 2, 3)] + [(i, 3, near) for i in range(4, 8)],
                              "chunk_id long, item_id long, embedding array<float>")
    p = spark.createDataFrame([(1, near)], "item_id long, embedding array<float>")
    out = K.build_links(p, c).collect()
    assert [(r.related_id) for r in out] == [3] and out[0].score > .9


def test_links_replace_keeps_other_side(spark):
    old = spark.createDataFrame([(1, 2, .8)], "item_a long, item_b long, score double")
    again = spark.createDataFrame([(2,)], "item_a long")
    now = K.replace_links(old, old.filter("item_a = 2"), again)
    items = spark.createDataFrame([(1, "one")], "id long, title string")
    out = {(r.item_a, r.related_id, r.title) for r in K.links_read(now, items).collect()}
    assert out == {(1, 2, "#2"), (2, 1, "one")}


# ---- text, captures, tables -----------------------------------------------

def test_chunk_text(spark):
    text = "\n".join("字" * 600 for _ in range(10))
    chunks = one(spark, X.chunk_text(F.lit(text)))
    assert len(chunks) >= 5 and all(len(c) <= 1400 for c in chunks)
    assert "\n".join(chunks) == text
    assert len(one(spark, X.chunk_text(F.lit(text), max_chunks=3))) == 3


def test_extraction_text(spark):
    text = "开头。" + "中段内容。" * 3000 + "最后一句。"
    out = one(spark, X.extraction_text(F.lit(text)))
    assert len(out) <= 3000 and out.startswith("开头。") and out.endswith("最后一句。") and "省略" in out


def test_profile_text(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else (
        F.create_map().cast("map<string,string>"))
    assert one(spark, X.profile_text(F.lit("T"), F.lit("body"), m({"a": "x", "b": "y"}))) == "T\nx\ny"
    assert one(spark, X.profile_text(F.lit("T"), F.lit("body"), m({}))) == "body"
    assert one(spark, X.profile_text(F.lit("T"), F.lit(None).cast("string"), m({}))) == "T"


@pytest.mark.parametrize("reply,expect", [
    ('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 1}\n```', '{"a": 1}'), ('well {"a": 1} ok', '{"a": 1}'),
    ("none", None), ("", None)])
def test_json_lenient(spark, reply, expect):
    assert one(spark, S.json_lenient(F.lit(reply))) == expect


def test_fmt_ts(spark):
    assert one(spark, S.fmt_ts(F.lit(75.4))) == "01:15"
    assert one(spark, S.fmt_ts(F.lit(None).cast("double"))) == "--:--"


@pytest.mark.parametrize("text,expect", [("https://space.bilibili.com/42/x", "42"), (" 7 ", "7"), ("abc", None), ("", None)])
def test_id_from_url(spark, text, expect):
    assert one(spark, X.id_from_url(F.lit(text))) == expect


def test_is_off():
    assert all(S.is_off(v) for v in (None, False, 0, "off", "No", " none ", "DISABLED"))
    assert not any(S.is_off(v) for v in (True, "on", "auto", 1))


def test_incremental_listing(spark):
    def check(keys, known, first):
        listing = spark.createDataFrame([("s", k, first) for k in keys], "src string, key string, first_run boolean")
        unseen, report = P.listing_report(listing, known, "src", "key", "first_run")
        r = report.first()
        return (r.new, r.seeded, r.total), P.register_seen(known, unseen, "key", "first_run")

    known = spark.createDataFrame([], "key string, status string")
    got, known = check(["a", "b", "c"], known, True)
    assert got == (0, 3, 3)
    got, known = check(["a", "d"], known, False)
    assert got == (1, 0, 2)
    assert check(["a", "d"], known, False)[0] == (0, 0, 2)


def test_bucket_schedule(spark):
    ticks = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:01'), ('a', timestamp'2024-01-01 00:10:00'), "
                      "('b', timestamp'2024-01-01 00:00:05'), ('b', timestamp'2024-01-01 00:29:00') t(source, ts)")
    assert U.bucket_schedule(ticks, "source", "ts", 1800).count() == 2


def test_purge_stale(spark):
    index = spark.createDataFrame([(1, 1), (1, 2), (9, 3)], "item_id long, row_id long")
    parents = spark.createDataFrame([(1,), (2,)], "item_id long")
    assert [(r.item_id, r.row_id) for r in U.purge_stale(index, parents, "item_id", "row_id").collect()] == [(1, 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("第一段\n\n第二段")
    (tmp_path / "sub" / "b.txt").write_text("x")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.txt").write_text("")
    ok, rejects = D.split_supported(D.list_files(spark, str(tmp_path)))
    assert ok.count() == 2
    assert {r.reason for r in rejects.collect()} == {"unsupported kind file"}      # d.txt is empty, scans skip it
    items = D.document_items(D.read_text_files(spark, str(tmp_path)).filter(F.col("path").endswith(".md")))
    assert items.first().title == "a"
    assert [r.content for r in D.chunk_rows(items).collect()] == ["第一段\n第二段"]


def test_capture_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"type": "page", "url": "u", "text": " hello "}\n{"type": "video", "video": {"id": "BV1"}}\n'
        '{"type": "product", "title": "", "product": {"name": ""}}\n{"type": "selection", "text": " "}\n')
    ok, bad = P.split_valid(P.shape_captures(P.read_captures(spark, str(tmp_path))))
    assert sorted(r.job_type for r in ok.collect()) == ["ingest_text", "ingest_video"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["product needs name or title", "text is empty"]
    assert P.text_items(ok).first().title == "hello"
