"""Time-series queries. Series: events per user, in seconds; blocks of one week."""

from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators import aggregates as A
from keepsake.operators import series as R
from keepsake.operators.blocks import exact_percentiles, islands, previous, row_index
from keepsake.operators.lookup import latest_per_key
from keepsake.plans import mapping as M
from keepsake.plans.joined import spans
from keepsake.plans.registry import Tables, plan
from keepsake.session import reliable

HOUR, DAY = 3600.0, 86400.0
QUIET, STILL = 12 * HOUR, 5 * HOUR


def block():
    return F.floor(F.col("ts") / (7 * DAY))


STATS_SQL = f"""{M.SERIES_SQL},
  th AS (SELECT series_id, quantile_cont(value, 0.2) AS floor, quantile_cont(value, 0.5) AS median,
           count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM series GROUP BY 1),
  sp AS (SELECT series_id, quantile_cont(d, 0.5) AS step FROM (SELECT series_id,
           ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts, id) AS d FROM series) WHERE d IS NOT NULL GROUP BY 1),
  stats AS (SELECT th.*, coalesce(sp.step, 0.2::DOUBLE) AS step, greatest(floor * 3.0::DOUBLE, 0.05::DOUBLE) AS enter,
           floor * 1.5::DOUBLE AS exit FROM th LEFT JOIN sp ON sp.series_id = th.series_id)"""

EVENTS_SQL = f"""{STATS_SQL},
  e1 AS (SELECT s.series_id, s.ts, s.id, s.value, t.enter, t.exit, t.step, t.last_ts,
           row_number() OVER (PARTITION BY s.series_id ORDER BY s.ts, s.id) AS rn
         FROM series s JOIN stats t ON t.series_id = s.series_id),
  e2 AS (SELECT *, last_value(CASE WHEN value > exit THEN rn END IGNORE NULLS)
           OVER (PARTITION BY series_id ORDER BY rn) AS lx FROM e1),
  e3 AS (SELECT *, last_value(CASE WHEN value > enter THEN 1 WHEN (rn - coalesce(lx, 0)) * step >= {QUIET} THEN 0 END
           IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn) AS st FROM e2),
  e4 AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY series_id ORDER BY rn), 0) = 0
           THEN 1 ELSE 0 END AS opens FROM e3),
  e5 AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY rn) AS g FROM e4),
  ev AS (SELECT series_id, min(ts) FILTER (WHERE opens = 1) AS start_s,
           CASE WHEN bool_or(st = 0) THEN max(ts) FILTER (WHERE st = 1 AND value > exit) ELSE max(last_ts) END AS end_s
         FROM e5 WHERE g > 0 GROUP BY series_id, g)"""

SETTLE_SQL = f"""
  q1 AS (SELECT s.series_id, s.ts, s.value <= greatest(t.floor * 1.2::DOUBLE, 0.01::DOUBLE) AS still,
           greatest(1, round_even({STILL}::DOUBLE / t.step, 0)) AS need,
           row_number() OVER (PARTITION BY s.series_id ORDER BY s.ts, s.id) AS rn
         FROM series s JOIN stats t ON t.series_id = s.series_id
         WHERE greatest(t.floor * 1.2::DOUBLE, 0.01::DOUBLE) < t.median),
  q2 AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS g FROM q1 WHERE still),
  settle AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM q2 GROUP BY series_id, g HAVING count(*) >= max(need))"""


def events_of(t: Tables):
    return R.detect_events(M.series(t), "series_id", quiet_seconds=QUIET)


def settle_of(t: Tables):
    return R.detect_settle(M.series(t), "series_id", min_seconds=STILL)


@plan("detect_events", f"WITH {EVENTS_SQL} SELECT series_id, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM ev")
def detect_events(t: Tables):
    return events_of(t).select("series_id", F.round("start_s", 3).alias("start_s"),
                               F.round("end_s", 3).alias("end_s"))


@plan("win_hysteresis_events", f"""WITH {EVENTS_SQL}
  SELECT series_id, count(*) AS n_events, round(sum(end_s - start_s), 3) AS active_s FROM ev GROUP BY 1""")
def win_hysteresis_events(t: Tables):
    return events_of(t).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 3).alias("active_s"))


@plan("detect_settle", f"WITH {STATS_SQL}, {SETTLE_SQL} SELECT series_id, round(lo, 3) AS lo, round(hi, 3) AS hi FROM settle")
def detect_settle(t: Tables):
    return settle_of(t).select("series_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@plan("win_settle_islands", f"""WITH {M.SERIES_SQL},
  a AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, id) AS rn FROM series),
  b AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS g FROM a WHERE value <= 20)
  SELECT series_id, min(rn) AS first_row, max(rn) AS last_row FROM b GROUP BY series_id, g""")
def win_settle_islands(t: Tables):
    rows = row_index(M.series(t).select("series_id", "ts", "id", "value"), ["series_id"], ["ts", "id"], block())
    return islands(rows.filter(F.col("value") <= 20), ["series_id"], "rn", block(),
                   lambda pos, prev: pos - prev > 1,
                   {"first_row": ("min", F.col("rn")), "last_row": ("max", F.col("rn"))})


@plan("win_frame_diff", """
  WITH v AS (SELECT label::BIGINT AS series_id, vec_id, embedding::DOUBLE[] AS e,
      lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
  SELECT series_id, vec_id, CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(list_zip(e, p),
    lambda z: CASE WHEN abs(z[1] - z[2]) > 0.1 THEN 1.0 ELSE 0.0 END))::DOUBLE / len(e), 6) END AS ratio FROM v""")
def win_frame_diff(t: Tables):
    v = t.embeddings.select(F.col("label").cast("long").alias("series_id"), "vec_id", "embedding")
    v = previous(v, ["series_id"], ["vec_id"], F.floor(F.col("vec_id") / 10000), {"prev": F.col("embedding")})
    return v.select("series_id", "vec_id", F.round(S.change_ratio("embedding", "prev", 0.1), 6).alias("ratio"))


@plan("win_hist_corr", """
  WITH v AS (SELECT label::BIGINT AS series_id, vec_id, embedding::DOUBLE[] AS e,
      lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
  SELECT series_id, vec_id, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE round(
    (list_dot_product(e, p) - list_sum(e) * list_sum(p) / len(e))
    / sqrt((list_dot_product(e, e) - list_sum(e) * list_sum(e) / len(e))
         * (list_dot_product(p, p) - list_sum(p) * list_sum(p) / len(p))), 6) END AS corr FROM v""")
def win_hist_corr(t: Tables):
    v = t.embeddings.select(F.col("label").cast("long").alias("series_id"), "vec_id", "embedding")
    v = previous(v, ["series_id"], ["vec_id"], F.floor(F.col("vec_id") / 10000), {"prev": F.col("embedding")})
    return v.select("series_id", "vec_id", F.round(S.correlation("embedding", "prev"), 6).alias("corr"))


_HOT_SQL = """hot AS (SELECT event_type AS k, floor(epoch_us(ts) / 3600000000.0)::BIGINT AS b, count(*) AS n
    FROM events {where} GROUP BY 1, 2 HAVING count(*) >= 2),
  isl AS (SELECT *, b - row_number() OVER (PARTITION BY k ORDER BY b) AS g FROM hot)
  SELECT k AS stream, min(b) * 3600.0::DOUBLE AS start_s, (max(b) + 1) * 3600.0::DOUBLE AS end_s"""


@plan("win_hot_islands", f"WITH {_HOT_SQL.format(where='')}, sum(n)::BIGINT AS hits FROM isl GROUP BY k, g")
def win_hot_islands(t: Tables):
    return R.hot_segments(M.series(t).withColumnRenamed("event_type", "stream"), "stream", "ts", HOUR, 2)


@plan("ad_segments", f"WITH {_HOT_SQL.format(where=chr(10) + 'WHERE value > 20')} FROM isl GROUP BY k, g")
def ad_segments(t: Tables):
    comments = M.series(t).select(F.col("event_type").alias("stream"), "ts", F.concat(
        "event_type", F.when(F.col("value") > 20, "恰饭").otherwise("")).alias("text"))
    return R.ad_segments(comments, "stream", HOUR, 2)


_INDEX_SQL = f"""{M.SERIES_SQL}, ix AS (SELECT series_id, ts, id, value,
    row_number() OVER (PARTITION BY series_id ORDER BY ts, id) - 1 AS i,
    count(*) OVER (PARTITION BY series_id) AS n FROM series)"""


def index_of(t: Tables):
    return R.indexed(M.series(t).select("series_id", "ts", "id", "value"), "series_id", ["ts", "id"], block())


_PICK_SQL = f"""WITH {_INDEX_SQL}, b AS (SELECT *, (((i + 1) * 20 - 1) // n) AS b FROM ix WHERE n > 20),
  p AS (SELECT series_id, CASE WHEN min(value) < 10 THEN arg_min(id, (value, i)) ELSE arg_min(id, i) END AS id
        FROM b GROUP BY series_id, b)
  SELECT series_id, id FROM p UNION ALL SELECT series_id, id FROM ix WHERE n <= 20"""


@plan("pick_covering", _PICK_SQL)
def pick_covering(t: Tables):
    return R.pick_covering(index_of(t), "series_id", "value", "id", 20, 10.0)


@plan("win_bucket_argmin", f"""WITH {_INDEX_SQL}
  SELECT series_id, ((i + 1) * 20 - 1) // n AS bucket, min(value) AS lowest,
    arg_min(i, (value, i))::BIGINT AS at FROM ix GROUP BY 1, 2""")
def win_bucket_argmin(t: Tables):
    rows = index_of(t).withColumn("bucket", F.floor(((F.col("i") + 1) * 20 - 1) / F.col("n")).cast("long"))
    return rows.groupBy("series_id", "bucket").agg(
        F.min("value").alias("lowest"), F.min_by("i", F.struct("value", "i")).cast("long").alias("at"))


_EVEN_SQL = """WITH ix AS (SELECT o_orderpriority AS k, o_orderkey AS id,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  idx AS (SELECT DISTINCT k, n, CAST(round_even(j * (n - 1) / 119.0::DOUBLE, 0) AS BIGINT) AS i
          FROM (SELECT DISTINCT k, n FROM ix), range(120) r(j))
  SELECT ix.k AS series, ix.id FROM ix JOIN idx ON idx.k = ix.k AND idx.i = ix.i"""


def _orders_index(t: Tables):
    o = t.orders.select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return o, F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / (30 * DAY))


@plan("win_even_sample", _EVEN_SQL)
def win_even_sample(t: Tables):
    o, blk = _orders_index(t)
    return R.even_sample(R.indexed(o, "series", ["o_orderdate", "id"], blk), "series", 120).select("series", "id")


@plan("max_units_cap", f"""WITH {EVENTS_SQL},
  u AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_s) - 1 AS i,
          count(*) OVER (PARTITION BY series_id) AS n FROM ev),
  idx AS (SELECT DISTINCT series_id, CAST(round_even(j * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) AS i
          FROM (SELECT DISTINCT series_id, n FROM u WHERE n > 6), range(6) r(j))
  SELECT u.series_id, round(u.start_s, 3) AS start_s FROM u LEFT JOIN idx ON idx.series_id = u.series_id AND idx.i = u.i
  WHERE u.n >= 5 AND (u.n <= 6 OR idx.i IS NOT NULL)""")
def max_units_cap(t: Tables):
    units = events_of(t)
    out = R.cap_units(units, "series_id", ["start_s"], F.floor(F.col("start_s") / DAY), 6, 5)
    return out.select("series_id", F.round("start_s", 3).alias("start_s"))


@plan("interval_sample", f"""WITH {_INDEX_SQL}, s AS (SELECT *,
    CASE WHEN n / 2.0 / 5 > 5 THEN greatest(1, n // 5) ELSE 10 END AS step FROM ix)
  SELECT series_id, id FROM s WHERE i % step = 0 AND i < step * 5""")
def interval_sample(t: Tables):
    return R.interval_sample(index_of(t), 2.0, 5.0, 5).select("series_id", "id")


@plan("probe_sample", f"WITH {_INDEX_SQL} SELECT series_id, id FROM ix WHERE i % greatest(1, n // 20) = 0")
def probe_sample(t: Tables):
    return R.step_sample(index_of(t), 20).select("series_id", "id")


# ---- bands ----------------------------------------------------------------

BANDS_SQL = """bl AS (SELECT l_suppkey AS series_id, l_orderkey AS frame, l_quantity / 50.0::DOUBLE AS y0,
      least(0.999::DOUBLE, l_quantity / 50.0::DOUBLE + l_tax * 8.0::DOUBLE) AS y1, l_extendedprice AS motion FROM lineitem),
  bc AS (SELECT series_id, band, count(DISTINCT frame) AS seen FROM (
      SELECT series_id, frame, unnest(range(CAST(floor(y0 * 24) AS BIGINT), least(23, CAST(floor(y1 * 24) AS BIGINT)) + 1)) AS band
      FROM bl) GROUP BY ALL),
  bf AS (SELECT series_id, count(DISTINCT frame) AS n FROM bl GROUP BY 1),
  bm AS (SELECT series_id, CAST(floor(y0 * 24) AS BIGINT) AS band, quantile_cont(motion, 0.5) AS motion FROM bl GROUP BY 1, 2),
  bands AS (SELECT bc.series_id, bc.band, bc.seen / bf.n AS text_rate, coalesce(bm.motion, 0) AS motion
    FROM bc JOIN bf ON bf.series_id = bc.series_id LEFT JOIN bm ON bm.series_id = bc.series_id AND bm.band = bc.band
    WHERE bc.band < 24),
  bt AS (SELECT *, min(motion) OVER (PARTITION BY series_id) AS lowest, max(motion) OVER (PARTITION BY series_id) AS top
    FROM bands WHERE text_rate >= 0.3),
  br AS (SELECT *, CASE WHEN lowest <= 0 THEN 'no_motion' WHEN top < lowest * 3 THEN 'not_separated' ELSE 'ok' END AS reason FROM bt),
  bx AS (SELECT *, CASE WHEN reason = 'ok' AND motion >= lowest * 3 THEN 'active' ELSE 'static' END AS role FROM br),
  by_role AS (SELECT series_id, reason, band, role, CASE WHEN role = 'active' THEN row_number() OVER
      (PARTITION BY series_id, role ORDER BY motion DESC, band) END AS rank FROM bx),
  roles AS (SELECT * FROM by_role WHERE rank IS NULL OR rank <= 2
    UNION ALL SELECT DISTINCT series_id, 'no_text', NULL, NULL, NULL FROM bands
    WHERE series_id NOT IN (SELECT series_id FROM bt))"""


def bands_of(t: Tables):
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("frame"),
        (F.col("l_quantity") / 50.0).alias("y0"),
        F.least(F.lit(0.999), F.col("l_quantity") / 50.0 + F.col("l_tax") * 8.0).alias("y1"),
        F.col("l_extendedprice").alias("motion"))
    rate = A.text_rate(lines, lines, "series_id", "frame", "y0", "y1")
    motion = exact_percentiles(lines.select("series_id", F.floor(F.col("y0") * 24).cast("long").alias("band"), "motion"),
                               ["series_id", "band"], "motion", {"motion": 0.5})
    return rate.withColumn("band", F.col("band").cast("long")).join(motion, ["series_id", "band"], "left").select(
        "series_id", "band", "text_rate", F.coalesce("motion", F.lit(0.0)).alias("motion"))


@plan("classify_bands", f"WITH {BANDS_SQL} SELECT series_id, reason, band, role, rank FROM roles")
def classify_bands(t: Tables):
    return R.classify_bands(bands_of(t), "series_id").select("series_id", "reason", "band", "role", "rank")


@plan("band_top2", f"WITH {BANDS_SQL} SELECT series_id, band, rank FROM roles WHERE role = 'active'")
def band_top2(t: Tables):
    return R.classify_bands(bands_of(t), "series_id").filter(F.col("role") == "active").select(
        "series_id", "band", "rank")


@plan("build_units", f"""WITH {EVENTS_SQL}, {SETTLE_SQL},
  c AS (SELECT e.series_id, e.start_s, e.end_s, min(s.lo) AS lo FROM ev e JOIN settle s ON s.series_id = e.series_id
        AND s.lo >= e.end_s AND s.lo <= e.end_s + 43200.0::DOUBLE GROUP BY ALL),
  u AS (SELECT e.series_id, e.start_s, coalesce(s.hi, e.end_s) AS close_s FROM ev e
        LEFT JOIN c ON c.series_id = e.series_id AND c.start_s = e.start_s
        LEFT JOIN settle s ON s.series_id = c.series_id AND s.lo = c.lo),
  v AS (SELECT user_id AS series_id, epoch_us(ts) / 1000000.0::DOUBLE AS a,
          epoch_us(ts) / 1000000.0::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 60 AS b
        FROM events WHERE event_type = 'view')
  SELECT u.series_id, round_even(u.start_s, 2) AS start_frame, round_even(u.close_s, 2) AS end_frame,
    (SELECT count(*) FROM v WHERE v.series_id = u.series_id AND v.b > u.start_s AND v.a < u.close_s) AS n_speech
  FROM u WHERE close_s - start_s >= 0.2""")
def build_units(t: Tables):
    series = R.numbered(M.series(t), "series_id", extra=["value"])
    stats = reliable(R.series_stats(series, "series_id"))      # one row per series
    units = reliable(R.build_units(
        R.detect_events(series, "series_id", stats, QUIET),
        R.detect_settle(series, "series_id", stats, STILL), "series_id", 43200.0))
    speech = spans(t).filter(F.col("event_type") == "view").select(
        "series_id", F.col("a0").alias("seg_start"), F.col("a1").alias("seg_end"))
    n = R.unit_speech(units, speech, "series_id", 4 * HOUR).groupBy("series_id", "start_frame").agg(
        F.count(F.lit(1)).alias("n_speech"))
    return units.join(n, ["series_id", "start_frame"], "left").select(
        "series_id", "start_frame", "end_frame", F.coalesce("n_speech", F.lit(0)).cast("long").alias("n_speech"))


@plan("decide_quadrant", """
  WITH u AS (SELECT user_id, count(*) > 65 AS has_band, count(*) FILTER (WHERE event_type = 'view') / count(*) AS r
             FROM events GROUP BY 1)
  SELECT user_id AS series_id, has_band AS ocr_band, r < 0.2 AS ocr_full, has_band AS unitize FROM u""")
def decide_quadrant(t: Tables):
    u = t.events.groupBy(F.col("user_id").alias("series_id")).agg(
        (F.count(F.lit(1)) > 65).alias("has_band"),
        (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("r"))
    return u.withColumns(R.decide_quadrant(F.col("has_band"), F.col("r"), "auto", 0.2)).drop("has_band", "r")


@plan("should_ocr", """
  WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS s, count(*)::DOUBLE AS d FROM events GROUP BY 1),
  p AS (SELECT *, CAST(CAST(round_even(s / d * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct FROM u)
  SELECT user_id AS series_id, s / d < 0.2 AS run, CASE WHEN s / d < 0.2 THEN '人声仅占 ' || pct || ' < 20%,判为字幕/无配音视频'
    ELSE '人声占 ' || pct || ' ≥ 20%,无需 OCR' END AS reason FROM p""")
def should_ocr(t: Tables):
    u = t.events.groupBy(F.col("user_id").alias("series_id")).agg(
        F.count_if(F.col("event_type") == "view").cast("double").alias("s"),
        F.count(F.lit(1)).cast("double").alias("d"))
    run, reason = R.should_ocr(F.col("s"), F.col("d"), 0.2)
    return u.select("series_id", run.alias("run"), reason.alias("reason"))


@plan("series_profile", f"""WITH {EVENTS_SQL}, {SETTLE_SQL}, {BANDS_SQL},
  r AS (SELECT series_id, max(reason) AS why, max(CASE WHEN rank = 1 THEN band / 24.0::DOUBLE END) AS band FROM roles GROUP BY 1),
  ne AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1), ns AS (SELECT series_id, count(*) AS n FROM settle GROUP BY 1),
  sp2 AS (SELECT user_id AS series_id, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 60) AS s
          FROM events WHERE event_type = 'view' GROUP BY 1),
  f AS (SELECT t.*, CASE WHEN t.n < 4 THEN 'too_few_samples' ELSE coalesce(r.why, 'no_text') END AS reason, r.band,
          ne.n AS ne, ns.n AS ns, sp2.s FROM stats t LEFT JOIN r ON r.series_id = t.series_id
        LEFT JOIN ne ON ne.series_id = t.series_id LEFT JOIN ns ON ns.series_id = t.series_id
        LEFT JOIN sp2 ON sp2.series_id = t.series_id)
  SELECT series_id, reason = 'ok' AS ok, reason, CASE WHEN reason = 'ok' THEN round(band, 6) END AS band,
    CASE WHEN reason = 'ok' THEN round(floor, 6) END AS floor,
    CASE WHEN reason = 'ok' THEN coalesce(ne, 0) ELSE 0 END AS event_count,
    CASE WHEN reason = 'ok' THEN coalesce(ns, 0) ELSE 0 END AS settle_count,
    CASE WHEN reason = 'ok' THEN round(coalesce(s, 0) / (last_ts - first_ts), 6) END AS speech_ratio FROM f""")
def series_profile(t: Tables):
    speech = t.events.filter(F.col("event_type") == "view").groupBy(F.col("user_id").alias("series_id")).agg(
        F.sum(S.json_field("props", "k").try_cast("double") * 60).alias("speech_seconds"))
    p = R.series_profile(M.series(t), bands_of(t), speech, "series_id", QUIET, STILL)
    return p.select("series_id", "ok", "reason", F.round("band", 6).alias("band"), F.round("floor", 6).alias("floor"),
                    "event_count", "settle_count", F.round("speech_ratio", 6).alias("speech_ratio"))


_HALF = "TIMESTAMP '2024-01-16'"


@plan("profile_validate", f"""
  WITH a AS (SELECT user_id, min(value) / 20 AS band, count(*) / 15.0::DOUBLE AS hz,
      count(*) FILTER (WHERE event_type = 'view') / count(*) AS speech FROM events WHERE ts < {_HALF} GROUP BY 1),
  b AS (SELECT user_id, min(value) / 20 AS band, count(*) / 15.0::DOUBLE AS hz,
      count(*) FILTER (WHERE event_type = 'view') / count(*) AS speech FROM events WHERE ts >= {_HALF} AND value > 1 GROUP BY 1)
  SELECT b.user_id AS series_id, CASE WHEN a.band IS NULL THEN 'no_cache' WHEN abs(a.band - b.band) > 0.05 THEN 'band_shift'
    WHEN greatest(a.hz, b.hz) / greatest(1e-6, least(a.hz, b.hz)) > 1.5 THEN 'event_rate'
    WHEN abs(a.speech - b.speech) > 0.2 THEN 'speech' ELSE 'ok' END AS verdict
  FROM b LEFT JOIN a ON a.user_id = b.user_id""")
def profile_validate(t: Tables):
    half = F.lit("2024-01-16").cast("timestamp_ntz")

    def facts(df, prefix):
        return df.groupBy(F.col("user_id").alias("series_id")).agg(
            (F.min("value") / 20).alias(f"{prefix}band"), (F.count(F.lit(1)) / 15.0).alias(f"{prefix}hz"),
            (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias(f"{prefix}speech"))

    cached = facts(t.events.filter(F.col("ts") < half), "cached_")
    now = facts(t.events.filter((F.col("ts") >= half) & (F.col("value") > 1)), "")
    return now.join(cached, "series_id", "left").select(
        "series_id", R.profile_check(0.05, 1.5, 0.2).alias("verdict"))


@plan("profile_cache", """
  SELECT user_id AS series_id, arg_max(value, (ts, event_id)) AS value,
    arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY 1""")
def profile_cache(t: Tables):
    latest = latest_per_key(t.events.select("user_id", "ts", "event_id", "value", "props"), ["user_id"],
                            [F.desc("ts"), F.desc("event_id")])
    stored = latest.select(F.col("user_id").alias("series_id"), F.to_json(F.struct(
        "value", S.json_field("props", "k").try_cast("long").alias("k"))).alias("payload"))
    return stored.select("series_id", F.from_json("payload", "value double, k long").alias("p")).select(
        "series_id", "p.value", "p.k")


@plan("dual_channel_text", """
  WITH f AS (SELECT l_orderkey AS id, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS band,
      nullif(CASE l_returnflag WHEN 'R' THEN '' ELSE l_returnflag END, '') AS b, l_linestatus AS f FROM lineitem),
  g AS (SELECT id, l_linenumber, CASE WHEN band IS NOT NULL THEN b END AS b,
      CASE WHEN band IS NULL OR l_linenumber % 5 = 0 THEN f END AS f FROM f)
  SELECT id, l_linenumber::BIGINT AS seq, nullif(concat_ws(chr(10), b, f), '') AS frame_text,
    b IS NOT NULL AS band_hit, f IS NOT NULL AS full_hit FROM g""")
def dual_channel_text(t: Tables):
    frames = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("band"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("b"),
        F.col("l_linestatus").alias("f"))
    return R.dual_channel(frames, "band", "b", "f", "seq").drop("band", "b", "f")


@plan("merge_segments", f"""WITH RECURSIVE {M.SPEECH_SQL},
  o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_s, seq) AS rn FROM speech),
  w AS (SELECT series_id, rn, start_s, end_s, text, length(text) >= 240 OR end_s - start_s >= 45 AS done FROM o WHERE rn = 1
    UNION ALL
    SELECT o.series_id, o.rn, CASE WHEN w.done THEN o.start_s ELSE w.start_s END, o.end_s,
      CASE WHEN w.done THEN o.text ELSE w.text || o.text END,
      length(CASE WHEN w.done THEN o.text ELSE w.text || o.text END) >= 240
        OR o.end_s - CASE WHEN w.done THEN o.start_s ELSE w.start_s END >= 45
    FROM w JOIN o ON o.series_id = w.series_id AND o.rn = w.rn + 1)
  SELECT series_id, start_s, end_s, text FROM w WHERE done OR rn = (SELECT max(rn) FROM o WHERE o.series_id = w.series_id)""")
def merge_segments(t: Tables):
    return R.merge_segments(M.speech(t).select("series_id", "start_s", "end_s", "seq", "text"), "series_id",
                            F.floor(F.col("start_s") / HOUR))


#: Greedy spacing and filling as recursions: one step takes the next point of every series.
_FRAMES_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, {SETTLE_SQL},
  pt AS (SELECT e.series_id, least(greatest(e.start_s + 0.3::DOUBLE, s.first_ts), s.last_ts) AS t
         FROM ev e JOIN stats s ON s.series_id = e.series_id
         UNION SELECT series_id, (lo + hi) / 2 FROM settle),
  kp AS (SELECT series_id, min(t) AS t FROM pt GROUP BY 1
         UNION ALL SELECT kp.series_id, min(pt.t) FROM kp JOIN pt ON pt.series_id = kp.series_id AND pt.t - kp.t >= {HOUR}
         GROUP BY 1),
  few AS (SELECT s.series_id, s.n FROM stats s LEFT JOIN (SELECT series_id, count(*) AS c FROM kp GROUP BY 1) k
          ON k.series_id = s.series_id WHERE coalesce(c, 0) < 10),
  ix AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts, id) - 1 AS i,
           count(*) OVER (PARTITION BY series_id) / 40.0::DOUBLE AS stride FROM series),
  fl AS (SELECT series_id, list(ts ORDER BY ts) AS f FROM (SELECT *, ceil(i / stride) AS m FROM ix)
         WHERE (m < 40 AND floor(m * stride) = i OR floor((m - 1) * stride) = i)
           AND series_id IN (SELECT series_id FROM few) GROUP BY 1),
  fill AS (SELECT series_id, f, 1 AS j, coalesce((SELECT list(t) FROM kp WHERE kp.series_id = fl.series_id), []) AS acc FROM fl
           UNION ALL SELECT series_id, f, j + 1, CASE WHEN len(list_filter(acc, lambda x: abs(f[j] - x) < {HOUR})) = 0
             THEN list_append(acc, f[j]) ELSE acc END FROM fill WHERE j <= len(f)),
  fr AS (SELECT series_id, t FROM kp WHERE series_id NOT IN (SELECT series_id FROM few)
         UNION ALL SELECT series_id, unnest(acc) FROM fill WHERE j = len(f) + 1),
  nr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i,
           count(*) OVER (PARTITION BY series_id) AS n FROM fr)
  SELECT series_id, round_even(t, 2) AS t FROM nr WHERE n <= 40
    OR round_even(floor(i * 39.0::DOUBLE / (n - 1)) * (n - 1) / 39.0::DOUBLE, 0) = i
    OR round_even(ceil(i * 39.0::DOUBLE / (n - 1)) * (n - 1) / 39.0::DOUBLE, 0) = i"""


@plan("visual_event_frames", _FRAMES_SQL)
def visual_event_frames(t: Tables):
    rows = R.numbered(M.series(t), "series_id", extra=["value"])
    stats = reliable(R.series_stats(rows, "series_id"))
    settle = R.detect_settle(rows, "series_id", stats, STILL)
    return R.visual_event_frames(rows, settle, "series_id", 40, 0.3, HOUR, QUIET, DAY, stats)


