"""Time-series operators on long tables ``(series, ts, id, value)``.

Positions are row numbers along (ts, id) in sorted ranges (see ``ranges``); other scans run in
blocks (see ``blocks``), so one long series never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.scalars import is_off
from keepsake.operators.blocks import exact_percentiles, islands, running
from keepsake.operators.fold import greedy_groups
from keepsake.operators.joins import asof_forward, interval_overlap
from keepsake.operators.ranges import ranged
from keepsake.session import reliable

# Detection thresholds.
QUIET_SECONDS = 0.4
ENTER_RATIO, ENTER_FLOOR, EXIT_RATIO = 3.0, 0.05, 1.5
SETTLE_SECONDS, SETTLE_RATIO, SETTLE_FLOOR = 0.8, 1.2, 0.01
DEFAULT_STEP = 0.2


def numbered(series: DataFrame, key: str, order: list[str] = ("ts", "id"), extra: list[str] = ()) -> DataFrame:
    """Rows with their 1-based position ``rn``, the distance ``gap`` to the row before and their range ``part``.

    Rows that have been numbered before are taken as they are, so that several operators share one pass.
    """
    if {"rn", "gap", "part"} <= set(series.columns):
        return series
    return ranged(series, key, list(order), list(extra))


def median_step(series: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Median distance between neighbouring samples, per series with two or more rows."""
    return exact_percentiles(numbered(series, key, order), [key], "gap", {"step": 0.5})


def series_stats(series: DataFrame, key: str) -> DataFrame:
    """Levels, sampling step, length and span of every series. One row per series.

    ``floor`` = P20, ``median`` = P50 of the values, ``step`` = median distance of samples.
    Values and distances are ranked together in one pass.
    """
    rows = numbered(series, key, extra=["value"])
    long = rows.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("value").alias("x")),
        F.struct(F.lit(1).alias("kind"), F.col("gap").alias("x")))).alias("_m")).select(key, "_m.kind", "_m.x")
    p = exact_percentiles(long, [key, "kind"], "x", {"p20": 0.2, "p50": 0.5}, total="total")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    levels = p.groupBy(key).agg(of(0, "p20").alias("floor"), of(0, "p50").alias("median"), of(0, "total").alias("n"),
                                F.coalesce(of(1, "p50"), F.lit(DEFAULT_STEP)).alias("step"))
    ends = rows.groupBy(key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return levels.join(ends, key).withColumns({
        "enter": F.greatest(F.col("floor") * ENTER_RATIO, F.lit(ENTER_FLOOR)), "exit": F.col("floor") * EXIT_RATIO})


def detect_events(series: DataFrame, key: str, stats: DataFrame | None = None,
                  quiet_seconds: float = QUIET_SECONDS) -> DataFrame:
    """Two-threshold events ``(key, start_s, end_s)``.

    Rows above the exit level form runs; a gap of quiet rows that lasts ``quiet_seconds``
    ends a run. A run with a row above the enter level is an event: from its first such row
    to its last row, or to the end of the series when too little quiet follows.
    """
    rows = numbered(series, key, extra=["value"])
    stats = series_stats(rows, key) if stats is None else stats
    constants = stats.select(key, "enter", "exit", "step", "n", "last_ts")
    loud = rows.join(constants, key).filter(F.col("value") > F.col("exit"))
    runs = islands(
        loud, [key, "step", "n", "last_ts"], "rn", F.col("part"),
        lambda pos, prev: (pos - prev - 1) * F.col("step") >= quiet_seconds,
        {"start_s": ("min", F.when(F.col("value") > F.col("enter"), F.col("ts"))),
         "end_s": ("max", F.col("ts")), "_hi": ("max", F.col("rn"))})
    closed = (F.col("n") - F.col("_hi")) * F.col("step") >= quiet_seconds
    return runs.filter(F.col("start_s").isNotNull()).select(
        key, "start_s", F.when(closed, F.col("end_s")).otherwise(F.col("last_ts")).alias("end_s"))


def detect_settle(series: DataFrame, key: str, stats: DataFrame | None = None,
                  min_seconds: float = SETTLE_SECONDS, ratio: float = SETTLE_RATIO) -> DataFrame:
    """Static segments ``(key, lo, hi)``: long enough runs of rows at or below the level."""
    rows = numbered(series, key, extra=["value"])
    stats = series_stats(rows, key) if stats is None else stats
    level = F.greatest(F.col("floor") * ratio, F.lit(SETTLE_FLOOR))
    need = F.when(F.col("step") > 0, F.greatest(F.lit(1), F.bround(F.lit(min_seconds) / F.col("step"))))
    constants = stats.filter(level < F.col("median")).select(
        key, level.alias("_level"), F.coalesce(need, F.lit(1)).cast("long").alias("_need"))
    still = rows.join(constants, key).filter(F.col("value") <= F.col("_level"))
    runs = islands(still, [key, "_need"], "rn", F.col("part"), lambda pos, prev: pos - prev > 1,
                   {"lo": ("min", F.col("ts")), "hi": ("max", F.col("ts")), "_n": ("sum", F.lit(1))})
    return runs.filter(F.col("_n") >= F.col("_need")).select(key, "lo", "hi")


def hot_segments(hits: DataFrame, key: str, ts: str = "ts", window: float = 10.0,
                 min_hits: int = 2) -> DataFrame:
    """Time buckets with enough hits, neighbours merged to ``(key, start_s, end_s, hits)``.

    Hits are counted per bucket map-side; only hot buckets are ordered.
    """
    buckets = hits.groupBy(key, F.floor(F.col(ts) / window).cast("long").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_hits)
    runs = islands(buckets, [key], "_b", F.floor(F.col("_b") / 1024), lambda pos, prev: pos - prev > 1,
                   {"_lo": ("min", F.col("_b")), "_hi": ("max", F.col("_b")), "hits": ("sum", F.col("_n"))})
    return runs.select(key, (F.col("_lo") * window).alias("start_s"),
                       ((F.col("_hi") + 1) * window).alias("end_s"), "hits")


def ad_segments(comments: DataFrame, key: str, window: float = 10.0, min_hits: int = 2) -> DataFrame:
    """Hot segments of comments that carry an advertising word, rounded to 0.1."""
    from keepsake.functions.text import contains_any

    segs = hot_segments(comments.filter(contains_any("text")), key, "ts", window, min_hits)
    return segs.select(key, F.round("start_s", 1).alias("start_s"), F.round("end_s", 1).alias("end_s"))


# ---- sampling -------------------------------------------------------------

def indexed(series: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """Zero-based index ``i`` and series length ``n`` for every row."""
    rows = running(series, [key], order, block, sums={"_rn": F.lit(1).cast("long")},
                   totals={"n": F.lit(1).cast("long")})
    return rows.withColumn("i", F.col("_rn") - 1).drop("_rn")


def even_sample(rows: DataFrame, key: str, m: int) -> DataFrame:
    """Evenly spaced rows, first and last kept, of every series longer than ``m``.

    ``rows`` carries ``i`` and ``n`` (see ``indexed``). Row ``i`` is kept when it is the
    rounded position of one of the ``m`` marks; only the marks next to it can be, so the
    test needs no join.
    """
    last, marks = F.col("n") - 1, F.lit(float(max(1, m - 1)))
    near = F.col("i") * marks / last

    def hit(k: Column) -> Column:
        return F.bround(k * last / marks) == F.col("i")

    return rows.filter((F.col("n") <= m) | hit(F.floor(near)) | hit(F.ceil(near)))


def cap_units(units: DataFrame, key: str, order: list[str], block: Column, max_units: int = 120,
              min_units: int = 5) -> DataFrame:
    """Even sample above ``max_units``; series with fewer than ``min_units`` fall back to none."""
    rows = indexed(units, key, order, block)
    kept = even_sample(rows, key, max_units) if max_units else rows
    return kept.filter(F.col("n") >= min_units)


def step_sample(rows: DataFrame, target: int = 600) -> DataFrame:
    """Every ``max(1, n div target)``-th row."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / target))
    return rows.filter(F.pmod(F.col("i"), step) == 0)


def interval_sample(rows: DataFrame, rate: float, interval: float, max_rows: int) -> DataFrame:
    """A row every ``interval`` seconds at ``rate`` rows per second; the step widens so that
    ``max_rows`` rows cover the whole series."""
    plain = max(1, int(rate * interval))
    wide = F.greatest(F.lit(1), F.floor(F.col("n") / max_rows))
    step = F.when(F.col("n") / rate / interval > max_rows, wide).otherwise(F.lit(plain))
    return rows.filter((F.pmod(F.col("i"), step) == 0) & (F.col("i") < step * max_rows))


def pick_covering(rows: DataFrame, key: str, corr: str, value: str, m: int,
                  threshold: float = 0.45) -> DataFrame:
    """Per series ``m`` equal index ranges; from each the row that changed most, else its first.

    Series of at most ``m`` rows are kept whole.
    """
    short = rows.filter(F.col("n") <= m).select(key, value)
    bucket = F.floor(((F.col("i") + 1) * m - 1) / F.col("n"))
    best = (rows.filter(F.col("n") > m).groupBy(key, bucket.alias("_b")).agg(
        F.min(F.struct(F.col(corr).alias("c"), F.col("i").alias("i"), F.col(value).alias("v"))).alias("_best"),
        F.min(F.struct(F.col("i").alias("i"), F.col(value).alias("v"))).alias("_first")))
    return short.unionByName(best.select(key, F.when(
        F.col("_best.c") < threshold, F.col("_best.v")).otherwise(F.col("_first.v")).alias(value)))


# ---- bands and profiles ---------------------------------------------------

N_BANDS = 24
TEXT_RATE, SEPARATION, MAX_BANDS = 0.3, 3.0, 2


def classify_bands(bands: DataFrame, key: str, min_separation: float = SEPARATION,
                   max_bands: int = MAX_BANDS) -> DataFrame:
    """Role of every text band: ``active`` (with its rank) or ``static``, plus the reason.

    ``bands(key, band, text_rate, motion)`` has at most one row per band of a series.
    Reasons: ``ok``, ``no_text``, ``no_motion``, ``not_separated``; a series without text
    bands keeps one row.
    """
    per_series = bands.groupBy(key).agg(
        F.count_if(F.col("text_rate") >= TEXT_RATE).alias("_text"),
        F.min(F.when(F.col("text_rate") >= TEXT_RATE, F.col("motion"))).alias("lowest"),
        F.max(F.when(F.col("text_rate") >= TEXT_RATE, F.col("motion"))).alias("_top"))
    reason = (F.when(F.col("_text") == 0, "no_text").when(F.col("lowest") <= 0, "no_motion")
              .when(F.col("_top") < F.col("lowest") * min_separation, "not_separated").otherwise("ok"))
    text = bands.filter(F.col("text_rate") >= TEXT_RATE)
    out = per_series.withColumn("reason", reason).drop("_text", "_top").join(text, key, "left")
    active = (F.col("reason") == "ok") & (F.col("motion") >= F.col("lowest") * min_separation)
    out = out.withColumn("role", F.when(active, "active").when(F.col("band").isNotNull(), "static"))
    order = Window.partitionBy(key, "role").orderBy(F.desc("motion"), "band")     # at most N_BANDS rows
    out = out.withColumn("rank", F.when(F.col("role") == "active", F.row_number().over(order)).cast("long"))
    return out.filter(F.col("rank").isNull() | (F.col("rank") <= max_bands)).withColumns({
        "y0": F.col("band") / N_BANDS, "y1": (F.col("band") + 1) / N_BANDS})


def build_units(events: DataFrame, settle: DataFrame, key: str, settle_window: float = 3.0,
                min_seconds: float = 0.2) -> DataFrame:
    """Units from events: the closing frame moves to the end of a static segment that follows
    within ``settle_window`` seconds; shorter units than ``min_seconds`` are dropped."""
    out = asof_forward(events, settle, key, [key, "start_s", "end_s"], "end_s", "lo", "hi", settle_window)
    close = F.coalesce("first_hi", "end_s")
    return out.withColumn("_close", close).filter(F.col("_close") - F.col("start_s") >= min_seconds).select(
        key, "start_s", "end_s", F.bround("start_s", 2).alias("start_frame"),
        F.bround("_close", 2).alias("end_frame"), F.col("_close").alias("close_s"))


def unit_speech(units: DataFrame, speech: DataFrame, key: str, width: float) -> DataFrame:
    """Speech segments overlapping each unit, one row per pair."""
    return interval_overlap(units, speech, key, ("start_s", "close_s"), ("seg_start", "seg_end"), width)


def decide_quadrant(has_band: Column, speech_ratio: Column, mode: str | bool | None = "auto",
                    threshold: float = 0.3) -> dict[str, Column]:
    """Which channels to read and whether to cut units, from band presence and speech share."""
    if is_off(mode):
        return {"ocr_band": F.lit(False), "ocr_full": F.lit(False), "unitize": F.lit(False)}
    if str(mode).lower() in ("on", "true", "yes", "always"):
        return {"ocr_band": F.lit(True), "ocr_full": F.lit(True), "unitize": has_band}
    return {"ocr_band": has_band, "ocr_full": speech_ratio < threshold, "unitize": has_band}


def should_ocr(speech_seconds: Column, duration: Column, limit: float = 0.3) -> tuple[Column, Column]:
    """Gate and its reason as a percentage text."""
    ratio = F.when(duration > 0, speech_seconds / duration).otherwise(F.lit(1.0))
    low = ratio < limit
    share = F.concat(F.bround(ratio * 100).cast("long").cast("string"), F.lit("%"))
    cut = f"{limit:.0%}"
    return low, F.when(low, F.concat(F.lit("人声仅占 "), share, F.lit(f" < {cut},判为字幕/无配音视频"))).otherwise(
        F.concat(F.lit("人声占 "), share, F.lit(f" ≥ {cut},无需 OCR")))


def profile_check(band_shift: float = 0.05, rate_ratio: float = 3.0, speech_delta: float = 0.35) -> Column:
    """First failing reason of the current profile against the cached one, or ``ok``.

    Columns: ``cached_band``, ``band`` (lower edges), ``cached_hz``, ``hz``, ``cached_speech``,
    ``speech``.
    """
    hi, lo = F.greatest("hz", "cached_hz"), F.least("hz", "cached_hz")
    return (F.when(F.col("cached_band").isNull(), "no_cache")
            .when(F.col("band").isNull(), "no_band")
            .when(F.abs(F.col("cached_band") - F.col("band")) > band_shift, "band_shift")
            .when((F.col("cached_hz") > 0) & F.col("hz").isNotNull()
                  & (hi / F.greatest(F.lit(1e-6), lo) > rate_ratio), "event_rate")
            .when(F.abs(F.col("cached_speech") - F.col("speech")) > speech_delta, "speech")
            .otherwise("ok"))


def series_profile(series: DataFrame, bands: DataFrame, speech: DataFrame, key: str,
                   quiet_seconds: float = QUIET_SECONDS, settle_seconds: float = SETTLE_SECONDS,
                   min_samples: int = 4) -> DataFrame:
    """One profile per series: bands, levels, event and static counts, speech share, reason.

    ``speech(key, speech_seconds)``. Reasons as in ``classify_bands`` plus ``too_few_samples``.
    """
    rows = numbered(series, key, extra=["value"])
    stats = reliable(series_stats(rows, key))      # one row per series, used three times
    events = detect_events(rows, key, stats, quiet_seconds).groupBy(key).agg(
        F.count(F.lit(1)).alias("event_count"))
    still = detect_settle(rows, key, stats, settle_seconds).groupBy(key).agg(
        F.count(F.lit(1)).alias("settle_count"))
    roles = classify_bands(bands, key).groupBy(key).agg(
        F.max("reason").alias("_why"), F.max(F.when(F.col("rank") == 1, F.col("y0"))).alias("band"))
    out = (stats.join(roles, key, "left").join(events, key, "left").join(still, key, "left")
           .join(speech, key, "left"))
    why = F.when(F.col("n") < min_samples, "too_few_samples").otherwise(F.coalesce("_why", F.lit("no_text")))
    ok = F.col("reason") == "ok"
    duration = F.col("last_ts") - F.col("first_ts")
    return out.withColumn("reason", why).select(
        key, ok.alias("ok"), "reason", F.when(ok, F.col("band")).alias("band"),
        F.when(ok, F.col("floor")).alias("floor"), F.when(ok, F.col("enter")).alias("enter"),
        F.when(ok, F.col("exit")).alias("exit"),
        F.when(ok, F.coalesce("event_count", F.lit(0))).otherwise(0).cast("long").alias("event_count"),
        F.when(ok, F.coalesce("settle_count", F.lit(0))).otherwise(0).cast("long").alias("settle_count"),
        F.when(ok & (duration > 0), F.coalesce("speech_seconds", F.lit(0.0)) / duration).alias("speech_ratio"),
        duration.alias("duration"))


def dual_channel(frames: DataFrame, band: str, band_text: str, full_text: str, index: str,
                 full_every: int = 5) -> DataFrame:
    """Frame text from the band channel, and from the full frame every few frames or without band."""
    has_band = F.col(band).isNotNull()
    b = F.when(has_band, F.nullif(F.col(band_text), F.lit("")))
    full = F.when(~has_band | (F.pmod(F.col(index), F.lit(full_every)) == 0),
                  F.nullif(F.col(full_text), F.lit("")))
    return frames.withColumns({"frame_text": F.nullif(F.concat_ws("\n", b, full), F.lit("")),
                               "band_hit": b.isNotNull(), "full_hit": full.isNotNull()})


# ---- greedy rules ---------------------------------------------------------

def merge_segments(segments: DataFrame, key: str, block: Column, max_chars: int = 240,
                   max_seconds: float = 45.0, block_rows: int = 512) -> DataFrame:
    """Short segments joined until one holds ``max_chars`` characters or ``max_seconds``."""
    rows = segments.filter(F.col("text").isNotNull())
    grouped = greedy_groups(rows, [key], ["start_s", "seq"], block, ["start_s", "end_s", "text"], "start_s", "end_s",
                            F.length("text"), max_chars, max_seconds, block_rows=block_rows)
    texts = F.sort_array(F.collect_list(F.struct("_rn", "text")))       # of less than max_chars and one segment
    return grouped.groupBy(key, "_start").agg(
        F.min_by("start_s", "_rn").alias("start_s"), F.max_by("end_s", "_rn").alias("end_s"),
        F.array_join(texts["text"], "").alias("text")).drop("_start")


def spaced(points: DataFrame, key: str, t: str, block: Column, gap: float, block_rows: int = 512) -> DataFrame:
    """Points kept greedily so that neighbours are at least ``gap`` apart."""
    rows = points.select(key, t).filter(F.col(t).isNotNull()).distinct()
    grouped = greedy_groups(rows, [key], [t], block, [t], t, t, most_span=gap, closing_row_inside=False,
                            block_rows=block_rows)
    return grouped.filter(F.col("_rn") == F.col("_start")).select(key, t)


def visual_event_frames(series: DataFrame, settle: DataFrame, key: str,
                        max_frames: int = 40, after_change: float = 0.3, min_gap: float = 1.0,
                        quiet_seconds: float = QUIET_SECONDS, axis_block: float = 3600.0,
                        stats: DataFrame | None = None) -> DataFrame:
    """Anchor times: shortly after each event starts and in the middle of static segments,
    at least ``min_gap`` apart; evenly filled when few, evenly thinned when many.

    ``stats``: ``series_stats`` of the series, where they are known already.
    """
    rows = numbered(series, key, extra=["value"])
    stats = reliable(series_stats(rows, key)) if stats is None else stats      # one row per series, used three times
    events = detect_events(rows, key, stats, quiet_seconds)
    span = stats.select(key, "first_ts", "last_ts")
    picks = events.join(span, key).select(key, F.least(F.greatest(
        F.col("start_s") + after_change, F.col("first_ts")), F.col("last_ts")).alias("t"))
    middles = settle.select(key, ((F.col("lo") + F.col("hi")) / 2).alias("t"))
    axis = F.floor(F.col("t") / axis_block)
    kept = reliable(spaced(picks.unionByName(middles), key, "t", axis, min_gap))
    count = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    few = reliable(stats.select(key).join(count, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(
        F.col("_n") < max(3, max_frames // 4)).select(key))
    # Filling only concerns series with few anchors: lists of at most 1.25 * max_frames times.
    rows = rows.join(few, key, "left_semi")
    length = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(length, key).withColumn("i", F.col("rn") - 1)
    stride = F.col("n") / F.lit(float(max_frames))
    mark = F.ceil(F.col("i") / stride)
    wanted = ((mark < max_frames) & (F.floor(mark * stride) == F.col("i"))) | (
        F.floor((mark - 1) * stride) == F.col("i"))
    filler = rows.filter(wanted).groupBy(key).agg(
        F.sort_array(F.collect_list("ts")).alias("_fill"))
    anchors = kept.join(few, key, "left_semi").groupBy(key).agg(
        F.sort_array(F.collect_list("t")).alias("_have"))
    filled = filler.join(anchors, key, "left").select(key, F.explode(F.aggregate(
        F.col("_fill"), F.coalesce("_have", F.array().cast("array<double>")),
        lambda acc, x: F.when(F.forall(acc, lambda m: F.abs(x - m) >= min_gap),
                              F.concat(acc, F.array(x))).otherwise(acc))).alias("t"))
    merged = kept.join(few, key, "left_anti").unionByName(filled)
    sampled = even_sample(indexed(merged, key, ["t"], axis), key, max_frames)
    return sampled.select(key, F.bround("t", 2).alias("t"))
