"""Date, number, JSON, map and vector expressions. Every function returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as switched off in a setting.
OFF_WORDS = ("off", "false", "0", "no", "disabled", "none")

# Fusion constant, score scale.
RRF_K = 60

#: Below this product of variances a histogram counts as flat.
FLAT = 2.220446049250313e-16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time -----------------------------------------------------------------

def ts_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def ts_normalize(text: str | Column) -> Column:
    """``2024-01-01T10:00:00`` -> ``2024-01-01 10:00:00``."""
    return F.regexp_replace(col(text), "T", " ")


def parse_ts(text: str | Column) -> Column:
    return F.try_to_timestamp(F.substring(ts_normalize(text), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def seconds(ts: str | Column) -> Column:
    """Seconds since the epoch with microseconds, as DOUBLE."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1000000.0)


def time_bucket(ts: str | Column, width: int) -> Column:
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / F.lit(width * 1000000)).cast("long")


def fmt_ts(sec: str | Column) -> Column:
    """Seconds to ``mm:ss``, null to ``--:--``."""
    whole = F.floor(col(sec)).cast("long")
    return F.when(col(sec).isNull(), F.lit("--:--")).otherwise(F.format_string(
        "%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60))))


def duration_label(start: str | Column, end: str | Column) -> Column:
    """Under two minutes in seconds, else minutes with one decimal; blank when open."""
    sec = F.unix_timestamp(col(end).cast("timestamp")) - F.unix_timestamp(col(start).cast("timestamp"))
    # Formats are fixed values.
    return (F.when(sec.isNull(), F.lit(""))
            .when(sec < 120, F.concat(sec.cast("string"), F.lit(" 秒")))
            .otherwise(F.concat(F.bround(sec / 60.0, 1).cast("decimal(20,1)").cast("string"),
                                F.lit(" 分钟"))))


# ---- numbers and vectors --------------------------------------------------

def rrf_term(rank: str | Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + col(rank))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in DOUBLE; the cosine similarity of unit vectors."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: str | Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(col(v), lambda x: x.cast("double") / norm)).otherwise(
        F.transform(col(v), lambda x: x.cast("double")))


def change_ratio(cur: str | Column, prev: str | Column, threshold: float) -> Column:
    """Share of cells whose absolute difference exceeds the threshold; 0 without a predecessor."""
    moved = F.aggregate(
        F.zip_with(col(cur), col(prev), lambda x, y: F.when(
            F.abs(x.cast("double") - y.cast("double")) > threshold, 1).otherwise(0)),
        F.lit(0), lambda acc, x: acc + x)
    return F.when(col(prev).isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(moved, F.size(col(cur))), F.lit(0.0)))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of two equally long arrays; 1 without a predecessor or where one of them is flat."""
    n = F.size(col(a)).cast("double")
    total = lambda v: F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))
    cov = dot(a, b) - total(a) * total(b) / n
    var = lambda v: dot(v, v) - total(v) * total(v) / n
    spread = var(a) * var(b)
    return F.when(col(b).isNull() | (F.size(col(a)) < 1) | ~(spread > FLAT), F.lit(1.0)).otherwise(
        F.try_divide(cov, F.sqrt(F.when(spread > FLAT, spread))))


def band_rescale(y: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return col(lo) + col(y) * (col(hi) - col(lo))


def toggle_flag(flag: str | Column) -> Column:
    return F.lit(1) - col(flag)


# ---- JSON and maps --------------------------------------------------------

def json_map(text: str | Column) -> Column:
    """JSON object to a string map; null when broken or not an object."""
    return F.when(col(text).rlike(r"^\s*\{"), F.from_json(col(text), "map<string,string>"))


def json_safe(text: str | Column) -> Column:
    """JSON object to a string map; empty map when broken or of another shape."""
    return F.coalesce(json_map(text), F.create_map().cast("map<string,string>"))


def json_array(text: str | Column) -> Column:
    return F.coalesce(
        F.when(col(text).rlike(r"^\s*\["), F.from_json(col(text), "array<string>")),
        F.array().cast("array<string>"))


def json_object_text(text: str | Column) -> Column:
    """The text when it is a valid JSON object, else null."""
    t = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(t).isNotNull(), t)


def json_lenient(text: str | Column) -> Column:
    """The JSON object inside a reply: whole text, a fenced block, or first to last brace."""
    fenced = F.regexp_extract(col(text), r"(?U)```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(col(text), r"\{[\s\S]*\}", 0)
    return F.coalesce(json_object_text(text), json_object_text(fenced), json_object_text(braces))


def json_field(text: str | Column, field: str) -> Column:
    return F.get_json_object(col(text), f"$.{field}")


def map_non_null(m: str | Column) -> Column:
    return F.map_filter(col(m), lambda k, v: v.isNotNull())


def has_any_key(m: str | Column, expected: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(col(m)), F.array(*[F.lit(e) for e in expected]))


def first_media(paths_json: str | Column) -> Column:
    return F.try_element_at(json_array(paths_json), F.lit(1))


def is_off(value: object) -> bool:
    """Whether a setting is switched off."""
    return value is None or value is False or str(value).strip().lower() in OFF_WORDS


def is_off_column(value: str | Column) -> Column:
    return col(value).isNull() | F.lower(F.trim(col(value).cast("string"))).isin(*OFF_WORDS)
