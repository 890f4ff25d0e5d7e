"""Text expressions. Every function returns a Column unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html import unescape as unescape_html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.scalars import col

# ---- fixed values ---------------------------------------------------------
MAX_CHUNK = 1200
GAP_MARK = "\n……(省略)……\n"
AD_WORDS = ("接广", "恰饭", "广子", "金主", "甲方", "赞助", "催更", "广告",
            "商单", "带货", "硬广", "软广", "接了", "口播")
STRONG_PROPOSAL = (r"(?U)(?:归入|归类为|归为|划入|建议(?:新增|新建|添加|建立)|新建|增设)"
                   r"\s*[「\"']?([^\s、，(（\[,。;:「」\"']{2,15})")
WEAK_PROPOSAL = r"(?U)(?:属于|应归|可归)\s*[「\"']?([^\s、，(（\[,。;:「」\"']{2,15})"
FILLER_TAILS = ("最合适", "较合适", "更合适", "比较合适", "最为合适",
                "合适", "为宜", "较好", "最佳", "妥当", "最好", "即可")
GENERIC_TAILS = ("分类", "类目", "范畴", "标签", "类型", "类别", "主题",
                 "话题", "领域", "条目", "内容")
TRAILING_CHARS = "分类标签目"
VIDEO_EXT = (".mp4", ".mkv", ".flv", ".avi", ".mov", ".webm", ".m4s")
IMAGE_EXT = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")
TEXT_EXT = (".txt", ".md", ".markdown", ".csv", ".log")
DOC_EXT = (".pdf", ".docx", ".doc", ".xlsx", ".xlsm", ".xls", ".pptx", ".ppt", ".epub", *TEXT_EXT)
VIDEO_ID = r"BV[0-9A-Za-z]{10}"
VIDEO_PAGE = r"bilibili\.com/video|b23\.tv"
OWNER_PAGE = r"space\.bilibili\.com/(\d+)"
PRODUCT_HOSTS = {"京东": r"(^|\.)jd\.com$", "淘宝": r"(^|\.)taobao\.com$", "天猫": r"(^|\.)tmall\.com$"}
JUMP_PREFIX = "https://www.bilibili.com/video/"


# ---- cutting and packing --------------------------------------------------

def strip(text: str | Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def paragraphs(text: str | Column) -> Column:
    """Non-blank lines, each stripped."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), strip),
                    lambda p: p != "")


def pack(parts: Column, limit: int, sep: str = "\n") -> Column:
    """Greedy packing of an array of strings into strings of at most ``limit`` characters.

    A single longer part stays whole. The fold runs inside one cell.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, part: Column) -> Column:
        full = (acc.buf != "") & (F.length(acc.buf) + F.length(part) + 1 > limit)
        return F.struct(
            F.when(full, F.concat(acc.out, F.array(acc.buf))).otherwise(acc.out).alias("out"),
            F.when(full | (acc.buf == ""), part)
            .otherwise(F.concat(acc.buf, F.lit(sep), part)).alias("buf"))

    return F.aggregate(parts, start, step, lambda acc: F.when(
        acc.buf != "", F.concat(acc.out, F.array(acc.buf))).otherwise(acc.out))


def chunk_text(text: str | Column, limit: int = MAX_CHUNK, max_chunks: int | None = None) -> Column:
    """Array of chunks covering the whole text; ``max_chunks`` keeps only the first ones."""
    chunks = pack(paragraphs(text), limit)
    return chunks if max_chunks is None else F.slice(chunks, 1, max_chunks)


def extraction_text(text: str | Column, budget: int = 3000, slices: int = 6) -> Column:
    """Whole text when it fits, else head, evenly spaced slices and the tail."""
    t = strip(text)
    head = budget * 2 // 5
    size = max(40, (budget - head - len(GAP_MARK) * slices) // slices)
    rest = F.substring(t, F.lit(head + 1), F.length(t))
    span = F.greatest(F.lit(1), F.floor((F.length(t) - head) / slices)).cast("int")
    parts = [F.substring(t, 1, head)]
    for i in range(slices - 1):
        parts.append(F.substring(rest, span * i + 1, F.least(span, F.lit(size))))
    parts.append(F.substring(rest, F.greatest(F.length(rest) - size + 1, F.lit(1)), F.lit(size)))
    kept = [parts[0], *[F.when(strip(p) != "", p) for p in parts[1:]]]
    return F.when(F.length(t) <= budget, t).otherwise(F.concat_ws(GAP_MARK, *kept))


def profile_text(title: str | Column, body: str | Column, derived: Column,
                 limit: int = 600) -> Column:
    """Comparison text of an item: title and derived values, else body, else title."""
    values = F.array_join(F.filter(F.map_values(derived), lambda v: v.isNotNull() & (v != "")), "\n")
    body_text = F.substring(strip(F.coalesce(col(body), F.lit(""))), 1, limit)
    return F.substring(
        F.when(strip(values) != "", F.concat(col(title), F.lit("\n"), values))
        .when(body_text != "", body_text).otherwise(col(title)), 1, limit)


def html_text(html: str | Column, decode: Callable[[Column], Column] | None = None) -> Column:
    """Markup to text: scripts and styles dropped, tags to line breaks, entities decoded (``unescape`` by default)."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    t = (decode or unescape)(t)
    return strip(F.regexp_replace(t, r"\n{2,}", "\n"))


def unescape(text: str | Column) -> Column:
    """Every named and numeric character reference, in one pass, so that nothing decodes twice.

    Named ones come from the standard table; of references without a semicolon the old ones are known, longest first.
    Numbers that stand for no character become the replacement mark, 128 to 159 are read as Windows-1252.
    """
    parts = F.regexp_extract_all(col(text), F.lit(rf"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;"
                                                  rf"|&(?:{_OLD_NAMES})|[^&]+|&"), F.lit(0))
    decoded = F.array_join(F.transform(parts, _reference), "")
    return F.when(F.contains(col(text), F.lit("&")), decoded).otherwise(col(text))


def closed_references(text: str | Column, names: Iterable[str]) -> Column:
    """Only the references ``names`` (with their semicolon) decoded; any other, and a cut-off one, stays as it is."""
    t = col(text)
    for name in sorted(names, key=lambda n: n == "amp;"):      # last, so that nothing decodes twice
        t = F.replace(t, F.lit(f"&{name}"), F.lit(unescape_html(f"&{name}")))
    return t


#: The commonest names come first, the look-up goes through the list.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "hellip;")
_NAMES = [*_COMMON, *(n for n in html5 if n not in _COMMON)]
_OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


def _reference(part: Column) -> Column:
    """One piece of text: a reference decoded, anything else as it is."""
    names = F.create_map(*[F.lit(x) for n in _NAMES for x in (n, html5[n])])
    body = F.substring(part, F.lit(2), F.length(part))
    old = F.regexp_extract(body, f"^({_OLD_NAMES})", 1)
    named = F.coalesce(F.try_element_at(names, body), F.when(
        old != "", F.concat(F.try_element_at(names, old), F.substring(body, F.length(old) + 1, F.length(body)))), part)
    digits = F.rtrim(body, F.lit(";"))
    number = F.when(digits.rlike("^#[xX]"), F.conv(F.substring(digits, F.lit(3), F.length(digits)), 16, 10)).otherwise(
        F.substring(digits, F.lit(2), F.length(digits))).try_cast("bigint")
    windows = F.create_map(*[F.lit(x) for n in range(128, 160) for x in (
        n, bytes([n]).decode("cp1252", "ignore") or chr(n))])
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    wrong = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    numeric = F.when(wrong, F.lit("\ufffd")).when(
        number.between(128, 159), F.try_element_at(windows, number.cast("int"))).otherwise(point)
    return F.when(part.rlike("^&#[0-9xX]"), numeric).when(part.rlike("^&[A-Za-z]"), named).otherwise(part)


# ---- views ----------------------------------------------------------------

def unit_text(start_label: Column, end_label: Column, words: Column, speech: Column) -> Column:
    """One block per unit; null when the unit has neither caption nor speech."""
    content = F.concat_ws(
        "\n",
        F.when(F.coalesce(words, F.lit("")) != "", F.concat(F.lit("字幕:"), words)),
        F.when(F.coalesce(speech, F.lit("")) != "", F.concat(F.lit("语音:"), speech)))
    return F.when(strip(content) != "", F.concat(
        F.lit("[单元 "), start_label, F.lit("-"), end_label, F.lit("]\n"), strip(content)))


def item_text(title: Column, type_: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("标题:"), title), F.concat(F.lit("类型:"), type_),
                       F.when(F.coalesce(body, F.lit("")) != "",
                              F.concat(F.lit("内容:"), F.substring(body, 1, 1500))))


def category_line(id_: Column, name: Column, status: Column) -> Column:
    return F.concat(F.lit("- id="), id_.cast("string"), F.lit(" "), name,
                    F.when(status == "proposed", F.lit("(待确认)")).otherwise(F.lit("")))


def payload_summary(payload: str | Column) -> Column:
    """``k=v · k=v`` with values cut to 70 characters; broken JSON is shown raw."""
    m = F.when(col(payload).rlike(r"^\s*\{"), F.from_json(col(payload), "map<string,string>"))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(
        e.key, F.lit("="), F.substring(F.coalesce(e.value, F.lit("None")), 1, 70)))
    joined = F.array_join(pairs, " · ")
    return (F.when(m.isNull(), F.substring(F.coalesce(col(payload), F.lit("")), 1, 120))
            .when(joined == "", F.lit("(空)")).otherwise(joined))


def prompt_render(template: str | Column, category: str | Column, policy: str | Column) -> Column:
    """Fill placeholders; a template without the policy placeholder gets it appended."""
    t = F.replace(F.coalesce(col(template), F.lit("")), F.lit("{category}"), col(category))
    return F.when(F.contains(t, F.lit("{ads_policy}")),
                  F.replace(t, F.lit("{ads_policy}"), col(policy))).otherwise(
        F.concat(t, F.lit("\n- "), col(policy)))


# ---- links and ids --------------------------------------------------------

def jump_link(source_ref: str | Column, start_ts: str | Column) -> Column:
    vid = F.regexp_extract(F.coalesce(col(source_ref), F.lit("")), f"({VIDEO_ID})", 1)
    at = F.coalesce(F.concat(F.lit("?t="), col(start_ts).cast("long").cast("string")), F.lit(""))
    return F.when(vid != "", F.concat(F.lit(JUMP_PREFIX), vid, at))


def media_url(path: str | Column, root: str) -> Column:
    """Path below the media root to a relative url, null outside of it."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(col(path), F.lit(root)), F.concat(
        F.lit("/media/"), F.replace(F.substring(col(path), F.lit(len(root) + 1), F.length(col(path))),
                                    F.lit("\\"), F.lit("/"))))


def id_from_url(target: str | Column, pattern: str = OWNER_PAGE) -> Column:
    """First capture of ``pattern``, else the trimmed text when it is all digits."""
    found = F.regexp_extract(F.coalesce(col(target), F.lit("")), pattern, 1)
    plain = strip(col(target))
    return F.coalesce(F.when(found != "", found), F.when(plain.rlike(r"^\d+$"), plain))


def dedup_hash(*parts: str | Column) -> Column:
    """First 16 hex digits of SHA-1 over the parts joined by ``|``; null counts as blank."""
    return F.substring(F.sha1(F.concat_ws(
        "|", *[F.coalesce(col(p), F.lit("")) for p in parts])), 1, 16)


def contains_any(text: str | Column, words: tuple[str, ...] = AD_WORDS) -> Column:
    return F.coalesce(col(text).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


# ---- category proposals ---------------------------------------------------

def _tails(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def proposal_clean(raw: str | Column) -> Column:
    """Strip trailing characters, one filler, one generic suffix; null when nothing is left."""
    name = F.regexp_replace(F.coalesce(col(raw), F.lit("")), f"[{TRAILING_CHARS}]+$", "")
    name = F.regexp_replace(name, f"({_tails(FILLER_TAILS)})$", "")
    name = F.regexp_replace(name, f"^(.{{2,}})({_tails(GENERIC_TAILS)})$", "$1")
    return F.nullif(name, F.lit(""))


def proposal_strong(reason: str | Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(reason), F.lit("")), STRONG_PROPOSAL, 1), F.lit(""))


def proposal_weak(reason: str | Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(reason), F.lit("")), WEAK_PROPOSAL, 1), F.lit(""))


def proposal_name(reason: str | Column) -> Column:
    return proposal_clean(F.coalesce(proposal_strong(reason), proposal_weak(reason)))


def base_name(name: str | Column) -> Column:
    """The name without one generic suffix, or null when it carries none."""
    stripped = F.regexp_replace(col(name), f"^(.+)({_tails(GENERIC_TAILS)})$", "$1")
    return F.when(stripped != col(name), stripped)
