"""Captures: validation, dedup key, routing, and the item and chunk rows they become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.schemas import ddl

# Names and defaults of a capture.
UNTITLED = "未命名摘录"
UNTITLED_CLIP = "剪贴板摘录"
UNKNOWN_PRODUCT = "未知商品"
LINK_PREFIX = "链接:"
TITLE_CHARS, PREVIEW_CHARS, LINK_TITLE_CHARS = 40, 4000, 60


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ddl("capture")).json(folder)


def stream_captures(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ddl("capture")).json(folder)


def shape_captures(captures: DataFrame) -> DataFrame:
    """Add ``job_type``, ``domain``, ``dedup_key`` and ``reject_reason`` (null when valid)."""
    kind, url = F.col("type"), F.coalesce("url", F.lit(""))
    text = X.strip(F.coalesce("text", F.lit("")))
    name = F.coalesce("product.name", F.lit(""))
    source = F.coalesce(F.nullif("video.id", F.lit("")), F.nullif("url", F.lit("")))
    is_text = kind.isin("selection", "page")
    key = (F.when(kind == "video", X.dedup_hash(F.lit("video"), source))
           .when(is_text, X.dedup_hash(kind, url, F.substring(text, 1, 200)))
           .when(kind == "product", X.dedup_hash(F.lit("product"), url, name)))
    reject = (F.when(~F.coalesce(kind.isin("video", "selection", "page", "product"), F.lit(False)),
                     "unknown type")
              .when((kind == "video") & source.isNull(), "video needs url or id")
              .when(is_text & (text == ""), "text is empty")
              .when((kind == "product") & (name == "") & (F.coalesce("title", F.lit("")) == ""),
                    "product needs name or title"))
    return captures.withColumns({
        "job_type": F.when(kind == "video", "ingest_video").when(is_text, "ingest_text")
        .when(kind == "product", "ingest_product"),
        "domain": F.coalesce(F.nullif("domain", F.lit("")), F.when(
            kind == "product", "shopping").otherwise("general")),
        "source": F.when(kind == "video", source).otherwise(F.col("url")),
        "clean_text": text,
        "dedup_key": key,
        "reject_reason": reject})


def split_valid(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (shaped.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            shaped.filter(F.col("reject_reason").isNotNull()))


def text_items(shaped: DataFrame) -> DataFrame:
    """Selections and pages as one item each; ``body`` keeps the whole text for chunking."""
    text = F.col("clean_text")
    title = X.strip(F.coalesce(F.nullif("title", F.lit("")),
                               F.nullif(F.substring(text, 1, TITLE_CHARS), F.lit("")), F.lit(UNTITLED)))
    return shaped.filter(F.col("job_type") == "ingest_text").select(
        "dedup_key", "domain",
        F.when(F.col("type") == "selection", "note").otherwise("page").alias("type"),
        title.alias("title"), F.substring(text, 1, PREVIEW_CHARS).alias("content_text"),
        text.alias("body"), F.lit("webpage").alias("source_type"), F.col("url").alias("source_ref"))


def product_items(products: DataFrame) -> DataFrame:
    """Product columns (name, title, url, price, image_url, shop) to item and summary chunk."""
    name = X.strip(F.coalesce(F.nullif("name", F.lit("")), F.nullif("title", F.lit("")),
                              F.lit(UNKNOWN_PRODUCT)))
    attrs = F.map_filter(
        F.create_map(*[x for k in ("price", "image_url", "shop") for x in (F.lit(k), F.col(k))]),
        lambda k, v: v.isNotNull() & (v != ""))
    summary = F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(
        e.key, F.lit(":"), e.value)), " ")
    return products.withColumns({
        "title": name, "attrs_json": F.to_json(attrs),
        "chunk": F.concat(name, F.lit(" "), summary, F.lit(" "), F.coalesce("url", F.lit("")))})


def file_kind(path: Column) -> Column:
    """video, image, document or file by extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return (F.when(ext.isin(*X.VIDEO_EXT), "video").when(ext.isin(*X.IMAGE_EXT), "image")
            .when(ext.isin(*X.DOC_EXT), "document").otherwise("file"))


def route_text(df: DataFrame, content: str) -> DataFrame:
    """Route raw captured text: video url, other url or plain text, with title and key."""
    c = X.strip(F.col(content))
    url = F.startswith(c, F.lit("http"))
    video = url & c.rlike(X.VIDEO_PAGE)
    first = F.substring(X.strip(F.element_at(F.split(c, "\n"), 1)), 1, TITLE_CHARS)
    kind = (F.when(c == "", "empty").when(video, "video").when(url, "link").otherwise("text"))
    return df.withColumns({
        "kind": kind,
        "title": F.when(url, F.substring(c, 1, LINK_TITLE_CHARS)).otherwise(
            F.coalesce(F.nullif(first, F.lit("")), F.lit(UNTITLED_CLIP))),
        "dedup_key": X.dedup_hash(kind, c)})


def page_fields(pages: DataFrame, html: str = "html", url: str = "url",
                decode: Callable[[Column], Column] = X.unescape) -> DataFrame:
    """Kind by host, title, language, price, image, link count and body text of raw pages.

    ``kind`` is video, product or page; a user's selection arrives as a capture instead. ``decode`` reads the character
    references.
    """
    h = F.col(html)
    host = F.regexp_replace(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")),
                            r"^www\.", "")
    shop = F.lit(None).cast("string")
    for name, pattern in X.PRODUCT_HOSTS.items():
        shop = F.coalesce(shop, F.when(host.rlike(pattern), F.lit(name)))
    meta = lambda p: F.nullif(decode(F.regexp_extract(
        h, rf'(?i)<meta[^>]*property="{p}"[^>]*content="([^"]*)"', 1)), F.lit(""))
    price = F.regexp_extract(h, r'(?is)class="price"[^>]*>([^<]*)<', 1)
    return pages.withColumns({
        "kind": F.when(F.col(url).rlike(X.VIDEO_PAGE), "video")
        .when(shop.isNotNull(), "product").otherwise("page"),
        "host": host, "shop": shop,
        "title": X.strip(decode(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))),
        "page_lang": F.regexp_extract(h, r'(?i)<html[^>]*lang="([^"]*)"', 1),
        "price": F.nullif(F.substring(F.regexp_replace(X.strip(price), r"\s+", " "), 1, 20), F.lit("")),
        "image_url": meta("og:image"),
        "n_links": F.regexp_count(h, F.lit("(?i)<a\\s")),
        "text": X.html_text(F.regexp_replace(h, r"(?is)<title[^>]*>.*?</title>", " "), decode)})


def timed_comments(payloads: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Timed comments ``(ts, text, mode)`` from xml payloads; rows without a number are dropped."""
    pattern = r'<d p="([^"]+)">([\s\S]*?)</d>'
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(payload), F.lit(pattern), F.lit(1)).alias("p"),
        F.regexp_extract_all(F.col(payload), F.lit(pattern), F.lit(2)).alias("t"))
    rows = payloads.select(*keep, F.posexplode(both).alias("pos", "d"))
    parts = F.split(F.col("d.p"), ",")
    mode = F.try_element_at(parts, F.lit(2))
    ts = F.element_at(parts, 1)
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return rows.filter(ts.rlike(number)).select(
        *keep, "pos", F.trim(ts).cast("double").alias("ts"), X.strip(F.col("d.t")).alias("text"),
        F.when(mode.rlike(r"^\d+$"), mode.try_cast("int")).alias("mode")).withColumn(
        "mode", F.coalesce("mode", F.lit(1)))


def speech_segments(raw: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Round times to two digits, strip the text and drop blank segments."""
    return raw.withColumns({start: F.bround(start, 2), end: F.bround(end, 2),
                            "text": X.strip("text")}).filter(F.col("text") != "")


def listing_report(listing: DataFrame, known: DataFrame, source: str, key: str,
                   first_run: str) -> tuple[DataFrame, DataFrame]:
    """Incremental listing: the unseen keys and a per-source report.

    ``listing(source, key, first_run)``. Keys are global: a key is registered once, by the
    smallest source that lists it. On a first run unseen keys are seeded, later they are new.
    """
    one = listing.groupBy(key).agg(F.min(F.struct(F.col(source), F.col(first_run))).alias("_s"))
    unseen = one.join(known.select(key).distinct(), key, "left_anti").select(
        key, F.col(f"_s.{source}").alias(source), F.col(f"_s.{first_run}").alias(first_run))
    total = listing.groupBy(source).agg(F.count(F.lit(1)).alias("total"))
    counts = unseen.groupBy(source).agg(
        F.count_if(~F.col(first_run)).alias("new"), F.count_if(F.col(first_run)).alias("seeded"))
    report = total.join(counts, source, "left").na.fill(0, ["new", "seeded"])
    return unseen, report


def listing_totals(listing: DataFrame, known: DataFrame, source: str, key: str, accepted: Column) -> DataFrame:
    """Per source: all listed rows (``total``), those of another type or without key (``skipped``), ``new`` and ``existed``.

    Rows are listings as they come, also repeated ones. A key is new once, for the smallest source that lists it; again
    in the same or another source, or among ``known``, it exists.
    """
    taken = F.coalesce(accepted, F.lit(False)) & F.col(key).isNotNull()
    totals = listing.groupBy(source).agg(F.count(F.lit(1)).alias("total"), F.count_if(~taken).alias("skipped"))
    first = listing.filter(taken).groupBy(key).agg(F.min(source).alias(source))
    new = first.join(known.select(key).distinct(), key, "left_anti").groupBy(source).agg(F.count(F.lit(1)).alias("new"))
    return totals.join(new, source, "left").na.fill(0, ["new"]).withColumn(
        "existed", F.col("total") - F.col("skipped") - F.col("new")).select(source, "total", "skipped", "new", "existed")


def register_seen(known: DataFrame, unseen: DataFrame, key: str, first_run: str) -> DataFrame:
    """The key registry after a check: seeded keys are done, new keys are pending."""
    added = unseen.select(key, F.when(F.col(first_run), "done").otherwise("pending").alias("status"))
    return known.select(key, "status").unionByName(added)


