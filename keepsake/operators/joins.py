"""Joins: enrichment, interval overlap, nearest boundary, rule matching, exclusion bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.blocks import top_n


def with_category(df: DataFrame, categories: DataFrame, key: str = "category_id") -> DataFrame:
    """Left join of category name and domain. Spark broadcasts the tree while it is small."""
    c = categories.select(F.col("id").alias(key), F.col("name").alias("category_name"),
                          F.col("domain").alias("category_domain"))
    return df.join(c, key, "left")


def titles_or_id(related: DataFrame, items: DataFrame, key: str = "related_id") -> DataFrame:
    """Title of each related id, ``#id`` when the item is gone."""
    names = items.select(F.col("id").alias(key), "title")
    return related.join(names, key, "left").withColumn(
        "title", F.coalesce("title", F.concat(F.lit("#"), F.col(key).cast("string"))))


def _span_level(lo: str, hi: str, width: float) -> Column:
    """The smallest level whose cells, ``width`` * 2 ** level, are as long as the span."""
    long = F.greatest(F.col(hi) - F.col(lo), F.lit(0.0)) / width
    return F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(),
                  F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(long, F.lit(1.0)))))).cast("int")


def span_cells(df: DataFrame, lo: str, hi: str, width: float, levels: Column) -> DataFrame:
    """One row for each of ``levels`` (an array) and cell of that level that the span touches: ``_level, _cell``."""
    size = F.pow(F.lit(2.0), F.col("_level")) * width
    first, last = F.floor(F.col(lo) / size), F.floor(F.greatest(F.col(lo), F.col(hi)) / size)
    return (df.withColumn("_level", F.explode(levels))
            .withColumn("_cell", F.explode(F.sequence(first.cast("long"), last.cast("long")))))


def interval_overlap(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str],
                     b_span: tuple[str, str], width: float, cell_rows: int = 4096) -> DataFrame:
    """Pairs with ``b.end > a.start and b.start < a.end`` inside the same key.

    Dyadic levels: the cells of a level are twice as long as those of the one below, from ``width`` up. A span is stored
    on the level of its own length, in two cells at most, however long it is, and looks for longer ones on the levels
    above that the other side uses, again in two cells each. The equi-join is on (key, level, cell); a pair is kept only
    in the first cell both share on the level of the longer one, so it appears once. The spans stored in a cell are
    dealt into lots of about ``cell_rows``, and what looks there is copied once for each lot, so a hot cell is spread
    over tasks. Spans without start or end meet nothing.
    """
    names = {c: f"_b_{c}" for c in b.columns if c == key}
    left = a.withColumn("_own", _span_level(*a_span, width)).filter("_own IS NOT NULL")
    right = b.withColumn("_own", _span_level(*b_span, width)).filter("_own IS NOT NULL").withColumnsRenamed(names)
    # a few dozen numbers at most: one level for each doubling of the length
    used = [[r[0] for r in d.select("_own").distinct().collect()] for d in (left, right)]

    def met(short: DataFrame, s_key: str, s_span: tuple[str, str], long: DataFrame, l_key: str, l_span: tuple[str, str],
            levels: list[int], equal: bool) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, sorted(levels))).cast("array<int>"),
                         lambda x: (x >= F.col("_own")) if equal else (x > F.col("_own")))
        asks = span_cells(short, *s_span, width, above).withColumnsRenamed(
            {s_key: "_key", "_level": "_l", "_cell": "_c"}).drop("_own")
        held = span_cells(long, *l_span, width, F.array("_own")).drop("_own")
        cell = [l_key, "_level", "_cell"]
        hot = (held.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows)
               .withColumn("_lots", F.ceil(F.col("_n") / cell_rows).cast("int")).drop("_n"))
        lot = F.pmod(F.xxhash64(*[c for c in long.columns if c != "_own"]), F.coalesce("_lots", F.lit(1))).cast("int")
        held = held.join(hot, cell, "left").withColumn("_lot", lot).drop("_lots")
        asks = (asks.join(hot.toDF("_key", "_l", "_c", "_lots"), ["_key", "_l", "_c"], "left")
                .withColumn("_k", F.explode(F.sequence(F.lit(0), F.coalesce("_lots", F.lit(1)) - 1))).drop("_lots"))
        first = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / (F.pow(F.lit(2.0), F.col("_level")) * width))
        return asks.join(held, (F.col("_key") == F.col(l_key)) & (F.col("_l") == F.col("_level"))
                         & (F.col("_c") == F.col("_cell")) & (F.col("_k") == F.col("_lot"))
                         & (F.col(b_span[1]) > F.col(a_span[0])) & (F.col(b_span[0]) < F.col(a_span[1]))
                         & (F.col("_cell") == first.cast("long"))).withColumn(key, F.col("_key"))

    b_key = names.get(key, key)
    out = [c for c in a.columns] + [c for c in b.columns if c != key]
    return (met(left, key, a_span, right, b_key, b_span, used[1], True).select(*out)
            .unionByName(met(right, b_key, b_span, left, key, a_span, used[0], False).select(*out)))


def asof_forward(events: DataFrame, targets: DataFrame, key: str, event_id: list[str], end: str,
                 lo: str, value: str, tolerance: float) -> DataFrame:
    """First target with ``end <= lo <= end + tolerance`` per event; value null when none.

    Time cells of width ``tolerance``: an event probes its own cell and the next one.
    """
    cell = F.floor(F.col(end) / tolerance).cast("long")
    probes = events.select(key, *[c for c in event_id if c != key], F.col(end).alias("_end"),
                           F.explode(F.array(cell, cell + 1)).alias("_cell"))
    t = targets.select(F.col(key).alias("_tkey"), F.col(lo).alias("_lo"), F.col(value).alias("_value"),
                       F.floor(F.col(lo) / tolerance).cast("long").alias("_tcell"))
    hit = (probes.join(t, (F.col(key) == F.col("_tkey")) & (F.col("_cell") == F.col("_tcell"))
                       & (F.col("_lo") >= F.col("_end")) & (F.col("_lo") <= F.col("_end") + tolerance))
           .groupBy(*event_id).agg(F.min_by("_value", F.struct("_lo", "_value")).alias(f"first_{value}")))
    return events.join(hit, event_id, "left")


def nearest_bounds(points: DataFrame, bounds: DataFrame, key: str, point: str, bound: str,
                   block: float) -> DataFrame:
    """Per point the largest bound <= point (``below``) and the smallest >= point (``above``).

    Union of both tables and one scan, cut into blocks of ``block`` along the axis. The last bound before a block and the
    first one after it enter the block as extra rows, so rows are shuffled and sorted once for both directions.
    """
    cols = [c for c in points.columns if c not in (key, point)]
    p = points.select(key, F.col(point).alias("_x"), F.lit(None).cast("double").alias("_b"),
                      F.lit(1).alias("_kind"), *cols)
    b = bounds.select(key, F.col(bound).cast("double").alias("_x"),
                      F.col(bound).cast("double").alias("_b"), F.lit(0).alias("_kind"),
                      *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols])
    both = p.unionByName(b).withColumn("_cell", F.floor(F.col("_x") / F.lit(float(block))))
    blocks = both.groupBy(key, "_cell").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sides = blocks.select(key, "_cell", F.last("_hi", ignorenulls=True).over(earlier).alias("_before"),
                          _next_value("_lo", [key], ["_cell"]).alias("_after"))
    carry = sides.select(key, "_cell", F.explode(F.array(
        F.struct(F.lit(0).alias("_place"), F.col("_before").alias("_b")),
        F.struct(F.lit(2).alias("_place"), F.col("_after").alias("_b")))).alias("_c")).select(
        key, "_cell", "_c.*").filter(F.col("_b").isNotNull())
    place = ["_place", "_x", "_kind"]
    upto = Window.partitionBy(key, "_cell").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_place", F.lit(1)).unionByName(carry, allowMissingColumns=True).withColumns({
        "below": F.last("_b", ignorenulls=True).over(upto),
        "above": _next_value("_b", [key, "_cell"], place)})
    # a bound at the point itself stands before it; points without a place have no neighbours
    return out.filter(F.col("_kind") == 1).withColumn("above", F.when(F.col("below") == F.col("_x"), F.col("below")).when(
        F.col("_x").isNotNull(), F.col("above"))).withColumnRenamed("_x", point).drop("_b", "_kind", "_cell", "_place")


def _next_value(value: str, keys: list[str], order: list[str]) -> Column:
    """The next non-null value along a window; a frame up to its end would be gone through again for each row."""
    return F.expr(f"lead(`{value}`) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY {', '.join(order)})")


def outside_bands(lines: DataFrame, bands: DataFrame, y0: str, y1: str, key: str | None = None,
                  cells: int = 64) -> DataFrame:
    """Lines whose vertical centre lies in no band (``lo``, ``hi``), heights in 0..1.

    The height is cut into cells: a line probes one cell, a band covers a few, so the
    anti join is an equi-join however many bands there are.
    """
    keys = [key] if key else []
    centre = (F.col(y0) + F.col(y1)) / 2
    cover = bands.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"),
                         F.col("hi").alias("_hi"), F.explode(F.sequence(
                             F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))).alias("_cell"))
    on = (F.floor(centre * cells) == F.col("_cell")) & (centre >= F.col("_lo")) & (centre <= F.col("_hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return lines.join(cover, on, "left_anti")


# ---- rules ----------------------------------------------------------------

def match_rules(items: DataFrame, rules: DataFrame, item_id: str = "id") -> DataFrame:
    """First matching rule of each item by (priority desc, rule id).

    Item columns: ``owner_id``, ``domain``, ``source_type``, ``title``. Equality kinds and
    list membership become one equi-join on (kind, value); only substring rules need a
    comparison of every title, done by the single-pass matcher. Every kind is reduced to
    its best rule per item before the kinds are compared.
    """
    from keepsake.operators.keyword import match_terms

    live = rules.filter(F.col("enabled") == 1).select(
        F.col("id").alias("rule_id"), "kind", "target", "priority", "prompt_name")
    best = [F.desc("priority"), F.asc("rule_id")]
    exploded = live.filter(F.col("kind") != "keyword").withColumn("_value", F.explode(
        F.when(F.col("kind") == "up_set", F.filter(
            F.transform(F.split("target", ","), lambda x: F.trim(x)), lambda x: x != ""))
        .otherwise(F.array("target"))))
    exploded = exploded.withColumn("_probe", F.when(F.col("kind") == "up_set", "up")
                                   .otherwise(F.col("kind")))
    # one rule per probed value is enough: the best one
    exploded = top_n(exploded, ["_probe", "_value"], best, 1)
    probes = items.select(F.col(item_id), F.explode(F.array(
        F.struct(F.lit("up").alias("_probe"), F.col("owner_id").cast("string").alias("_value")),
        F.struct(F.lit("domain").alias("_probe"), F.col("domain").alias("_value")),
        F.struct(F.lit("source_type").alias("_probe"), F.col("source_type").alias("_value")),
    )).alias("_p")).select(item_id, "_p.*").filter(F.col("_value").isNotNull())
    equal = probes.join(exploded, ["_probe", "_value"]).select(
        item_id, "rule_id", "priority", "prompt_name")
    words = live.filter((F.col("kind") == "keyword") & (F.coalesce("target", F.lit("")) != ""))
    # likewise one rule per substring: pairs follow the distinct substrings, not the rules that share them
    words = top_n(words, ["target"], best, 1)
    hits = match_terms(items.select(F.col(item_id), "title"), item_id, "title",
                       words.select("rule_id", "target"), "rule_id", "target", fold_case=False)
    sub = hits.join(words, "rule_id").select(item_id, "rule_id", "priority", "prompt_name")
    return top_n(equal.unionByName(sub), [item_id], best, 1)


def owner_rule(items: DataFrame, rules: DataFrame, key: Column) -> DataFrame:
    """Category by owner rule; null when the owner has none."""
    r = rules.select(F.col("owner_id").alias("_owner"), F.col("category_id").alias("rule_category_id"),
                     F.col("owner_name").alias("rule_owner_name"))
    return items.withColumn("_key", key).join(r, F.col("_key") == F.col("_owner"), "left").drop(
        "_key", "_owner")
