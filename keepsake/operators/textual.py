"""Text views that need more than one row: item bodies, sheets, category lines, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators.blocks import row_index, top_n

# Fixed values.
SHEET_ROWS = 200
CELL_SEP = " | "
CUT_MARK = "...(截断)"
LOG_LINES, SNIPPET_CHARS = 20, 120


def body_lines(lines: DataFrame, item: str, section: str, seq: str, text: str,
               block_rows: int = 1000) -> DataFrame:
    """An item's body as numbered lines: section 0 (speech) first, then section 1 (screen).

    One row per line, so an item of any length stays distributed; joining the lines of an
    item by line break in ``line_no`` order gives the body text.
    """
    kept = lines.filter(X.strip(text) != "")
    block = F.col(section) * F.lit(1 << 40) + F.floor(F.col(seq) / block_rows)
    return row_index(kept, [item], [section, seq], block, "line_no")


def sheet_lines(rows: DataFrame, sheet: str, order: list[str], cells: list[Column], block: Column) -> DataFrame:
    """All rows of each sheet as numbered lines ``sheet, line_no, line``; lines without a cell are left out.

    One row per line, as in ``body_lines``: a sheet of any length stays distributed. ``block`` cuts a sheet along
    ``order``.
    """
    lines = rows.withColumn("line", F.concat_ws(CELL_SEP, *[c.cast("string") for c in cells])).filter("line <> ''")
    return row_index(lines, [sheet], order, block, "line_no").select(sheet, "line_no", "line")


def sheet_text(rows: DataFrame, sheet: str, order: list[Column], cells: list[Column], cap: int) -> DataFrame:
    """A text per sheet: header, the first ``cap`` rows, a mark when rows were left out. ``sheet_lines`` has them all.

    The cap is applied before rows meet in one place, so at most ``cap`` rows are collected.
    """
    total = rows.groupBy(sheet).agg(F.count(F.lit(1)).alias("_n"))
    line = F.concat_ws(CELL_SEP, *[c.cast("string") for c in cells])
    first = top_n(rows.withColumn("_line", line), [sheet], order, cap, "_rank").filter(
        F.col("_line") != "")
    body = first.groupBy(sheet).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "_line"))), lambda r: r["_line"]), "\n").alias("_body"))
    return body.join(total, sheet).select(sheet, F.concat(
        F.lit("[工作表:"), F.col(sheet), F.lit("]\n"), F.col("_body"),
        F.when(F.col("_n") > cap, "\n" + CUT_MARK).otherwise("")).alias("text"))


def category_lines(categories: DataFrame) -> DataFrame:
    """One line per living category; proposed ones are marked."""
    return (categories.filter(F.col("status") != "archived")
            .withColumn("line", X.category_line(F.col("id"), F.col("name"), F.col("status")))
            .orderBy("domain", "id"))


def context_assembly(profile: DataFrame, logs: DataFrame, hits: DataFrame, user: str,
                     log_order: list[Column], log_lines: int = LOG_LINES) -> DataFrame:
    """One context text per user: profile lines, the newest log lines, hit snippets.

    ``profile(user, domain, key, value)`` has one row per key, ``hits(user, rank, title,
    content)`` is a top-k result; log lines are cut to the newest before they are collected.
    """
    def joined(df: DataFrame, order: Column, line: Column, head: str, name: str) -> DataFrame:
        return df.groupBy(user).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            order.alias("o"), line.alias("l")))), lambda r: r["l"]), "\n").alias("_t")).select(
            user, F.concat(F.lit(head), F.col("_t")).alias(name))

    p = joined(profile, F.struct("domain", "key"), F.concat(
        F.lit("- "), F.col("domain"), F.lit("/"), F.col("key"), F.lit(": "), F.col("value")),
        "画像:\n", "_p")
    newest = top_n(logs, [user], log_order, log_lines, "_rank")
    g = joined(newest, F.col("_rank"), F.concat(
        F.lit("- "), F.col("happened_text"), F.lit(" "), F.col("content_text")), "近期日志:\n", "_g")
    snippet = F.replace(F.substring(F.coalesce("content", F.lit("")), 1, SNIPPET_CHARS), F.lit("\n"), F.lit(" "))
    h = joined(hits, F.col("rank"), F.concat(F.lit("- ["), F.col("title"), F.lit("] "), snippet),
               "相关条目:\n", "_h")
    out = p.join(g, user, "full_outer").join(h, user, "full_outer")
    return out.select(user, F.concat_ws("\n\n", "_p", "_g", "_h").alias("context"))
