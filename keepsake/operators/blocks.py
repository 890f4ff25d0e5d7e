"""Ordered scans over series of any length.

A plain ``Window.partitionBy(series)`` puts one whole series into one task. Here every
series is cut into *blocks* along its order column (a time bucket, or any other column
that never decreases along the order). Windows run inside ``(series, block)``; what a
block must know about earlier blocks is one summary row per block, carried forward by a
window over the summaries only. A series that holds a third of all rows is therefore
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_block(ts: str | Column, seconds: float) -> Column:
    """Block number of a timestamp or of a number of seconds."""
    return F.floor(_col(ts).cast("timestamp").cast("double") / F.lit(float(seconds)))


def value_block(value: str | Column, width: float) -> Column:
    return F.floor(_col(value).cast("double") / F.lit(float(width)))


def join_nullsafe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys; the other side's keys are dropped."""
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def row_index(df: DataFrame, keys: list[str], order: list[str], block: Column,
              name: str = "rn") -> DataFrame:
    """1-based position of every row in its series, exact for series of any length."""
    return running(df, keys, order, block, sums={name: F.lit(1).cast("long")})


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, *,
            last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Running ``last non-null`` and ``sum`` along each series.

    ``last[name]`` is the latest non-null value of the expression up to the row,
    ``sums[name]`` the running total. With ``inclusive=False`` the row itself is left out,
    which makes ``last`` of a never-null expression the previous row's value (``lag``).
    ``totals[name]`` is the sum over the whole series, on every row.

    What earlier blocks pass on enters each block as one extra row in front, so the rows
    themselves are shuffled once, by series and block, and joined with nothing.
    """
    last, sums, totals = last or {}, sums or {}, totals or {}
    df = df.withColumns({"_block": block, **{f"_x_{n}": e for n, e in {**last, **sums, **totals}.items()}})
    position = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), position)).alias(f"_c_{n}")
            for n in last]
    aggs += [F.sum(f"_x_{n}").alias(f"_c_{n}") for n in {**sums, **totals}]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = df.groupBy(*keys, "_block").agg(*aggs).select(
        *keys, "_block", F.lit(0).alias("_main"),
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_x_{n}") for n in last],
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_x_{n}") for n in sums],
        *[F.sum(f"_c_{n}").over(Window.partitionBy(*keys)).alias(f"_x_{n}") for n in totals])
    end = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*keys, "_block").orderBy("_main", *order).rowsBetween(
        Window.unboundedPreceding, end)
    both = df.withColumn("_main", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    front = F.when(F.col("_main") == 0, True)
    out = both.withColumns({
        **{n: F.first(F.when(front, F.col(f"_x_{n}")), ignorenulls=True).over(local) for n in totals},
        **{n: F.last(f"_x_{n}", ignorenulls=True).over(local) for n in last},
        **{n: F.coalesce(F.sum(f"_x_{n}").over(local), F.lit(0)) for n in sums}})
    return out.filter(F.col("_main") == 1).drop(
        "_block", "_main", *[f"_x_{n}" for n in {**last, **sums, **totals}])


def previous(df: DataFrame, keys: list[str], order: list[str], block: Column,
             columns: dict[str, Column]) -> DataFrame:
    """The previous row's values (null on the first row of a series)."""
    boxed = {n: F.struct(c.alias("v")) for n, c in columns.items()}
    out = running(df, keys, order, block, last=boxed, inclusive=False)
    return out.withColumns({n: F.col(f"{n}.v") for n in columns})


def islands(df: DataFrame, keys: list[str], pos: str, block: Column,
            breaks: Callable[[Column, Column], Column],
            aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Gaps and islands: merge rows, ordered by ``pos``, into runs.

    A row starts a new run when ``breaks(pos, previous_pos)``. ``aggs`` maps an output
    column to ``(kind, expression)`` with kind ``min``, ``max`` or ``sum``. Expressions used
    by ``breaks`` besides the positions must be constant inside a series and are listed in
    ``keys``. Runs are built inside each block first; only the runs that touch a block edge
    take part in the merge across blocks.
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    df = df.withColumn("_block", block)
    local = Window.partitionBy(*keys, "_block").orderBy(pos)
    before = F.lag(pos).over(local)
    df = df.withColumn("_isl_new", F.when(before.isNull() | breaks(F.col(pos), before), 1).otherwise(0))
    df = df.withColumn("_isl_run", F.sum("_isl_new").over(local.rowsBetween(
        Window.unboundedPreceding, Window.currentRow)))
    runs = df.groupBy(*keys, "_block", "_isl_run").agg(
        F.min(pos).alias("_isl_lo"), F.max(pos).alias("_isl_hi"),
        *[fold[kind](expr).alias(name) for name, (kind, expr) in aggs.items()])
    edge = Window.partitionBy(*keys, "_block")
    touches = (F.col("_isl_run") == 1) | (F.col("_isl_run") == F.max("_isl_run").over(edge))
    # Edge runs of a series meet in one partition, every other run stays with its block.
    runs = runs.withColumn("_isl_edge", touches).withColumn(
        "_isl_part", F.when(~F.col("_isl_edge"), F.col("_block")))
    across = Window.partitionBy(*keys, "_isl_part").orderBy("_isl_lo")
    before = F.lag("_isl_hi").over(across)
    runs = runs.withColumn("_isl_new", F.when(
        before.isNull() | ~F.col("_isl_edge") | breaks(F.col("_isl_lo"), before), 1).otherwise(0))
    runs = runs.withColumn("_isl_grp", F.sum("_isl_new").over(across.rowsBetween(
        Window.unboundedPreceding, Window.currentRow)))
    return (runs.groupBy(*keys, "_isl_part", "_isl_grp")
            .agg(*[fold[kind](name).alias(name) for name, (kind, _) in aggs.items()])
            .drop("_isl_part", "_isl_grp"))


def _value_ranks(df: DataFrame, keys: list[str], value: str, ranks: list[Column],
                 resolution: int) -> DataFrame:
    """Distinct values with the zero-based ranks they cover (``_first``, ``_n``), per key.

    Equal values are counted map-side first. The counts are summed per value cell (a
    monotone cell of ``log2(1 + |v|)``); only the cells that hold one of ``ranks``
    (expressions of ``_total``) are then ranked value by value.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_cell", F.floor(F.signum("_v") * F.log2(1 + F.abs("_v")) * resolution)))
    upto = Window.unboundedPreceding
    along = Window.partitionBy(*keys).orderBy("_cell")
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn")).withColumns({
        "_before": F.coalesce(F.sum("_cn").over(along.rowsBetween(upto, -1)), F.lit(0)),
        "_total": F.sum("_cn").over(Window.partitionBy(*keys))})
    needed = reduce(or_, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_cn")) for r in ranks])
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(upto, Window.currentRow)
    return join_nullsafe(counts, cells.filter(needed).drop("_cn"), [*keys, "_cell"], "inner").withColumn(
        "_first", F.col("_before") - F.col("_n") + F.sum("_n").over(inside))


def _at_rank(rank: Column) -> Column:
    return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col("_v")))


def _between(lo: Column, hi: Column, w: Column) -> Column:
    """lo (1 - w) + hi w with the first product unrounded, so that a level does not miss a value by a last bit.

    Halves of 26 bits give the part of the product that a double loses. Values too large to be split are weighted plainly.
    """
    def halves(x: Column) -> tuple[Column, Column]:
        big = x * F.lit(134217729.0)       # 2 ** 27 + 1
        top = big - (big - x)
        return top, x - top

    v = F.lit(1.0) - w
    p, c = lo * v, hi * w
    (a, b), (d, e) = halves(lo), halves(v)
    lost = ((a * d - p) + a * e + b * d) + b * e
    s = p + c
    back = s - p
    fine = s + (((p - (s - back)) + (c - back)) + lost)
    return F.when(lo == hi, lo).when(F.isnan(fine), lo + (hi - lo) * w).otherwise(fine)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float],
                      resolution: int = 64, total: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    ``total`` adds the number of values.
    """
    at = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in ps.items()}
    ranked = _value_ranks(df, keys, value, [f(x) for x in at.values() for f in (F.floor, F.ceil)], resolution)
    aggs = []
    for name, x in at.items():
        aggs += [_at_rank(F.floor(x)).alias(f"_lo_{name}"), _at_rank(F.ceil(x)).alias(f"_hi_{name}"),
                 F.max(x - F.floor(x)).alias(f"_w_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs, F.max("_total").alias("_total"))
    return out.select(*keys, *[
        _between(F.col(f"_lo_{n}").cast("double"), F.col(f"_hi_{n}").cast("double"), F.col(f"_w_{n}")).alias(n)
        for n in ps], *([F.col("_total").alias(total)] if total else []))


def rank_pick(df: DataFrame, keys: list[str], value: str, name: str, at: Column,
              resolution: int = 64) -> DataFrame:
    """The value at zero-based sorted position ``at`` (an expression of ``_total``), per key."""
    return _value_ranks(df, keys, value, [at], resolution).groupBy(*keys).agg(_at_rank(at).alias(name))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark prunes to ``n`` rows per key before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_n(df: DataFrame, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of the whole table, optionally numbered.

    The limit runs as a distributed top-n; only its ``n`` rows are numbered in one task.
    """
    out = df.orderBy(*order).limit(n)
    if rank is None:
        return out
    return out.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
