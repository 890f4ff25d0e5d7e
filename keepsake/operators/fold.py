"""Greedy left-to-right grouping of ordered series of any length.

Some rules ("close the buffer once it holds 240 characters") depend on where the previous buffer closed, so they are no
window functions. A series is cut into blocks of a fixed number of rows. What a block hands on is a *state*: the row with
which the buffer open at its end began, or none. A block knows for each of its rows which state a buffer begun there ends
in, and buffers soon agree, so there are few states. Every block then learns the states the block before may hand on and
turns each into one of its own: a map of small tables. The states that really occur are found from the maps by pointer
doubling: with each round they reach twice as many blocks further, so a series of a million blocks takes twenty rounds,
whatever the rule. At last every block is grouped once, from its one true state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.blocks import join_nullsafe, row_index
from keepsake.session import reliable

_STATE = "struct<id: long, begin: double, weight: long>"


class _Rule:
    """Where buffers of one block close."""

    def __init__(self, most_weight: int | None, most_span: float, closing_row_inside: bool):
        self.most_weight, self.most_span, self.inside = most_weight, most_span, closing_row_inside

    def full(self, begin: np.ndarray, weight: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """(states, rows): is a buffer begun at ``begin`` with ``weight`` before the block full with each row?"""
        out = ends[None, :] - begin[:, None] >= self.most_span
        if self.most_weight is not None:
            out |= upto[None, :] + weight[:, None] >= self.most_weight
        return out

    def after(self, full: np.ndarray) -> np.ndarray:
        """First row of the next buffer, or -1 where the buffer stays open."""
        return np.where(full.any(1), full.argmax(1) + (1 if self.inside else 0), -1)


def _next(rule: _Rule, begin: np.ndarray, ends: np.ndarray, upto: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row of a block the first row of the buffer after one begun there; -1 if that one stays open."""
    at = np.arange(len(begin))
    full = rule.full(begin, own - upto, ends, upto) & (at[None, :] >= at[:, None] + (0 if rule.inside else 1))
    return rule.after(full)


def _exits(nxt: np.ndarray) -> np.ndarray:
    """For each row (and one past the last) where the buffer open at the end of the block began; -1: none is open."""
    n = len(nxt)
    out = np.full(n + 1, -1)
    for i in range(n - 1, -1, -1):
        out[i] = i if nxt[i] < 0 else out[nxt[i]]
    return out


def _mapped(packed: DataFrame, schema: str, work) -> DataFrame:
    """``work(row)`` for each packed block gives dicts of further columns; ``schema`` lists them."""
    names = [c for c in packed.columns if c not in ("_rows", "_states")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                columns = work(part)
                n = len(columns[0])
                kept = [part.column(c).take(pa.array(np.zeros(n, np.int64))) for c in names]
                out = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(kept + out, [*names, *[f"x{j}" for j in range(len(out))]])

    kinds = dict(packed.dtypes)
    return packed.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), schema]))


def _numbers(part: pa.RecordBatch):
    rows = part.column("_rows").flatten()
    rn, begin, ends, own = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("_rn", "_b", "_e", "_w"))
    return rows, rn, begin, ends, np.cumsum(own), own


def _states(part: pa.RecordBatch):
    held = part.column("_states").flatten()
    return (held.field(c).to_numpy(zero_copy_only=False) for c in ("id", "begin", "weight"))


def greedy_groups(df: DataFrame, keys: list[str], order: list[str], block: Column, fields: list[str], begin: str,
                  end: str, weight: Column | None = None, most_weight: int | None = None,
                  most_span: float = float("inf"), closing_row_inside: bool = True,
                  block_rows: int = 512) -> DataFrame:
    """``keys``, ``fields``, ``_rn`` (position in the series, from 1) and ``_start``, the ``_rn`` of the group's first row.

    A group starts with a series or where the one before closed. It closes with the first row at which its weights sum
    up to ``most_weight`` or ``end`` of the row lies ``most_span`` or more after ``begin`` of its first row; the closing
    row belongs to it, or starts the next one (``closing_row_inside=False``). ``begin`` and ``end`` must not be null.
    """
    rule = _Rule(most_weight, most_span, closing_row_inside)
    rows = row_index(df, keys, order, block, "_rn").withColumns({
        "_part": F.floor((F.col("_rn") - 1) / block_rows).cast("long"), "_b": F.col(begin).cast("double"),
        "_e": F.col(end).cast("double"), "_w": F.lit(0).cast("long") if weight is None else weight.cast("long")})
    packed = reliable(rows.groupBy(*keys, "_part").agg(
        F.sort_array(F.collect_list(F.struct("_rn", "_b", "_e", "_w", *fields))).alias("_rows")))
    slim = packed.select(*keys, "_part", F.transform("_rows", lambda r: F.struct(
        *[r[c].alias(c) for c in ("_rn", "_b", "_e", "_w")])).alias("_rows"))
    ids = [*keys, "_part"]

    def hand_on(part: pa.RecordBatch):
        """The states a block may end in, whatever comes before it, and its exit from none."""
        _, rn, b, e, upto, own = _numbers(part)
        exits = _exits(_next(rule, b, e, upto, own))
        s = np.unique(exits[exits >= 0])
        states = pa.StructArray.from_arrays(
            [pa.array(rn[s]), pa.array(b[s]), pa.array(upto[-1] - upto[s] + own[s])], ["id", "begin", "weight"])
        first = rn[exits[0]] if exits[0] >= 0 else 0
        return [pa.array([states.to_pylist()], pa.list_(states.type)), np.array([first])]

    def turn(part: pa.RecordBatch):
        """(entry, exit, open) of each state of the block before; ``open``: it goes on through the block."""
        _, rn, b, e, upto, own = _numbers(part)
        id_, since, held = _states(part)
        to = rule.after(rule.full(since, held, e, upto))
        exits = _exits(_next(rule, b, e, upto, own))
        last = exits[np.maximum(to, 0)]
        out = np.where(to < 0, id_, np.where(last >= 0, rn[np.maximum(last, 0)], 0))
        through = pa.StructArray.from_arrays([pa.array(id_), pa.array(since), pa.array(held + upto[-1])],
                                             ["id", "begin", "weight"], mask=pa.array(to >= 0))
        return [id_, out, through]

    ahead = lambda d: d.withColumn("_part", F.col("_part") + 1)      # noqa: E731
    own = reliable(_mapped(slim, f"states array<{_STATE}>, first long", hand_on))
    maps = own.select(*ids, F.lit(0).cast("long").alias("entry"), F.col("first").alias("exit"))
    offered = own.select(*ids, F.explode("states").alias("s")).select(*ids, "s.*")
    known = ahead(offered)
    while True:        # once, and again only for buffers that go on through whole blocks
        lists = ahead(offered.groupBy(*ids).agg(F.collect_list(F.struct("id", "begin", "weight")).alias("_states")))
        turned = reliable(_mapped(join_nullsafe(slim, lists, ids, "inner"), f"entry long, exit long, s {_STATE}", turn))
        maps = maps.unionByName(turned.drop("s"))
        offered = turned.filter("s IS NOT NULL").select(*ids, "s.*")
        if offered.isEmpty():
            break
        known = known.unionByName(ahead(offered))

    start = own.filter("_part = 0").select(*ids, F.lit(0).cast("long").alias("entry"))
    blocks = (own.agg(F.max("_part")).first()[0] or 0) + 1
    jump = maps.select(*ids, "entry", (F.col("_part") + 1).alias("to"), F.col("exit").alias("then"))
    reached, steps = start, 1
    while steps < blocks:
        on = [*ids, "entry"]
        further = join_nullsafe(reached, jump, on, "inner").select(*keys, F.col("to").alias("_part"),
                                                                  F.col("then").alias("entry"))
        reached = reliable(reached.unionByName(further))
        steps *= 2
        if steps < blocks:
            onward = jump.select(*keys, F.col("_part").alias("from"), F.col("entry").alias("first"),
                                 F.col("to").alias("_part"), F.col("then").alias("entry"))
            jump = reliable(join_nullsafe(onward, jump, on, "inner").select(
                *keys, F.col("from").alias("_part"), F.col("first").alias("entry"), "to", "then"))
    entered = join_nullsafe(reached, known.withColumnRenamed("id", "entry"), [*ids, "entry"], "left").select(
        *ids, F.array(F.struct(F.col("entry").alias("id"), "begin", F.coalesce("weight", F.lit(0)).alias("weight")))
        .alias("_states"))

    def group(part: pa.RecordBatch):
        rows, rn, b, e, upto, own = _numbers(part)
        (entry,), (since,), (held,) = _states(part)
        at, groups = 0, np.zeros(len(rn), np.int64)
        if entry:
            to = rule.after(rule.full(np.array([since], float), np.array([held]), e, upto))[0]
            at = len(rn) if to < 0 else to
            groups[:at] = entry
        nxt = _next(rule, b, e, upto, own)
        while at < len(rn):
            to = nxt[at] if nxt[at] >= 0 else len(rn)
            groups[at:to] = rn[at]
            at = to
        return [rows.field(c) for c in fields] + [rn, groups]

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in fields), "_rn long, _start long"])
    return _mapped(join_nullsafe(packed, entered, ids, "inner"), schema, group).drop("_part")
