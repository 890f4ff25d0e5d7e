"""Item links: exact nearest-neighbour join, item-level score, both-way reading."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.blocks import top_n
from keepsake.operators.retrieval import best_of_rows, matrix, unit
from keepsake.session import reliable

# Candidate chunks, averaged matches, threshold, links per item.
CANDIDATES, BEST, THRESHOLD, MAX_PER_ITEM = 40, 3, 0.62, 3
#: rows of the cells that are compared in one task; small tables take smaller lots
LOT_ROWS = 32768


@dataclass(frozen=True)
class Placement:
    """Corpus rows in their cells and lots of cells, the cells every query visits in a lot, and rows and visits of both."""

    placed: DataFrame       # cid, cgroup, cvec, cell, lot
    visits: DataFrame       # qid, qgroup, qvec, lot, cells
    cells: DataFrame        # cell, rows, asked
    lots: DataFrame         # lot, rows, asked

    def report(self) -> DataFrame:
        """One row: ``cells``, ``visits``, ``pairs`` compared, and ``all_pairs`` without cells."""
        return self.cells.agg(
            F.count(F.lit(1)).alias("cells"), F.sum("asked").alias("visits"),
            F.sum(F.col("rows") * F.col("asked")).alias("pairs"),
            (F.sum("rows") * F.lit(self.visits.select("qid").distinct().count())).alias("all_pairs"))


def place(queries: DataFrame, corpus: DataFrame, k: int) -> Placement:
    """Two levels of cells for an exact nearest-neighbour join.

    Of n corpus rows a fixed sample of 2 sqrt(n) become cell centres; the square root of that number of them also lead a
    group of cells. A row goes to the nearest leader and, in its group, to the nearest centre. Every query first meets its
    nearest cells, as many as hold 4 k rows; its k-th best similarity there is a lower bound. By the triangle inequality
    on angles, groups and then cells whose ring (the least and largest angle to the leader, or centre) can't reach that
    bound are skipped. Neighbouring cells make a lot of up to ``LOT_ROWS`` rows; a query's vector is kept once for each
    lot it visits, with the list of its cells there, so that visits don't grow with the number of cells. Placement and
    visits are written once. The driver holds the centres and one row for each cell.
    """
    spark = queries.sparkSession
    base = corpus.select("cid", "cgroup", "cvec").filter(F.col("cvec").isNotNull())
    n = base.count()
    n_cells = max(1, 2 * math.isqrt(n))
    sample = base.orderBy(F.xxhash64("cid"), "cid").limit(n_cells).collect()
    centres = unit(np.array([r.cvec for r in sample], dtype=np.float64).reshape(
        len(sample), len(sample[0].cvec) if sample else 1))
    leaders = centres[:math.isqrt(n_cells - 1) + 1]
    led = (centres @ leaders.T).argmax(axis=1) if len(sample) else np.zeros(0, int)
    shared = spark.sparkContext.broadcast((centres, leaders, led))      # about 2 sqrt(n) vectors

    def angles(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(rows @ to.T, -1.0, 1.0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, leaders, led = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rows = unit(matrix(b.column("cvec")))
            outer = angles(rows, leaders)
            leader = outer.argmin(axis=1)
            cell, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for g in np.unique(leader):
                at, own = np.flatnonzero(leader == g), np.flatnonzero(led == g)
                inner = angles(rows[at], centres[own])
                cell[at], angle[at] = own[inner.argmin(axis=1)], inner.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("cid"), b.column("cgroup"), b.column("cvec"), pa.array(cell), pa.array(angle),
                 pa.array(outer[np.arange(len(rows)), leader])],
                names=["cid", "cgroup", "cvec", "cell", "angle", "outer"])

    placed = reliable(base.mapInArrow(
        assign, "cid long, cgroup long, cvec array<float>, cell int, angle double, outer double"))
    rings = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
        F.min("outer").alias("outer_lo"), F.max("outer").alias("outer_hi")).orderBy("cell").collect()
    number = np.array([r.cell for r in rings], dtype=np.int32)
    ring = np.array([(r.lo, r.hi, r.outer_lo, r.outer_hi, r.rows) for r in rings]).reshape(len(rings), 5)
    near_by = np.lexsort((number, led[number])) if len(number) else number
    before = np.cumsum(ring[near_by, 4]) - ring[near_by, 4]
    lot_of = np.zeros(len(centres) + 1, np.int32)
    lot_of[number[near_by]] = before // min(LOT_ROWS, max(1024, n // 64))
    table = spark.sparkContext.broadcast((number, ring, lot_of))        # one row for each cell
    lot_table = spark.createDataFrame([(int(c), int(lot_of[c])) for c in number], "cell int, lot int")
    placed = placed.join(F.broadcast(lot_table), "cell")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may hold a row as similar as ``bound``; without one, the nearest cells with 4 k rows."""
        centres, leaders, led = shared.value
        number, ring, lot_of = table.value
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)) if len(number) else ():
                rows = unit(matrix(b.column("qvec")))
                bound = b.column("bound").to_numpy(zero_copy_only=False)
                if np.isnan(bound).all():
                    near = np.argsort(angles(rows, centres[number]), axis=1, kind="stable")
                    held = np.cumsum(ring[near, 4], axis=1)
                    row, col = np.nonzero(held - ring[near, 4] < 4 * k)
                    taken, cells = [row], [number[near[row, col]]]
                else:
                    # Stored floats are unit length up to rounding; -inf reaches everything.
                    reach = np.arccos(np.clip(bound - 1e-5, -1.0, 1.0)) + 1e-9
                    outer = angles(rows, leaders)
                    taken, cells = [], []
                    for g in np.unique(led[number]):
                        of = np.flatnonzero(led[number] == g)
                        near = np.maximum(outer[:, g] - ring[of, 3].max(), ring[of, 2].min() - outer[:, g])
                        at = np.flatnonzero(near <= reach)
                        inner = angles(rows[at], centres[number[of]])
                        row, col = np.nonzero(np.maximum(inner - ring[of, 1], ring[of, 0] - inner) <= reach[at, None])
                        taken.append(at[row])
                        cells.append(number[of][col])
                row, cell = np.concatenate(taken), np.concatenate(cells)
                order = np.lexsort((cell, lot_of[cell], row))
                row, cell = row[order], cell[order]
                lot = lot_of[cell]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lot[1:] != lot[:-1])][:len(row)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)),
                                                 pa.array(cell.astype(np.int32)))
                picked = b.drop_columns(["bound"]).take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lot[new]), lists],
                                                 names=["qid", "qgroup", "qvec", "lot", "cells"])

    def placement(asked: DataFrame) -> Placement:
        visits = reliable(asked.mapInArrow(
            visit, "qid long, qgroup long, qvec array<float>, lot int, cells array<int>"))
        counted = lambda of, by: (placed.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
                                  .join(of.groupBy(by).agg(F.count(F.lit(1)).alias("asked")), by))
        return Placement(placed.drop("angle", "outer"), visits,
                         counted(visits.select(F.explode("cells").alias("cell")), "cell"), counted(visits, "lot"))

    asked = queries.select("qid", "qgroup", "qvec").filter(F.col("qvec").isNotNull())
    first = multiplied(placement(asked.withColumn("bound", F.lit(None).cast("double"))), k)
    bounds = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("bound"))
    return placement(asked.join(bounds, "qid", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("-inf")))))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int = LOT_ROWS) -> DataFrame:
    """The k nearest corpus rows of another group for every query row, exact, for large tables.

    ``queries(qid, qgroup, qvec)``, ``corpus(cid, cgroup, cvec)``; ids and groups are LONG, vectors unit length.
    Result ``(qid, qgroup, cid, cgroup, sim)``, at most k per query.

    Cells, lots and visits come from ``place``, by one plan for every number of rows. A lot's rows and the visits to it
    are split by hash into blocks of about ``block_rows``; each side is copied once for every block of the other, so a
    side of one block is all that is copied. A task multiplies the cells of one block pair with the queries that visit
    them and returns at most k rows per query.
    """
    return multiplied(place(queries, corpus, k), k, block_rows)


def multiplied(placement: Placement, k: int, block_rows: int = LOT_ROWS) -> DataFrame:
    """The nearest rows of a ``Placement``; see ``knn_join``."""
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("long")       # noqa: E731
    split = placement.lots.select("lot", blocks("rows").alias("n_c"), blocks("asked").alias("n_q"))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))      # noqa: E731
    left = placement.visits.join(split, "lot").select(
        "qid", "qgroup", "qvec", "cells", "lot", F.pmod(F.xxhash64("qid"), "n_q").alias("qb"), spread("n_c").alias("cb"))
    right = placement.placed.join(split, "lot").select(
        "cid", "cgroup", "cvec", "cell", "lot", F.pmod(F.xxhash64("cid"), "n_c").alias("cb"), spread("n_q").alias("qb"))

    def multiply(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["qid", "qgroup", "cid", "cgroup", "sim"]
        types = [pa.int64()] * 4 + [pa.float64()]
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        c = c.sort_by("cell")
        cids, groups, cell = c["cid"].to_numpy(), c["cgroup"].to_numpy(), c["cell"].to_numpy()
        qids, mine = q["qid"].to_numpy(), q["qgroup"].to_numpy()
        cm = matrix(c["cvec"])
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[starts[1:], len(cell)]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for at in range(0, q.num_rows, 128):       # similarity strips of bounded memory
            strip = q.slice(at, 128)
            qm, lists = matrix(strip["qvec"]), strip["cells"].combine_chunks()
            asked = lists.flatten().to_numpy()
            asker = np.repeat(np.arange(len(qm)), lists.value_lengths().to_numpy(zero_copy_only=False))
            sims = np.full((len(qm), len(cm)), -np.inf)
            for start, end in zip(starts, ends):
                of = asker[asked == cell[start]]
                sims[of, start:end] = qm[of] @ cm[start:end].T
            sims[mine[at:at + len(sims), None] == groups[None, :]] = -np.inf
            row, pick = best_of_rows(sims, cids, k)
            for col, x in zip(out, (qids[at + row], mine[at + row], cids[pick], groups[pick], sims[row, pick])):
                col.append(x)
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(out, types)], names=names)

    pairs = left.groupBy("lot", "cb", "qb").cogroup(right.groupBy("lot", "cb", "qb")).applyInArrow(
        multiply, "qid long, qgroup long, cid long, cgroup long, sim double")
    return top_n(pairs, ["qid"], [F.desc("sim"), F.col("cid")], k)


def item_scores(candidates: DataFrame, best: int = BEST) -> DataFrame:
    """Mean of the best similarities per (item, other item) among the candidates."""
    top = top_n(candidates, ["qgroup", "cgroup"], [F.desc("sim"), F.col("cid")], best)
    return top.groupBy(F.col("qgroup").alias("item_id"), F.col("cgroup").alias("related_id")).agg(
        F.avg("sim").alias("score"))


def build_links(profiles: DataFrame, chunks: DataFrame, candidates: int = CANDIDATES, best: int = BEST,
                threshold: float = THRESHOLD, max_per_item: int = MAX_PER_ITEM) -> DataFrame:
    """Related items ``(item_id, related_id, score)`` of every profile.

    ``profiles(item_id, embedding)`` one row per item, ``chunks(chunk_id, item_id, embedding)``.
    """
    near = knn_join(
        profiles.select(F.col("item_id").alias("qid"), F.col("item_id").alias("qgroup"),
                        F.col("embedding").alias("qvec")),
        chunks.select(F.col("chunk_id").alias("cid"), F.col("item_id").alias("cgroup"),
                      F.col("embedding").alias("cvec")), candidates)
    kept = item_scores(near, best).filter(F.col("score") >= threshold)
    return top_n(kept, ["item_id"], [F.desc("score"), F.col("related_id")], max_per_item)


def replace_links(old: DataFrame, new: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Own claims of the recomputed items are replaced, claims of others stay.

    ``old``/``new`` are ``(item_a, item_b, score)``; ``recomputed(item_a)`` also lists items
    that lost all their links.
    """
    kept = old.join(recomputed.select("item_a").distinct(), "item_a", "left_anti")
    return kept.unionByName(new.withColumn("score", F.bround("score", 4)))


def both_ways(links: DataFrame) -> DataFrame:
    """Symmetric view: every pair from both sides with its larger score."""
    mirrored = links.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "score")
    return links.select("item_a", "item_b", "score").unionByName(mirrored).groupBy("item_a", "item_b").agg(
        F.max("score").alias("score"))


def links_read(links: DataFrame, items: DataFrame, limit_per: int = MAX_PER_ITEM) -> DataFrame:
    """Best related items of each item from both sides, positive scores only, with titles."""
    from keepsake.operators.joins import titles_or_id

    best = top_n(both_ways(links).filter(F.col("score") > 0), ["item_a"],
                 [F.desc("score"), F.col("item_b")], limit_per)
    return titles_or_id(best.withColumnRenamed("item_b", "related_id"), items)
