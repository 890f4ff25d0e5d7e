"""Approximate nearest neighbours by random-hyperplane hash tables with multi-probe.

A vector's code in a table is the pattern of sides on which it lies of that table's hyperplanes. Vectors at an angle
share a side with a probability of 1 - angle / pi, so near vectors often share a code. A query looks up its own code and,
in the order in which a neighbour most likely is there, the codes with some of its least certain sides turned (those with
the smallest squared distance to their planes). What it finds is compared exactly.

The number of planes grows with log2 of the corpus so that a bucket keeps about ``bucket_rows`` rows: the rows compared
for a query grow with tables x probes x bucket_rows, not with the corpus. Vectors that many rows share make a large
bucket; buckets and the queries that probe them are split into blocks, and no list of pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.blocks import top_n
from keepsake.operators.retrieval import best_of_rows, matrix

TABLES, PROBES, BUCKET_ROWS = 16, 24, 64
#: least certain sides that probes may turn
TURNED = 10
#: costs of probes that are held at once, 2 ** TURNED for each query and table
COSTS = 1 << 20


def plane_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hyperplanes a table, so that a bucket holds about ``bucket_rows`` of evenly spread rows."""
    return max(1, min(62, math.ceil(math.log2(max(1.0, rows / bucket_rows)))))


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    """(tables, bits, dim) normals, fixed by ``seed``."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def codes(vectors: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) codes and (rows, tables, bits) signed distances to the planes."""
    margin = np.einsum("rd,tbd->rtb", vectors, planes)
    return ((margin > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))), margin


def probe_codes(code: np.ndarray, margin: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes') codes in ascending order of the squared distance that is crossed; the first is ``code``."""
    bits = margin.shape[2]
    turned = min(bits, TURNED)
    least = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :turned]
    cost = np.take_along_axis(margin ** 2, least, axis=2)
    subset = (np.arange(1 << turned)[:, None] >> np.arange(turned)) & 1            # every choice of turned sides
    total = cost @ subset.T.astype(float)
    order = np.argsort(total, axis=2, kind="stable")[:, :, :probes]
    flips = (np.int64(1) << least) @ subset.T.astype(np.int64)
    return code[:, :, None] ^ np.take_along_axis(flips, order, axis=2)


def coded_rows(tables: int, bits: int, several: int) -> int:
    """Vectors coded at once: with probes, their costs stay within ``COSTS`` numbers however many planes there are."""
    return 1024 if several == 1 else max(1, min(1024, COSTS // (tables << min(bits, TURNED))))


def lsh_topk(queries: DataFrame, corpus: DataFrame, k: int, tables: int = TABLES, probes: int = PROBES,
             bucket_rows: int = BUCKET_ROWS, block_rows: int = 8192) -> DataFrame:
    """``qid, cid, sim, rank, compared``: up to k likely nearest corpus rows of every query, without its own id.

    ``queries(qid, qvec)``, ``corpus(cid, cvec)``: LONG ids, unit vectors; rows without a vector are left out.
    ``compared`` is the number of corpus rows a query was compared with (again in every table that found them).
    ``links.knn_join`` is the exact form.
    """
    there = corpus.select("cid", "cvec").filter(F.col("cvec").isNotNull())
    asked = queries.select("qid", "qvec").filter(F.col("qvec").isNotNull())
    schema = "qid long, cid long, sim double, compared long"
    first = there.select(F.size("cvec").alias("d")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], "qid long, cid long, sim double, rank long, compared long")
    rows = there.count()
    lots = -(-rows // block_rows)
    planes = hyperplanes(first.d, tables, plane_count(rows, bucket_rows))

    def coded(id: str, vec: str, several: int, keep: bool):
        step = coded_rows(tables, planes.shape[1], several)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    code, margin = codes(matrix(part.column(vec)), planes)
                    found = probe_codes(code, margin, several) if several > 1 else code[:, :, None]
                    row, table, _ = np.indices(found.shape).reshape(3, -1)
                    columns = [pa.array(table.astype(np.int32)), pa.array(found.ravel())]
                    yield pa.RecordBatch.from_arrays(
                        columns + ([part.column(c).take(pa.array(row)) for c in (id, vec)] if keep else []),
                        names=["tbl", "code"] + ([id, vec] if keep else []))
        return run

    def bucketed(df: DataFrame, id: str, vec: str, several: int, keep: bool = True) -> DataFrame:
        kept = f", {id} long, {vec} {dict(df.dtypes)[vec]}" if keep else ""
        return df.mapInArrow(coded(id, vec, several, keep), f"tbl int, code long{kept}")

    size = lambda df, name: df.groupBy("tbl", "code").agg(F.count(F.lit(1)).alias(name))      # noqa: E731
    both = size(bucketed(there, "cid", "cvec", 1, False), "n_c").join(
        size(bucketed(asked, "qid", "qvec", probes, False), "n_q"), ["tbl", "code"])
    split = both.select("tbl", "code", *(F.ceil(F.col(c) / block_rows).cast("long").alias(c) for c in ("n_c", "n_q")))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))      # noqa: E731
    lot = F.pmod(F.xxhash64("code"), F.lit(lots)).alias("lot")
    left = bucketed(asked, "qid", "qvec", probes).join(split, ["tbl", "code"]).select(
        "tbl", lot, "code", "qid", "qvec", F.pmod(F.xxhash64("qid"), "n_q").alias("qb"), spread("n_c").alias("cb"))
    right = bucketed(there, "cid", "cvec", 1).join(split, ["tbl", "code"]).select(
        "tbl", lot, "code", "cid", "cvec", F.pmod(F.xxhash64("cid"), "n_c").alias("cb"), spread("n_q").alias("qb"))

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["qid", "cid", "sim", "compared"]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)],
                                       [np.zeros(0, np.int64)]]
        if q.num_rows and c.num_rows:
            q, c = q.sort_by("code"), c.sort_by("code")
            cids, qids, there, asked = (t[n].to_numpy() for t, n in ((c, "cid"), (q, "qid"), (c, "code"), (q, "code")))
            cm, qm = matrix(c["cvec"]), matrix(q["qvec"])
            for code in np.intersect1d(there, asked):
                at, to = np.searchsorted(there, code), np.searchsorted(there, code, side="right")
                begin, end = np.searchsorted(asked, code), np.searchsorted(asked, code, side="right")
                for i in range(begin, end, 512):
                    own = qids[i:min(i + 512, end)]
                    sims = qm[i:i + len(own)] @ cm[at:to].T
                    sims[own[:, None] == cids[None, at:to]] = -np.inf
                    row, pick = best_of_rows(sims, cids[at:to], k)
                    once = np.where(np.r_[True, row[1:] != row[:-1]][:len(row)], to - at, 0)
                    for col, x in zip(out, (own[row], cids[at:to][pick], sims[row, pick], once)):
                        col.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=names)

    keys = ["tbl", "lot", "cb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    once = found.groupBy("qid", "cid").agg(F.max("sim").alias("sim"), F.sum("compared").alias("n"))
    best = top_n(once, ["qid"], [F.desc("sim"), F.col("cid")], k, "rank")
    compared = found.groupBy("qid").agg(F.sum("compared").alias("compared"))
    return best.join(compared, "qid").select("qid", "cid", "sim", "rank", "compared")
