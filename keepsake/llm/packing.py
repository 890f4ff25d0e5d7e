"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents become pieces: a document of at most ``limit`` tokens is one piece, a longer one is cut into full pieces
behind a first piece with the rest. Packing only depends on piece lengths, so it is planned on their histogram: at most
``limit`` numbers, whatever the size of the corpus. A sequence is filled greedily, longest fitting piece first; then its
smallest piece is taken out where two other pieces fill the widened gap more tightly. Equal sequences are planned
together. The plan says which ranks of a length go to which sequences; pieces get their rank by grouped counts, and the
lookup is a binary search in a task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm import pretokens as P
from keepsake.llm import ranks

#: rows of one (length, bucket) group that are ranked in one task, on average at most
BUCKET_ROWS = 8_000


def token_pieces(docs: DataFrame, path: str, limit: int, end_id: int, text: str = "text", id: str = "doc_id",
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``.

    A document's ids are its text's, then ``end_id``. Null texts are empty: one piece with the end id alone. Null ids
    and repeated rows are kept, each row is a document. Other columns are ignored.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    vocabulary = P.load_vocabulary(path)
    if not vocabulary.fast:
        raise ValueError(f"{path}: pieces need a byte-level BPE file")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = (f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
              + (", ids array<int>" if keep_ids else ""))

    def cut(batches):
        memory = P.memory_for(shared.value)
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, offsets = K.text_bytes(part.column("text"))
                ids, first = P.row_ids(data, offsets, memory)
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                size = np.diff(first)
                n = -(-size // limit)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = (size - (n - 1) * limit)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * limit)
                length = np.where(piece == 0, head, limit)
                at = first[row] + start
                crc = [zlib.crc32(ids[a:a + m]) for a, m in zip(at.tolist(), length.tolist())]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:    # pieces of a document stand one behind the other
                    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Segment:
    """``bins`` equal sequences from ``base`` on; each takes ``times`` pieces of ``length``, from rank ``rank`` on."""

    length: int
    rank: int
    times: int
    bins: int
    base: int
    offset: int


def plan_best_two_fit(counts: dict[int, int], limit: int) -> list[Segment]:
    """Plan all sequences from the number of pieces of each length."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(limit + 1, np.int64)
    segments, base = [], 0
    while left.any():
        content = _fill(left.copy(), limit)
        values, need = np.unique(content, return_counts=True)
        bins = int((left[values] // need).min())
        offset = 0
        for value, times in zip(values[::-1].tolist(), need[::-1].tolist()):
            segments.append(Segment(value, int(used[value]), times, bins, base, offset))
            used[value] += times * bins
            left[value] -= times * bins
            offset += value * times
        base += bins
    return segments


def _fill(left: np.ndarray, limit: int) -> list[int]:
    """Pieces of one sequence, given how many of each length are left."""
    content, gap = [], limit
    while True:
        fits = np.flatnonzero(left[:gap + 1])
        if not len(fits):
            break
        length = int(fits[-1])
        content.append(length)
        left[length] -= 1
        gap -= length
    smallest = content[-1]
    if gap and len(content) > 1:
        wide = gap + smallest
        there = left[:wide + 1] > 0
        below = np.maximum.accumulate(np.where(there, np.arange(wide + 1), 0))
        first = np.flatnonzero(there)
        second = np.minimum(below[wide - first], first)
        twice = (second == first) & (left[first] < 2)
        second = np.where(twice, below[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        if len(total) and total.max() > smallest:
            best = int(total.argmax())
            content[-1:] = [int(first[best]), int(second[best])]
    return content


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length`` (1 to ``limit``).

    Offsets of a sequence are gapless from 0. Pieces that are equal in every column are interchangeable. ``pieces``
    should be stored: it is read for the histogram, the ranks and the placement. An empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= length <= limit for length in counts):
        raise ValueError(f"piece lengths must lie in 1..{limit}")
    segments = plan_best_two_fit(counts, limit)
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    ranked = ranks.rank_within(
        pieces, "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)),
        F.col("doc_id"), F.col("piece"), *[F.col(c) for c in others])
    segments.sort(key=lambda s: (s.length, s.rank))
    table = np.array([[s.length, s.rank, s.times, s.base, s.offset] for s in segments], np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)     # bounded by ``limit``, see plan_best_two_fit
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def place(batches):
        rows = shared.value
        reach = 1 + int((rows[:, 1]).max(initial=0))
        keys = rows[:, 0] * reach + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, length * reach + np.minimum(rank, reach - 1), side="right") - 1
            _, first, times, base, offset = rows[at].T
            sequence, slot = np.divmod(rank - first, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(base + sequence), pa.array(offset + slot * length)],
                [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack a document table; one row for each piece with its place."""
    return pack(ranks.shared_write(token_pieces(docs, path, limit, end_id)), limit)
