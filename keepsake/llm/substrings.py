"""Substring deduplication by level-wise doubling.

Windows that repeat at one length alone are looked at again at (at most) twice that length, up to the asked window,
where the levels stop: how long a repeat gets beyond it is not reported. The first level needs no row for every word: of
all short runs inside one window only the one with the smallest hash stands for it (equal windows choose alike, so none
is missed), which is about a quarter of all positions for 7 words in 13. Runs that no second document has are gone
before the texts are read again; only windows around surviving runs are hashed at full length.

A window is removed where a document with a smaller id holds it too. So a group of copies needs its smallest id only:
``min`` with partial sums before the shuffle, joined back by (hash), which Spark splits where one hash is hot. What goes
back to a document is the set of its own flagged hashes, bounded by its length. Texts are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm import ranks

#: id that stands for a missing one; smaller than all others
NO_ID = -(1 << 63)


def level_lengths(window: int, base: int) -> list[int]:
    """Run lengths from the first level to ``window``, each at most twice the one before."""
    lengths = [window]
    while lengths[0] > base:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _prepared(docs: DataFrame, id: str, text: str, others: list[str]) -> DataFrame:
    carried = [F.struct(*others).alias("_others")] if others else []
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.col(text).cast("string").alias("_text"), *carried)


def _slice_words(part: pa.RecordBatch):
    data, offsets = K.text_bytes(part.column("_text"))
    words = K.find_words(data, offsets, K.NONSPACE)
    return data, words, K.span_hashes(data, words.start, words.end)


def _window_choice(hashes: np.ndarray, first: np.ndarray, length: int, window: int):
    """For each window inside a row: its start, and the start of the run of ``length`` words that stands for it."""
    starts = np.flatnonzero(K.gram_mask(first, window))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    runs = K.gram_hashes(hashes, length)
    inside = window - length + 1
    size = len(runs) - inside + 1
    best, at = runs[:size].copy(), np.zeros(size, np.int64)
    for i in range(1, inside):
        less = runs[i:i + size] < best
        np.copyto(best, runs[i:i + size], where=less)
        at[less] = i
    return starts, starts + at[starts], runs


def _emit(hashes: np.ndarray, ids: np.ndarray):
    """Distinct (hash, document) rows."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][:len(h)]
    return pa.RecordBatch.from_arrays([pa.array(K.signed(h[keep])), pa.array(d[keep])], ["h", "_id"])


def _first_level(rows: DataFrame, length: int, window: int) -> DataFrame:
    """(h, _id): the runs of ``length`` words that stand for the windows of each document."""

    def runs(batches):
        for batch in batches:
            for part in K.slices(batch, "_text"):
                _, words, hashes = _slice_words(part)
                _, chosen, grams = _window_choice(hashes, words.first, length, window)
                chosen = np.unique(chosen)
                ids = part.column("_id").to_numpy()[words.rows()[chosen]] if len(chosen) else np.zeros(0, np.int64)
                yield _emit(grams[chosen], ids)

    return rows.mapInArrow(runs, "h long, _id long")


def _repeated(rows: DataFrame) -> DataFrame:
    """(h, _id, _least): rows whose hash more than one document has."""
    shared = (rows.groupBy("h").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
              .filter("_least < _most").drop("_most"))
    return rows.join(shared, "h")


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    """One row for each document with its distinct hashes (no more than it has words)."""
    return rows.groupBy("_id").agg(F.collect_list("h").alias(name))


def _next_level(texts: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    """(h, _id): runs of ``longer`` words around the surviving runs (column ``_kept``) of ``length`` words."""

    def runs(batches):
        for batch in batches:
            for part in K.slices(batch, "_text"):
                _, words, hashes = _slice_words(part)
                kept = part.column("_kept")
                survivors = np.sort(kept.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                starts, chosen, grams = _window_choice(hashes, words.first, length, window)
                if not len(starts) or not len(survivors):
                    continue
                at = np.searchsorted(survivors, K.signed(grams[chosen]))
                starts = starts[survivors[np.minimum(at, len(survivors) - 1)] == K.signed(grams[chosen])]
                if longer < window:
                    own, chosen, grams = _window_choice(hashes, words.first, longer, window)
                    starts = np.unique(chosen[np.searchsorted(own, starts)])
                else:
                    grams = K.gram_hashes(hashes, longer)
                yield _emit(grams[starts], part.column("_id").to_numpy()[words.rows()[starts]])

    return texts.mapInArrow(runs, "h long, _id long")


def _repeated_windows(rows: DataFrame, window: int, base: int) -> DataFrame:
    """(_id, _flagged): hashes of each document's windows that a document with a smaller id holds too."""
    lengths = level_lengths(window, base)
    found = _first_level(rows, lengths[0], window)
    for length, longer in zip(lengths, lengths[1:]):
        kept = ranks.shared_write(_by_document(_repeated(found).select("h", "_id"), "_kept"))
        # all columns stay, so that the texts' exchange is the one that the removal reads again
        found = _next_level(rows.join(kept, "_id"), length, longer, window)
    return _by_document(_repeated(found).filter("_id > _least").select("h", "_id"), "_flagged")


def remove_repeats(docs: DataFrame, window: int = 13, base: int = 7, id: str = "doc_id", text: str = "text",
                   others: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """Take every word out that lies in a window of ``window`` words which also starts in a smaller document.

    Words are runs without white space, compared as they are; windows are judged on the input. Returns one row for
    each input row: ``doc_id, n_words, n_removed, kept_text`` and, if asked for, the columns ``others`` in one struct
    column ``others``. ``kept_text`` joins the kept words by one space; with ``joined=False`` only where words are gone, and an untouched text stays as it is. A null
    text has no words; a null id counts as smaller than every id; rows with the same id are one document for the
    comparison, so copies under one id stay; texts shorter than the window stay whole; an empty table gives an empty
    one. Windows are compared by hashes of 64 bits.
    """
    rows = _prepared(docs, id, text, list(others))
    marked = rows.join(_repeated_windows(rows, window, base), "_id", "left")
    carried = dict(rows.dtypes).get("_others")

    def cut(batches):
        for batch in batches:
            for part in K.slices(batch, "_text"):
                data, words, hashes = _slice_words(part)
                gone = np.zeros(len(hashes), bool)
                grams = K.signed(K.gram_hashes(hashes, window))
                flagged = part.column("_flagged")
                for row in np.flatnonzero(flagged.is_valid().to_numpy(zero_copy_only=False)):
                    a, b = words.first[row], words.first[row + 1]
                    if b - a >= window:
                        own = np.isin(grams[a:b - window + 1], np.array(flagged[int(row)].values))
                        gone[a:b] = K.run_mask(b - a, np.flatnonzero(own), window)
                total = np.r_[0, np.cumsum(gone)]
                removed = total[words.first[1:]] - total[words.first[:-1]]
                texts = pa.array(_joined(data, words, ~gone), pa.string())
                if not joined:
                    texts = pc.if_else(pa.array(removed > 0), texts, part.column("_text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(words.counts), pa.array(removed), texts,
                     *([part.column("_others")] if carried else [])],
                    ["_id", "n_words", "n_removed", "kept_text", *(["_others"] if carried else [])])

    out = marked.mapInArrow(cut, "_id long, n_words long, n_removed long, kept_text string"
                            + (f", _others {carried}" if carried else ""))
    kind = dict(docs.dtypes)[id]
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).cast(kind).alias("doc_id"),
                      "n_words", "n_removed", "kept_text", *([F.col("_others").alias("others")] if carried else []))


def _joined(data: np.ndarray, words: K.Words, keep: np.ndarray) -> list[str]:
    """The kept words of each row, joined by one space."""
    raw = data.tobytes()
    start, end = words.start.tolist(), words.end.tolist()
    out, at = [], 0
    rows = np.flatnonzero(keep)
    limits = np.searchsorted(rows, words.first).tolist()
    rows = rows.tolist()
    for a, b in zip(limits, limits[1:]):
        out.append(b" ".join([raw[start[i]:end[i]] for i in rows[a:b]]).decode())
    return out
