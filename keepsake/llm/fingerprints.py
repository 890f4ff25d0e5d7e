"""I-Match fingerprints over randomised lexicon subsets.

The lexicon is the set of terms whose inverse document frequency over the whole corpus lies in a band: neither in every
tenth document nor rarer than one in ``RARE``. Each of ``SUBSETS`` random subsets holds a fixed share of the lexicon, one
term in ``SHARE``, the same for every document, and hashes all of a document's lexicon terms that it holds (their sum, as
of a sorted list). A changed term only changes the subsets that hold it. A subset that holds no term of a document
takes the one of its terms with the subset's smallest hash instead; no other document's full set can equal that.
Likeness is the share of equal subset hashes.

The lexicon's size does not grow with the corpus: a document has a bounded number of distinct terms on average (``d``),
so at most ``d * RARE`` terms can occur in one of ``RARE`` documents. ``lexicon`` checks ``LEXICON_LIMIT``; a corpus of
very long documents beyond it needs a smaller ``rare``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K

#: the idf band: ln(COMMON) .. ln(RARE)
COMMON, RARE = 10.0, 2000.0
SUBSETS = 32
#: a subset holds one lexicon term in so many
SHARE = 128
LEXICON_LIMIT = 16_000_000
NO_ID = -(1 << 63)


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Sorted distinct term hashes of each row, and n+1 limits."""
    data = K.LOWER[data]
    words = K.find_words(data, offsets, K.ALNUM)
    hashes, rows = K.span_hashes(data, words.start, words.end), words.rows()
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])][:len(hashes)]
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def document_frequencies(docs: DataFrame, text: str = "text", most: int = 1 << 20) -> DataFrame:
    """(h, df): in how many rows each term occurs. Tasks add up their terms before the shuffle."""
    rows = docs.select(F.col(text).cast("string").alias("text"))

    def count(batches):
        held, parts, size = None, [], 0

        def summed():
            both = ([held] if held is not None else []) + parts
            h, n = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[at], np.add.reduceat(n, at)

        def batch_of(pair):
            return pa.RecordBatch.from_arrays([pa.array(K.signed(pair[0])), pa.array(pair[1])], ["h", "n"])

        for batch in batches:
            for part in K.slices(batch, "text"):
                terms, n = np.unique(_terms(*K.text_bytes(part.column("text")))[0], return_counts=True)
                if not len(terms):
                    continue
                parts.append((terms, n))
                size += len(terms)
                if size > most:
                    held, parts, size = summed(), [], 0
                    if len(held[0]) > most:
                        yield batch_of(held)
                        held = None
        if parts or held is not None:
            yield batch_of(summed() if parts else held)

    return rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", common: float = COMMON, rare: float = RARE) -> np.ndarray:
    """Sorted hashes of the terms in the band; see the module text for its bound."""
    n = docs.count()
    chosen = document_frequencies(docs, text).filter((F.col("df") * common <= n) & (F.col("df") * rare >= n))
    rows = chosen.select("h").limit(LEXICON_LIMIT + 1).toArrow().column("h").to_numpy()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError("the lexicon is too large to ship; choose a smaller value for rare")
    return np.sort(rows.view(np.uint64))


def subset_hashes(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, subsets: int = SUBSETS) -> np.ndarray:
    """(rows, subsets) 16-bit hashes of the terms that each subset holds, or of its nearest term if it holds none.

    Rows without a lexicon term use all their terms; rows without terms hash their bytes.
    """
    terms, limits = _terms(data, offsets)
    n = len(limits) - 1
    known = np.zeros(len(terms), bool)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)] == terms
    rows = np.repeat(np.arange(n), np.diff(limits))
    counts = np.bincount(rows[known], minlength=n)
    use = known | (counts == 0)[rows]
    terms, rows = terms[use], rows[use]
    counts = np.bincount(rows, minlength=n)
    whole = K.span_hashes(data, offsets[:-1], offsets[1:])
    out = np.empty((n, subsets), np.uint16)
    full = np.flatnonzero(counts)
    begin = np.searchsorted(rows, full)
    spread = np.repeat(np.arange(len(full)), counts[full])
    for j in range(subsets):
        seed = K.mix(np.array([j + 1], np.uint64))[0]
        out[:, j] = K.mix(whole ^ seed) >> np.uint64(48)
        if not len(full):
            continue
        value = K.mix(terms ^ seed)
        # the subset is the same for all rows; where it holds none of the terms, the nearest one stands in
        least = np.minimum.reduceat(value, begin)
        held = np.flatnonzero(value <= np.maximum(least, np.uint64(2**64 // SHARE - 1))[spread])
        total = np.zeros(len(full), np.uint64)
        np.add.at(total, spread[held], K.mix(value[held] + np.uint64(1)))
        out[full, j] = K.mix(total) >> np.uint64(48)
    return out


def hex_text(hashes: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in hashes.astype(">u2")]


def fingerprint(docs: DataFrame, terms: np.ndarray, id: str = "doc_id", text: str = "text",
                subsets: int = SUBSETS) -> DataFrame:
    """``doc_id, fingerprint`` (four hex digits for each subset) of every row.

    Equal texts have equal fingerprints. Null texts are empty; null ids and repeated rows come back each; other columns
    are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                marks = subset_hashes(*K.text_bytes(part.column("text")), shared.value, subsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hex_text(marks), pa.string())],
                                                 ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def _cell(bounds: list[int], key: str, inclusive: bool = True):
    """Column: how many of the sorted ``bounds`` are at most (or below) ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    values, steps = F.lit(bounds).cast("array<long>"), [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at, width):
        bound = F.get(values, at + width - 1)
        below = bound <= F.col(key) if inclusive else bound < F.col(key)
        return F.when(F.coalesce(below, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def _closing_keys(cells: list, bounds: list[int]) -> list[tuple[int, int]]:
    """(cell, key): the id that follows the largest id of every cell, after the last the first one.

    ``cells`` are ``(cell, least, most, beyond)`` in order; an id that fills several cells is dealt into all of them.
    """
    closing = []
    for i, (cell, least, _, beyond) in enumerate(cells):
        after = cells[(i + 1) % len(cells)][1]
        closing.append((cell, after))
        lots = bounds.count(least) if cell and bounds[cell - 1] == least else 1
        closing += [(cell - k, after if beyond is None else beyond) for k in range(1, lots)]
    return closing


def beside_next(docs: DataFrame, id: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """``_cell, _edge, _key, text``: all rows in descending order of id inside cells, so that the next document is met first.

    Ids are cut into ``cells`` ranges at quantiles (four for each shuffle partition, 4,096 at most), so the rows are
    shuffled once. Every cell begins with a copy of the row that follows its largest id (``_edge``). An id with more
    rows than a cell holds is dealt into several. Rows of one id are ordered by text, descending; null ids come below
    all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("_key"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cells = cells or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / cells for i in range(1, cells)]
    bounds = list(rows.agg(F.percentile_approx("_key", shares, 10 * cells)).first()[0] or []) if shares else []
    cell, first = _cell(bounds, "_key"), _cell(bounds, "_key", inclusive=False)
    bound = F.get(F.lit(bounds).cast("array<long>"), F.col("_cell") - 1) if bounds else F.lit(None).cast("long")
    held = rows.select("_key", cell.alias("_cell")).groupBy("_cell").agg(
        F.min("_key").alias("least"), F.max("_key").alias("most"),
        F.min(F.when(F.col("_key") > bound, F.col("_key"))).alias("beyond")).orderBy("_cell").collect()
    closing = _closing_keys([tuple(r) for r in held], bounds)
    ends = spark.createDataFrame(closing, "_cell int, _key long")
    edges = (rows.filter(F.col("_key").isin(sorted({k for _, k in closing}))).groupBy("_key")
             .agg(F.min("text").alias("text")).join(F.broadcast(ends), "_key")
             .select("_cell", F.lit(True).alias("_edge"), "_key", "text"))
    lot = F.pmod(F.xxhash64("text"), F.greatest(F.col("_to") - F.col("_from"), F.lit(1))).cast("int")
    placed = rows.withColumns({"_to": cell, "_from": first}).select(
        (F.col("_to") - lot).alias("_cell"), F.lit(False).alias("_edge"), "_key", "text")
    order = [F.col("_cell"), *[F.col(c).desc() for c in ("_edge", "_key", "text")]]
    return placed.unionByName(edges).repartition("_cell").sortWithinPartitions(*order)


def edit_robustness(docs: DataFrame, share: int = 4, id: str = "doc_id", text: str = "text", subsets: int = SUBSETS,
                    common: float = COMMON, rare: float = RARE, cells: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited forms (the last 1/``share`` replaced by the next document's start).

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next document is the
    one with the next larger id (after the last: the first; null ids, all one id, come before all; ids are read as
    long). If several rows have that id, the one with the smallest text is taken. Null texts are empty; repeated rows
    come back each; a text of any length is read whole, one at a time; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, common, rare))

    def run(batches):
        # the row before, and the text and fingerprint of the id that follows its id
        place, before, after = None, None, None
        for batch in batches:
            for part in K.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                own = subset_hashes(*K.text_bytes(part.column("text")), shared.value, subsets)
                edited, beside = [], np.empty_like(own)
                places = list(zip(*[part.column(c).to_pylist() for c in ("_cell", "_edge", "_key")]))
                for i, here in enumerate(places):
                    if here != place:
                        after = before if place and here[0] == place[0] else None
                        place = here
                    before = texts[i], own[i].copy()
                    cut = len(texts[i]) // share
                    follows, beside[i] = after if after else before
                    edited.append(texts[i][:len(texts[i]) - cut] + follows[:cut])
                new = subset_hashes(*K.text_bytes(pa.array(edited, pa.string())), shared.value, subsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                     pa.array(hex_text(own), pa.string()), pa.array(hex_text(new), pa.string()),
                     pa.array((own == new).mean(1)), pa.array((own == beside).mean(1))],
                    ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                     "near_next"]).filter(pa.array([not edge for _, edge, _ in places]))

    marked = beside_next(docs, id, text, cells).mapInArrow(
        run, "_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    kind = dict(docs.dtypes)[id]
    return marked.select(F.when(F.col("_key") != NO_ID, F.col("_key")).cast(kind).alias("doc_id"), "n_chars",
                         "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
