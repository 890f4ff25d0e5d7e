"""Quality rules by gradient-boosted trees over document statistics.

Statistics of every whole text are computed in one scan, vectorised over bounded slices. On a bounded sample of labelled
rows, boosted trees are grown on binned statistics by Newton steps. Chosen statistics are constrained: a score may only
fall with more repeated words, doubled lines, symbols or shouting. A split that breaks its constraint is not taken, and
the midpoint of a constrained split bounds the values of all leaves below it, so the whole ensemble is monotonic.

The trees are flattened into arrays (statistic, threshold, children, value); a slice is scored by moving a matrix of
rows x trees down one level at a time. The model is a few thousand numbers, whatever the corpus.

The sample is the ``SAMPLE_ROWS`` labelled rows outside the held-out fold with the smallest hash of their id: a bounded,
documented parameter, the same for every corpus size. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm.quality import held_out
from keepsake.llm.ranks import smallest_hashes

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINKAGE, LEAST_ROWS, RIDGE = 80, 4, 48, 0.15, 20, 1.0
#: labelled rows below which (or with one label only) no trees are grown and the base rules alone decide
LEAST_LABELLED = 50
THRESHOLD = 0.3
LEAST_WORDS = 50
REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "shout_share", "distinct_words",
    "distinct_pairs", "same_as_before", "short_words", "long_words", "upper_share", "digit_share", "mark_share",
    "wide_share", "capital_words", "line_words", "stops_per_word", "space_share", "word_entropy",
)
#: -1: the score never rises with the statistic
CONSTRAINTS = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1}


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL = _flags("#*$%&|<>")
_SHOUT = _flags("!?")
_STOP = _flags(".,;:")
_DIGIT = _flags("0123456789")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LINE = K.member_table([10])
_MARK = ~K.ALNUM & ~_UPPER & K.NONSPACE
_LEAD = (np.arange(256) & 0xC0) != 0x80     # first byte of a code point


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _groups(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (row, value) items: the row and size of each group, and the group of each item."""
    key = values + K.mix(rows.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    _, first, group, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return rows[first], size, group


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ``COUNTS``) exact counts and (rows, ``STATISTICS``) of a slice of texts; an empty text has zeros.

    Words, word runs and lines are compared by 64-bit hashes.
    """
    n = len(offsets) - 1
    words = K.find_words(data, offsets, K.NONSPACE)
    count, rows = words.counts, words.rows()
    hashes = K.span_hashes(data, words.start, words.end)
    length = words.end - words.start
    lines = K.find_words(data, offsets, _LINE)
    solid = np.r_[0, np.cumsum(K.NONSPACE[data])]
    worded = solid[lines.end] > solid[lines.start]
    line_rows = lines.rows()[worded]
    line_row, _, _ = _groups(K.span_hashes(data, lines.start[worded], lines.end[worded]), line_rows)
    n_lines = np.bincount(line_rows, minlength=n)
    dup_lines = n_lines - np.bincount(line_row, minlength=n)
    repeated = np.zeros(n, np.int64)
    at = np.flatnonzero(K.gram_mask(words.first, 3))
    if len(at):
        _, size, group = _groups(K.gram_hashes(hashes, 3)[at], rows[at])
        covered = K.run_mask(len(hashes), at[size[group] > 1], 3)
        repeated = np.bincount(rows[covered], minlength=n)
    symbols = _per_row(_SYMBOL[data], offsets)
    chars = _per_row((_LEAD & K.NONSPACE)[data], offsets)
    counts = np.column_stack([count, chars, symbols, dup_lines, repeated]).astype(np.int64)

    per_word, per_byte = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    kind_row, kind_size, _ = _groups(hashes, rows)
    share = kind_size / per_word[kind_row] if len(kind_row) else np.zeros(0)
    inner = np.r_[False, rows[1:] == rows[:-1]][:len(rows)]
    same = inner & np.r_[False, hashes[1:] == hashes[:-1]][:len(rows)]
    pairs = np.flatnonzero(inner)
    pair_row, _, _ = _groups(K.mix(hashes[pairs] * K.BASE + hashes[pairs - 1]), rows[pairs])
    by = lambda flags: np.bincount(rows, flags, minlength=n) / per_word      # noqa: E731
    of = lambda table: _per_row(table[data], offsets) / per_byte             # noqa: E731
    capital = _UPPER[data[words.start]] if len(data) else np.zeros(0, bool)
    statistics = np.column_stack([
        np.log1p(count), chars / per_word, symbols / per_word, dup_lines / np.maximum(n_lines, 1), repeated / per_word,
        _per_row(_SHOUT[data], offsets) / per_word, np.bincount(kind_row, minlength=n) / per_word,
        np.bincount(pair_row, minlength=n) / np.maximum(count - 1, 1), by(same), by(length < 3), by(length > 12),
        of(_UPPER), of(_DIGIT), of(_MARK), of(~_LEAD), by(capital), np.log1p(count / np.maximum(n_lines, 1)),
        _per_row(_STOP[data], offsets) / per_word, of(~K.NONSPACE),
        -np.bincount(kind_row, share * np.log2(np.maximum(share, 1e-12)), minlength=n) / np.maximum(np.log2(per_word), 1),
    ])
    return counts, statistics


@dataclass(frozen=True)
class Forest:
    """Flattened trees: a leaf is its own child. ``roots`` holds the first node of each tree."""

    start: float
    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score (0 to 1) of each row of statistics."""
        raw = np.full(len(x), self.start)
        for begin in range(0, len(x), 4096):
            part = x[begin:begin + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                goes_left = part[row, self.statistic[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            raw[begin:begin + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-raw))


class _Grower:
    """One boosted tree after the other on binned statistics."""

    def __init__(self, x: np.ndarray, signs: np.ndarray):
        self.signs = signs
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        self.cells = self.binned + np.arange(x.shape[1]) * (BINS + 1)
        self.usable = np.arange(BINS)[None, :] < np.array([len(e) for e in self.edges])[:, None]
        self.nodes: list[list] = []      # statistic, threshold, left, right, value

    def _sums(self, rows: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """(statistics, bins) sums over the rows at or below each bin's upper edge."""
        width = self.cells.shape[1]
        given = None if weight is None else np.repeat(weight[rows], width)
        total = np.bincount(self.cells[rows].ravel(), given, minlength=width * (BINS + 1))
        return np.cumsum(total.reshape(width, BINS + 1), 1)[:, :-1]

    def grow(self, g: np.ndarray, h: np.ndarray, rows: np.ndarray, low: float = -np.inf, high: float = np.inf,
             depth: int = 0) -> int:
        """Grow the subtree of ``rows`` with leaf values between ``low`` and ``high``; the index of its top node."""
        own = len(self.nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(total_g / (total_h + RIDGE), low, high))
        self.nodes.append([0, np.inf, own, own, value * SHRINKAGE])
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return own
        gl, hl, nl = self._sums(rows, g), self._sums(rows, h), self._sums(rows, None)
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(gl / (hl + RIDGE), low, high), np.clip(gr / (hr + RIDGE), low, high)
        gain = (gl * left - (hl + RIDGE) * left ** 2 / 2 + gr * right - (hr + RIDGE) * right ** 2 / 2
                - (total_g * value - (total_h + RIDGE) * value ** 2 / 2))
        bad = ((nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | ~self.usable
               | (self.signs[:, None] * (right - left) < 0))
        gain[bad] = -np.inf
        s, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[s, b] > 1e-6:
            return own
        middle = float(left[s, b] + right[s, b]) / 2
        to_left = self.binned[rows, s] <= b
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                  -1: ((middle, high), (low, middle))}[int(self.signs[s])]
        a = self.grow(g, h, rows[to_left], *bounds[0], depth + 1)
        c = self.grow(g, h, rows[~to_left], *bounds[1], depth + 1)
        self.nodes[own][:4] = [int(s), float(self.edges[s][b]), a, c]
        return own


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest | None:
    """Boosted trees on statistics ``x`` and labels ``y`` (0/1); None with fewer than ``LEAST_LABELLED`` rows or one
    label only."""
    if len(y) < LEAST_LABELLED or y.min() == y.max():
        return None
    grower = _Grower(x, np.array([CONSTRAINTS.get(s, 0) for s in STATISTICS]))
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw, roots = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grower.grow(y - p, p * (1 - p), np.arange(len(y))))
        s, t, left, right, value = (np.array(c) for c in zip(*grower.nodes))
        node = np.full(len(y), roots[-1])
        for _ in range(DEPTH):
            node = np.where(x[np.arange(len(y)), s[node]] <= t[node], left[node], right[node])
        raw += value[node]
    return Forest(start, np.array(roots), s, t, left, right, value)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE_ROWS) -> Forest | None:
    """Fit on at most ``sample`` labelled rows outside the held-out fold.

    Rows without id, label or text row are not learned from; an id with several labels or texts counts once for each.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_label").isin(0, 1)).filter(~held_out("_id"))
    chosen = smallest_hashes(known.withColumn("_h", F.xxhash64("_id")), "_h", sample, F.col("_id"),
                             F.col("_label")).drop("_h")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).join(
        F.broadcast(chosen), "_id")     # at most ``sample`` rows of two numbers
    inner = ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "_text"):
                _, x = measure(*K.text_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_label"), *(pa.array(np.ascontiguousarray(c)) for c in x.T)],
                    ["_id", "_label", *STATISTICS])

    measured = rows.select("_id", "_label", "_text").mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _label int, {inner}")
    table = (measured.withColumn("_h", F.xxhash64("_id")).orderBy("_h", *STATISTICS, "_label").limit(sample)
             .drop("_id", "_h").toArrow())
    x = np.column_stack([table.column(s).to_numpy() for s in STATISTICS])
    return fit(x, table.column("_label").to_numpy().astype(float))


def judge(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD, id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated runs of three. ``kept``: not failed and
    scored ``threshold`` or more; without a forest ``score`` is null and the base rules decide. Null texts have no
    words and fail; repeated rows and null ids come back each; other columns are ignored; an empty table gives an empty
    one. A slice holds 1 MB of texts, or one longer text: memory follows the longest text, about a hundred bytes for
    each byte of it.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "_text"):
                counts, x = measure(*K.text_bytes(part.column("_text")))
                score = pa.nulls(len(x), pa.float64()) if forest is None else pa.array(forest.score(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), score],
                    ["doc_id", *COUNTS, "score"])

    counted = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, "
                                   + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))
    return counted.withColumn("base_failed", failed).withColumn("kept", kept).select(
        "doc_id", *COUNTS, "base_failed", "kept", "score")


def judge_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``judge`` with a forest trained on ``labels``."""
    return judge(docs, train(docs, labels, id, text), id=id, text=text)
