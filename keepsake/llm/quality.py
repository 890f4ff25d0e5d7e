"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every text (repetition, word shapes, punctuation, letters, lines) are computed in one scan. On a bounded
sample of labelled rows, boosted shallow trees are grown; every path from a root to a node is a rule, a conjunction of
thresholds on statistics. A logistic model over all rules and the statistics themselves is fitted with a lasso penalty,
which leaves few of them. What is left is compiled into one Spark column expression, so scoring is part of the scan.

The sample is the ``SAMPLE_ROWS`` labelled training rows with the smallest hash of their id: a bounded, documented
parameter, the same for every corpus size. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm.ranks import smallest_hashes

SAMPLE_ROWS = 10_000
TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 48, 0.3
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)
MOST_RULES = 80
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "log_bytes", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words",
    "top_word", "same_as_before", "distinct_pairs", "upper_bytes", "digit_bytes", "space_bytes", "mark_bytes",
    "shout_bytes", "wide_bytes", "upper_words", "capital_words", "byte_entropy", "log_lines", "distinct_lines",
    "line_length", "stops_per_word", "symbol_bytes",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = ~K.NONSPACE
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_MARK = ~K.ALNUM & ~_UPPER & ~_SPACE
_BREAK = np.ones(256, bool)
_BREAK[[10, 13]] = False


def _per_row(flags: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(flags, dtype=np.float64)]
    return total[limits[1:]] - total[limits[:-1]]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    begin = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
    most = np.zeros(n)
    np.maximum.at(most, r[begin], np.diff(np.r_[begin, len(v)]))
    return np.bincount(r[begin], minlength=n).astype(float), most


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, statistics); an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    words = K.find_words(data, offsets, K.NONSPACE)
    count, rows = words.counts.astype(float), words.rows()
    length = (words.end - words.start).astype(float)
    hashes = K.span_hashes(data, words.start, words.end)
    by = lambda values: np.bincount(rows, values, minlength=n)
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    mean = by(length) / per_word
    spread = np.sqrt(np.maximum(by(length ** 2) / per_word - mean ** 2, 0))
    inner = np.r_[False, rows[1:] == rows[:-1]][:len(rows)]
    same = inner & np.r_[False, hashes[1:] == hashes[:-1]][:len(rows)]
    kinds, top = _distinct(hashes, rows, n)
    pairs = hashes.copy()
    pairs[1:] = K.mix(hashes[1:] * K.BASE + hashes[:-1])
    pair_kinds, _ = _distinct(pairs[inner], rows[inner], n)
    upper = _per_row(_UPPER[data], offsets)
    up = np.r_[0, np.cumsum(_UPPER[data])]
    shouted = (up[words.end] - up[words.start]) * 2 > length
    capital = _UPPER[data[words.start]] if len(data) else np.zeros(0, bool)
    lines = K.find_words(data, offsets, _BREAK)
    line_rows = lines.rows()
    line_kinds, _ = _distinct(K.span_hashes(data, lines.start, lines.end), line_rows, n)
    n_lines = lines.counts.astype(float)
    code = np.repeat(np.arange(n), np.diff(offsets)) * 256 + data
    share = np.bincount(code, minlength=n * 256).reshape(n, 256) / per_byte[:, None]
    entropy = -np.where(share > 0, share * np.log2(np.maximum(share, 1e-12)), 0).sum(1)
    share_of = lambda table: _per_row(table[data], offsets) / per_byte
    return np.column_stack([
        np.log1p(count), np.log1p(size), mean, spread, by(length > 12) / per_word, by(length < 3) / per_word,
        kinds / per_word, top / per_word, by(same) / per_word, pair_kinds / np.maximum(count - 1, 1),
        upper / per_byte, share_of(_DIGIT), share_of(_SPACE), share_of(_MARK), share_of(_SHOUT),
        _per_row(data >= 128, offsets) / per_byte, by(shouted) / per_word, by(capital) / per_word, entropy,
        np.log1p(n_lines), line_kinds / np.maximum(n_lines, 1), size / np.maximum(n_lines, 1),
        _per_row(_STOP[data], offsets) / per_word, share_of(_SYMBOL)])


def with_statistics(docs: DataFrame, text: str = "text", name: str = "_statistics") -> DataFrame:
    """``docs`` and a struct column of statistics (an input column of that name is replaced)."""
    docs = docs.drop(name)
    names = docs.columns
    at = names.index(text)
    inner = ", ".join(f"{s}: double" for s in STATISTICS)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` struct<{inner}>"])

    def run(batches):
        for batch in batches:
            plain = batch.rename_columns([f"c{i}" for i in range(len(names))])
            for part in K.slices(plain, f"c{at}"):
                values = text_statistics(*K.text_bytes(part.column(at)))
                column = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values.T],
                                                    list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*names, name])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """lower < statistic <= upper for each named statistic."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, low, high in self.bounds:
            out &= (x[:, s] > low) & (x[:, s] <= high)
        return out

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for s, low, high in self.bounds:
            value = F.col(stats)[STATISTICS[s]]
            if low > -np.inf:
                out = out & (value > float(low))
            if high < np.inf:
                out = out & (value <= float(high))
        return out


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and linear terms of a logistic model."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float, float, float], ...]     # statistic, weight, lower and upper limit

    def column(self, stats: str = "_statistics") -> Column:
        """The score (0 to 1) as one Spark expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), float(weight)).otherwise(0.0)
        for s, weight, low, high in self.linear:
            value = F.least(F.greatest(F.col(stats)[STATISTICS[s]], F.lit(float(low))), F.lit(float(high)))
            total = total + value * float(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, weight: np.ndarray):
    """One tree of Newton steps on binned statistics: (rules of all nodes, predictions)."""
    rules: list[Rule] = []
    value = np.zeros(len(residual))

    def node(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        if bounds:
            rules.append(Rule(tuple(sorted((s, *b) for s, b in bounds.items()))))
        g, h = residual[rows].sum(), weight[rows].sum()
        best = (1e-3, -1, -1)
        if depth < DEPTH and len(rows) >= 40:
            for s in range(binned.shape[1]):
                b = binned[rows, s]
                gs = np.cumsum(np.bincount(b, residual[rows], minlength=BINS + 1))[:-1]
                hs = np.cumsum(np.bincount(b, weight[rows], minlength=BINS + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
                gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1)
                gain[(ns < 20) | (len(rows) - ns < 20)] = -1
                at = int(gain.argmax())
                if at < len(edges[s]) and gain[at] > best[0]:
                    best = (float(gain[at]), s, at)
        if best[1] < 0:
            value[rows] = g / (h + 1)
            return
        _, s, at = best
        low, high = bounds.get(s, (-np.inf, np.inf))
        cut = float(edges[s][at])
        left = binned[rows, s] <= at
        node(rows[left], bounds | {s: (low, min(high, cut))}, depth + 1)
        node(rows[~left], bounds | {s: (max(low, cut), high)}, depth + 1)

    node(np.arange(len(residual)), {}, 0)
    return rules, value


def _lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None, steps: int = 300):
    """Weights and intercept (last) by accelerated proximal gradient steps."""
    design = np.column_stack([x, np.ones(len(x))])
    norm = np.ones(design.shape[1])
    for _ in range(20):     # largest eigenvalue by power iteration
        norm = design.T @ (design @ norm)
        norm /= np.linalg.norm(norm)
    rate = 4 * len(x) / max(np.linalg.norm(design @ norm) ** 2, 1e-9)
    w = np.zeros(design.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - rate * (design.T @ (p - y)) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        follow = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / follow * (new - w)
        w, t = new, follow
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w[:-1] + w[-1]
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Fit the ensemble on statistics ``x`` and labels ``y`` (0/1); without both labels the score is their share."""
    if len(y) < 50 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, s], side="left") for s, e in enumerate(edges)])
    raw, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        part = np.sort(rng.permutation(len(y))[:max(50, len(y) // 2)])
        grown, _ = _grow(binned[part], edges, (y - p)[part], (p * (1 - p))[part])
        whole = _grow_value(grown, x, y - p, p * (1 - p))
        raw = raw + SHRINKAGE * whole
        rules.update(dict.fromkeys(grown))
    rules = list(rules)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    linear = np.clip(x, low, high)
    scale = 0.4 / np.maximum(linear.std(0), 1e-9)       # as a rule of common support varies
    centre = linear.mean(0)
    columns = np.column_stack([r.holds(x) for r in rules] + [((linear - centre) * scale)]).astype(np.float64)
    check = rng.random(len(y)) < 0.25
    best, w = None, None
    for penalty in PENALTIES:
        w = _lasso_logistic(columns[~check], y[~check], penalty, w)
        loss = _loss(columns[check], y[check], w)
        if best is None or (loss < best[0] - 1e-4 and np.count_nonzero(w[:-1]) <= MOST_RULES):
            best = (loss, penalty)
    w = _lasso_logistic(columns, y, best[1], None, 600)
    weights = w[:-1]
    kept = [(r, float(v)) for r, v in zip(rules, weights) if v]
    tail = weights[len(rules):]
    terms = [(s, float(tail[s] * scale[s]), float(low[s]), float(high[s])) for s in range(x.shape[1]) if tail[s]]
    intercept = float(w[-1] - (tail * scale * centre).sum())
    return RuleModel(intercept, tuple(kept), tuple(terms))


def _grow_value(rules: list[Rule], x: np.ndarray, residual: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton step of each row's deepest rule (rules come parents first)."""
    out = np.zeros(len(x))
    for rule in rules:
        rows = rule.holds(x)
        if rows.any():
            out[rows] = residual[rows].sum() / (weight[rows].sum() + 1)
    return out


def held_out(id: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that no label may be learned from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the labelled rows outside the held-out fold.

    Rows without id, label or text row are not learned from; an id with several labels or texts counts once for each.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_label").isin(0, 1)).filter(~held_out("_id"))
    # the sample is chosen by id before any text is read; ties of the hash are ties of the id
    chosen = smallest_hashes(known.withColumn("_h", F.xxhash64("_id")), "_h", sample, F.col("_id"),
                             F.col("_label")).drop("_h")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), "_id")     # at most ``sample`` rows of two numbers
    table = (with_statistics(rows, "text").select(F.xxhash64("_id").alias("_hash"), "_label", "_statistics.*")
             .orderBy("_hash", *STATISTICS, "_label").limit(sample).toArrow())
    x = np.column_stack([table.column(s).to_numpy() for s in STATISTICS]) if table.num_rows else np.zeros((0, 1))
    return fit_rules(x, table.column("_label").to_numpy().astype(float))


def score(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every row (1: likely good). Null texts score as empty ones."""
    scored = with_statistics(docs.drop(name), text)
    return scored.withColumn(name, model.column()).drop("_statistics")


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, also repeated ones and those with null id or text."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = score(rows, train(docs, labels, id, text))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
