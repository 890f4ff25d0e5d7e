"""Benchmark decontamination with one FM-index for each training shard.

A shard is a bounded run of whole documents inside a task. Its words become numbers (words no benchmark phrase uses
part the text; stretches too short for any phrase cannot hold one and stay out), its suffixes are sorted by prefix
doubling, and the Burrows-Wheeler transform is kept as a wavelet tree whose nodes answer rank queries. All phrases are
searched at once, last word first; occurrences are located by walking back to the nearest sampled suffix position, and
the covered words are merged into removal spans. Nothing is shuffled: documents stay where they were read.

Phrases reach the tasks in blocks of at most ``BLOCK_WORDS`` benchmark words (a longer item makes a block of its own);
a larger benchmark takes more passes over each batch of documents, not more memory. Word numbers stem from 64-bit
hashes; a foreign word passes for one of a block's words with a probability of about 1e-13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K

BLOCK_WORDS = 2_000_000
SHARD_BYTES = 8 << 20
SAMPLE_EVERY = 8
BREAK = 1       # number of "no phrase word here"; 0 ends the text
HITS = "array<struct<start:int,end:int,items:array<string>>>"


@dataclass(frozen=True)
class Phrases:
    """Windows of one block of benchmark items as word numbers."""

    words: np.ndarray       # sorted hashes; word i has number i + 2
    numbers: np.ndarray     # all windows, one behind the other
    first: np.ndarray       # n+1 window starts
    owner_first: np.ndarray     # n+1: items of each window
    owners: np.ndarray      # item ids as strings


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    data = K.LOWER[data]
    words = K.find_words(data, offsets, K.ALNUM)
    return K.span_hashes(data, words.start, words.end), words.first


def phrase_blocks(items: DataFrame, window: int, id: str = "item_id", text: str = "text",
                  block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """Windows of ``window`` words (shorter items: the whole item) in blocks of bounded size, read piece by piece."""
    ids, hashes, size = [], [], 0
    for row in items.select(F.col(id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        own, _ = _hashed([row[1]])
        if not len(own) or row[0] is None:
            continue
        if ids and size + len(own) > block_words:
            yield _phrases(ids, hashes, window)
            ids, hashes, size = [], [], 0
        ids.append(row[0])
        hashes.append(own)
        size += len(own)
    if ids:
        yield _phrases(ids, hashes, window)


def _phrases(ids: list[str], hashes: list[np.ndarray], window: int) -> Phrases:
    words = np.unique(np.concatenate(hashes))
    owners: dict[tuple, set[str]] = {}
    for item, own in zip(ids, hashes):
        numbers = (np.searchsorted(words, own) + BREAK + 1).tolist()
        width = min(window, len(numbers))
        for i in range(len(numbers) - width + 1):
            owners.setdefault(tuple(numbers[i:i + width]), set()).add(item)
    listed = [sorted(o) for o in owners.values()]
    return Phrases(words, np.array([n for p in owners for n in p], np.int64),
                   np.r_[0, np.cumsum([len(p) for p in owners])],
                   np.r_[0, np.cumsum([len(o) for o in listed])], np.array([i for o in listed for i in o], object))


class WaveletTree:
    """Ranks over a number sequence: one bit vector per level, zeros before ones from level to level."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(sequence.max(initial=1)).bit_length())
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(bit) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        left, right = np.zeros_like(at), at
        for level, ones, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            left = np.where(one, zeros + ones[left], left - ones[left])
            right = np.where(one, zeros + ones[right], right - ones[right])
        return right - left


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; the last symbol must be unique and smallest."""
    order = np.argsort(sequence, kind="stable")
    size, width = len(sequence), 1
    rank = np.empty(size, np.int64)
    key = sequence.astype(np.int64)
    while True:
        sorted_key = key[order]
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if rank[order[-1]] == size - 1:
            return order
        follow = np.zeros(size, np.int64)
        follow[:size - width] = rank[width:] + 1
        key = rank * (size + 1) + follow
        order = np.argsort(key, kind="stable")
        width *= 2


class FMIndex:
    """Backward search and location over a word-number sequence."""

    def __init__(self, sequence: np.ndarray, every: int = SAMPLE_EVERY):
        text = np.r_[sequence, 0].astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt)
        self.before = np.r_[0, np.cumsum(np.bincount(text))]
        self.sampled = order % every == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]
        self.size = len(text)

    def search(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [low, high) of each phrase."""
        n = len(first) - 1
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        active, at = np.arange(n), first[1:] - 1
        while len(active):
            symbol = numbers[at]
            known = symbol < len(self.before) - 1
            base = self.before[np.where(known, symbol, 0)]
            ranks = self.tree.rank(np.r_[symbol, symbol] * np.r_[known, known], np.r_[low[active], high[active]])
            low[active] = np.where(known, base + ranks[:len(active)], 0)
            high[active] = np.where(known, base + ranks[len(active):], 0)
            at = at - 1
            more = (at >= first[active]) & (high[active] > low[active])
            active, at = active[more], at[more]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, row = np.arange(len(rows)), rows
        while len(left):
            done = self.sampled[row]
            out[left[done]] = self.position[self.slot[row[done]]] + steps
            left, row = left[~done], row[~done]
            symbol = self.bwt[row]
            row = self.before[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return out


def _occurrences(numbers: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and window numbers of all occurrences in a shard; ``first``: row limits."""
    shortest = int(np.diff(phrases.first).min())
    inside = numbers > BREAK
    edge = np.zeros(len(numbers) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    long = end - begin >= shortest
    begin, size = begin[long], (end - begin)[long]
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none
    # kept stretches one behind the other, each closed by BREAK
    stop = np.cumsum(size + 1)
    source = np.repeat(begin - (stop - size - 1), size + 1) + np.arange(stop[-1])
    text = numbers[np.minimum(source, len(numbers) - 1)]
    text[stop - 1] = BREAK
    index = FMIndex(text)
    low, high = index.search(phrases.numbers, phrases.first)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return source[index.locate(rows)], window


def find_phrases(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", item_text: str = "text",
                 item_id: str = "item_id") -> DataFrame:
    """Every row of ``docs`` with ``n_words`` and ``hits``, the merged stretches of words inside benchmark windows.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A hit is ``start``,
    ``end`` (words, end excluded) and the items whose windows lie in it. A null text has no words; items without words
    or id are skipped; repeated rows are kept; an empty table gives an empty one; other columns pass through, but for
    an input column called ``n_words`` or ``hits``, which is replaced.
    """
    words_name, hits_name = "n_words", "hits"
    docs = docs.drop(words_name, hits_name)
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in phrase_blocks(items, window, item_id, item_text)]
    names = docs.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{words_name}` long", f"`{hits_name}` {HITS}"])
    at = names.index(text)

    def search(batches):
        for batch in batches:
            for shard in K.slices(batch.rename_columns([f"c{i}" for i in range(len(names))]), f"c{at}", SHARD_BYTES):
                hashes, counts = [], []
                for part in K.slices(shard, f"c{at}"):
                    data, offsets = K.text_bytes(part.column(at).cast(pa.string()))
                    data = K.LOWER[data]
                    words = K.find_words(data, offsets, K.ALNUM)
                    hashes.append(K.span_hashes(data, words.start, words.end))
                    counts.append(words.counts)
                hashes = np.concatenate(hashes)
                first = np.r_[0, np.cumsum(np.concatenate(counts))]
                hits = _merged(hashes, first, (b.value for b in blocks))
                hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                               ("items", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays(
                    [*shard.columns, pa.array(np.diff(first)), pa.array(hits, hit_type)],
                    [*names, words_name, hits_name])

    return docs.mapInArrow(search, schema)


def _merged(hashes: np.ndarray, first: np.ndarray, blocks: Iterator[Phrases]) -> list[list[dict]]:
    """Merged spans of each row with the items found in them, over all blocks."""
    spans: list[tuple[int, int, set[str]]] = []
    for phrases in blocks:
        number = np.searchsorted(phrases.words, hashes)
        known = phrases.words[np.minimum(number, len(phrases.words) - 1)] == hashes
        position, window = _occurrences(np.where(known, number + BREAK + 1, BREAK), first, phrases)
        width = np.diff(phrases.first)[window]
        for p, w, n in zip(position.tolist(), window.tolist(), width.tolist()):
            spans.append((p, p + n, phrases.owners[phrases.owner_first[w]:phrases.owner_first[w + 1]]))
    spans.sort(key=lambda s: s[:2])
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    rows = (np.searchsorted(first, [s[0] for s in spans], side="right") - 1).tolist()
    for (a, b, items), row in zip(spans, rows):
        base = int(first[row])
        last = out[row][-1] if out[row] else None
        if last and a - base <= last["end"]:
            last["end"] = max(last["end"], b - base)
            last["items"].update(items)
        else:
            out[row].append({"start": a - base, "end": b - base, "items": set(items)})
    for row in out:
        for hit in row:
            hit["items"] = sorted(hit["items"])
    return out


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Judge the rows of ``find_phrases``: contaminated if at least one word in ``share`` is hit."""
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]), F.lit(0))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size(items).cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(items, ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))
