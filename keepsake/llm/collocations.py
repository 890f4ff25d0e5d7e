"""Phrase collocations by dynamic itemset counting.

The texts are dealt into ``SHARDS`` shards that are scanned in a cycle, one a step. All lengths are counted side by side:
a phrase starts to be counted in the step after both its subphrases (all words but the last, all but the first) have
reached the threshold, and stops after one full cycle, so that every shard has been counted once. Words start in step 0.
Counting ends when no phrase can be open any more, after as many steps as the last phrase needs, at most ``SHARDS`` for
each length.

No list of possible phrases is made. A table of fixed size (``SLOTS`` bytes a length) holds, under the hash of each
frequent phrase, the step in which it became frequent. A scan looks the two subphrases of each run of words up there,
knows from them in which step the run has started, and counts it if its cycle is still open, vectorised over a bounded
slice. The first phrase of a slot decides for all that share it: some runs then start early or for nothing, but every
run has one start in all steps, is counted for one whole cycle, and is judged by its exact count alone. No join is
needed. A run never starts before the two runs inside it have. Open counts are kept in Parquet between the steps; a
phrase that has completed its cycle below the threshold leaves them.

Phrases are told apart by 64-bit hashes of their words and language.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm.ranks import shared_write
from keepsake.session import scratch_folder

SHARDS = 3
LONGEST = 5
LEAST = 100
FIRST = 2000
#: slots of a length; more frequent phrases than that only have more runs counted
SLOTS = 1 << 22
_NEVER = 255
SLICE_BYTES = 4 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x0A, 0x0E), *(ord(c) for c in ".,;:!?")]] = True
#: words ``[^\x20\x09]+`` of the pieces between ``[.,;:!?\x0A-\x0D]``
_WORD = ~_BREAK & K.member_table([0x20, 0x09])
_COUNTS = "k int, lang string, word string, p long, q long, n long, start int"


def _join(p: np.ndarray, q: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Hash of a phrase of ``k`` words from the hashes of its two subphrases."""
    return K.mix(p * K.BASE + q + np.asarray(k).astype(np.uint64))


def _slot(since: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
    """The steps in which phrases of ``k`` words with the hashes ``h`` became frequent."""
    return since[k - 1][h & np.uint64(since.shape[1] - 1)]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    size = end - start
    limits = np.r_[0, np.cumsum(size)]
    at = np.repeat(start - limits[:-1], size) + np.arange(limits[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(limits.astype(np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data[at])))


def _counted(part: pa.RecordBatch, step: int, shards: int, lengths: set[int], since: np.ndarray):
    """Batches of ``_COUNTS`` of the open runs of words of one slice; ``since`` has a row of slots for each length."""
    data, offsets = K.text_bytes(part.column("text"))
    data = K.LOWER[data]
    words = K.find_words(data, offsets, _WORD)
    if not len(words.start):
        return
    rows = words.rows()
    coded = part.column("lang").dictionary_encode()
    names, spans = K.text_bytes(coded.dictionary)
    seed = K.span_hashes(np.append(names, np.uint8(0)), spans[:-1], spans[1:], seed=9)      # a name may be empty
    language = seed[coded.indices.to_numpy(zero_copy_only=False)][rows]
    h = K.mix(K.span_hashes(data, words.start, words.end) + language)

    def batch(k, lang, word, p, q, n, start):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), k, np.int32)), lang, word, pa.array(K.signed(p)), pa.array(K.signed(q)),
             pa.array(n.astype(np.int64)), pa.array(start.astype(np.int32))],
            ["k", "lang", "word", "p", "q", "n", "start"])

    if 1 in lengths:
        kinds, at, n = np.unique(h, return_index=True, return_counts=True)
        lang = part.column("lang").cast(pa.string()).take(pa.array(rows[at]))
        yield batch(1, lang, _strings(data, words.start[at], words.end[at]).cast(pa.string()), kinds,
                    np.zeros(len(kinds), np.uint64), n, np.zeros(len(kinds)))
    # equal for words of one piece of one text
    piece = np.cumsum(_BREAK[data])[words.start] + rows
    at = np.arange(len(h))      # where a phrase of k-1 words starts that may be frequent
    begun = np.zeros(len(h), np.uint8)      # and the step in which its own count began: no phrase is frequent before
    for k in range(2, max(lengths) + 1):
        known = np.full(len(h) + 1, _NEVER, np.uint8)
        known[at] = np.maximum(_slot(since, k - 1, h[at]), begun)
        at = at[at + k <= len(h)]
        at = at[(known[at] < _NEVER) & (known[at + 1] < _NEVER)]
        at = at[piece[at] == piece[at + k - 1]]
        start = np.maximum(known[at], known[at + 1]).astype(np.int32) + 1
        at, start = at[start <= step], start[start <= step]
        p, q = h[at], h[at + 1]
        longer = _join(p, q, k)
        if k in lengths:
            open_ = np.flatnonzero(start + shards > step)
            _, first, n = np.unique(longer[open_], return_index=True, return_counts=True)
            first = open_[first]
            none = pa.nulls(len(n), pa.string())
            yield batch(k, none, none, p[first], q[first], n, start[first])
        h = np.zeros(len(h), np.uint64)
        h[at] = longer
        begun = start.astype(np.uint8)


def _scan(shard: DataFrame, step: int, shards: int, lengths: set[int], known: Broadcast, shape: tuple) -> DataFrame:
    def run(batches):
        slots, steps = known.value
        since = np.full(shape, _NEVER, np.uint8)
        since.ravel()[slots] = steps
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                yield from _counted(part, step, shards, lengths, since)

    return shard.select("lang", "text").mapInArrow(run, _COUNTS)


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``, the hash of each phrase."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            k, p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "p", "q"))
            p, q = p.astype(np.int64).view(np.uint64), q.astype(np.int64).view(np.uint64)
            g = np.where(k == 1, p, _join(p, q, k)) if len(k) else p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(K.signed(g))], [*names, "g"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", g long")


def _note(since: np.ndarray, frequent: DataFrame, step: int) -> set[int]:
    """Enter the phrases that became frequent in ``step``; their lengths. ``SLOTS`` numbers a length at most come to
    the driver."""
    slot = F.col("g").bitwiseAND(F.lit(since.shape[1] - 1)).cast("int")
    found = frequent.select("k", slot.alias("slot")).distinct().toArrow()
    k, slot = found.column("k").to_numpy(), found.column("slot").to_numpy()
    at = k <= len(since)
    since[k[at] - 1, slot[at]] = np.minimum(since[k[at] - 1, slot[at]], step)
    return set(k.tolist())


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS,
                  lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times or more, and the words of each language.

    The first table has ``k, g, p, q, n`` and, for single words, ``lang`` and ``word``; ``p`` and ``q`` are the hashes
    ``g`` of the two subphrases. The second has ``lang`` and ``n_lang``, all its occurrences of words.
    """
    if shards * longest >= _NEVER:
        raise ValueError("at most 254 steps")
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark)}/shards"
    dealt = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("text", "lang", F.monotonically_increasing_id()), F.lit(shards)))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    corpus = spark.read.schema("lang string, text string, shard int").parquet(folder)

    pending = spark.createDataFrame([], _COUNTS + ", since int")
    since = np.full((max(longest - 1, 1), SLOTS), _NEVER, np.uint8)
    found: list[DataFrame] = []                 # what became frequent, or completed, in each step
    newest: dict[int, int] = {}                 # last step in which a phrase of a length became frequent
    totals, step = None, 0
    while True:
        lengths = {k for k in range(1, longest + 1)
                   if (step < shards if k == 1 else k - 1 in newest and step <= newest[k - 1] + shards)}
        if not lengths:
            break
        used = np.flatnonzero(since < _NEVER).astype(np.uint32)
        known = spark.sparkContext.broadcast((used, since.ravel()[used]))     # 5 bytes for each slot in use
        new = _scan(corpus.filter(F.col("shard") == step % shards), step, shards, lengths, known, since.shape)
        summed = new.withColumn("since", F.lit(None).cast("int")).unionByName(pending).groupBy(
            "k", "lang", "word", "p", "q", "start").agg(F.sum("n").alias("n"), F.max("since").alias("since"))
        last = F.col("start") + (shards - 1)
        state = shared_write(summed.select(
            "k", "lang", "word", "p", "q", "n", "start",
            F.coalesce("since", F.when(F.col("n") >= least, F.lit(step))).alias("since")))
        known.destroy()
        news = state.filter("since IS NOT NULL").filter((F.col("since") == step) | (last == step))
        found.append(shared_write(_named(news)))
        newest |= dict.fromkeys(_note(since, found[-1].filter(F.col("since") == step), step), step)
        if step == shards - 1:
            totals = state.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n_lang"))
        pending = state.filter(last > step)
        step += 1
    complete = [f.filter(F.col("start") + (shards - 1) == s) for s, f in enumerate(found)]
    return _union(complete).select("k", "lang", "word", "g", "p", "q", "n"), totals


def _with_parts(counted: DataFrame, longest: int) -> list[DataFrame]:
    """For each length from 1: ``g, lang, phrase, last, a, heads, tails`` of the phrases, and ``p``, ``q``.

    ``heads[i]`` and ``tails[i]`` are the counts of the phrase's first and last i + 1 words.
    """
    none = F.array().cast("array<long>")
    out = [counted.filter("k = 1").select("g", "p", "q", "lang", F.col("word").alias("phrase"),
                                          F.col("word").alias("last"), F.col("n").alias("a"), none.alias("heads"),
                                          none.alias("tails"))]
    for k in range(2, longest + 1):
        left = out[-1].select(F.col("g").alias("p"), "lang", F.col("phrase").alias("before"), F.col("a").alias("l"),
                              "heads")
        right = out[-1].select(F.col("g").alias("q"), "last", F.col("a").alias("r"), "tails")
        rows = counted.filter(F.col("k") == k).select("g", "p", "q", F.col("n").alias("a"))
        out.append(shared_write(rows.join(left, "p").join(right, "q").select(
            "g", "p", "q", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "a",
            F.concat("heads", F.array("l")).alias("heads"), F.concat("tails", F.array("r")).alias("tails"))))
    return out


#: exact: 38 digits hold 1000 * a * n and l * r of counts of up to 10^17; the quotient is 10 * n at most
_CUT = """array_min(transform(sequence(1, size(heads)), j -> struct(
    (CAST(1000 AS decimal(4, 0)) * CAST(a AS decimal(17, 0)) * CAST(n AS decimal(17, 0)))
        div (CAST(heads[j - 1] AS decimal(19, 0)) * CAST(tails[size(tails) - j] AS decimal(19, 0))) AS score,
    j, heads[j - 1] AS l, tails[size(tails) - j] AS r)))"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST,
                 shards: int = SHARDS, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language with the highest scores.

    Phrases of 2 to ``longest`` words that occur ``least`` times or more within the pieces of a language's texts, as
    cut at their weakest place; those that only occur inside a longer one of equal count are left out. Order: score
    and count descending, phrase ascending (bytes). Null texts are empty, null languages ``und``; repeated rows count
    each; other columns, ids among them, are ignored; an empty table gives an empty one. A task holds one slice of
    ``SLICE_BYTES``, or one longer text, and the slots.
    """
    counted, totals = count_phrases(docs, least, longest, shards, lang, text)
    parts = _with_parts(counted, longest)
    phrases = _union(parts[1:])
    inside = [longer.select(F.col(side).alias("g"), F.col("a").alias("longer")) for longer in parts[2:]
              for side in ("p", "q")]
    if inside:
        within = _union(inside).groupBy("g").agg(F.max("longer").alias("longer"))
        phrases = phrases.join(within, "g", "left").filter("longer IS NULL OR longer < a")
    scored = (phrases.join(totals.withColumnRenamed("n_lang", "n"), "lang").withColumn("cut", F.expr(_CUT))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
