"""Phrase mining against SQL on the given tables and against plain counting on made texts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.compare import compare, oracle
from keepsake.llm import collocations as C
from keepsake.llm import queries


def plain(rows, least, longest, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = []
    frequent = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    for (lang, w), a in frequent.items():
        if any(la == lang and b >= a and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (la, v), b in frequent.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, w[:j]] * counts[lang, w[j:]]), j) for j in range(1, len(w))]
        score, j = min(cuts)
        out.append((lang, " ".join(w), a, counts[lang, w[:j]], counts[lang, w[j:]], totals[lang], score))
    ranked = []
    for lang in totals:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:first]
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def mined(df, **how):
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


def made(seed, n, words="a b c d É é the of x1 B"):
    rng = random.Random(seed)
    vocabulary = words.split()
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", " \x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary[:rng.choice([2, 4, 10])]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice([text, text, text, None, ""])))
    return rows


@pytest.mark.parametrize("seed,shards,longest", [(1, 3, 5), (2, 1, 5), (3, 4, 3), (4, 2, 2)])
def test_made_texts(spark, seed, shards, longest):
    rows = made(seed, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain(rows, 4, longest, 25)
    assert mined(df, least=4, longest=longest, first=25, shards=shards) == want and len(want) > 20


def test_shared_slots_change_nothing(spark, monkeypatch):
    """Many phrases under one slot: runs start early or for nothing, the counts stay exact."""
    monkeypatch.setattr(C, "SLOTS", 4)
    rows = made(9, 80, " ".join(f"w{i}" for i in range(10)))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    # workers import the module anew: the slots of a scan must be the driver's
    since = np.full((4, 4), C._NEVER, np.uint8)
    since[0, 1] = 2
    assert C._slot(since, 1, np.array([1, 5, 2], np.uint64)).tolist() == [2, 2, C._NEVER]
    assert mined(df, least=3, first=50) == plain(rows, 3, 5, 50)


def test_late_words_open_late_windows(spark):
    """Words that become frequent in the last shard only: their phrases run on into further cycles."""
    rows = [("en", f"rare{i % 3} pair{i % 3} tail end here.") for i in range(36)] + [("en", "filler")] * 50
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(df, least=10, shards=4) == plain(rows, 10, 5, 2000)


def test_a_shared_slot_opens_no_run_before_its_parts():
    """A slot taken early by another phrase, over a word that is frequent late: still one whole cycle."""
    part = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c"])], ["lang", "text"])
    since = np.full((2, 1 << 16), C._NEVER, np.uint8)
    blank = since.copy()
    words = {b.column("word")[i].as_py(): np.uint64(b.column("p")[i].as_py() % 2 ** 64)
             for b in C._counted(part, 0, 3, {1}, blank) for i in range(b.num_rows)}
    a, b, c = (words[w] for w in "abc")
    slot = lambda h: int(h) & 0xFFFF
    one = lambda p, q: C._join(np.array([p]), np.array([q]), 2)[0]
    seen = []
    for step in range(12):
        for row, h, when in ((0, a, 0), (0, b, 0), (0, c, 4), (1, one(a, b), 1), (1, one(b, c), 1)):
            if when < step:
                since[row, slot(h)] = when
        seen += [(step, r["start"]) for b3 in C._counted(part, step, 3, {3}, since) for r in b3.to_pylist()]
    assert seen == [(6, 6), (7, 6), (8, 6)]


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_itemset_counting(spark, folder)
    rows = got.collect()
    assert len(rows) > 50
    assert compare(got.schema, rows, oracle(folder).execute(queries.OP12_SQL)) is None


def test_products_beyond_64_bits(spark):
    a, n, head, tail = 3 * 10 ** 15, 9 * 10 ** 15, 4 * 10 ** 15, 10 ** 15 + 7
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.array(F.lit(head)).alias("heads"),
                                F.array(F.lit(tail)).alias("tails")).select(F.expr(C._CUT).alias("cut")).first().cut
    assert row.score == 1000 * a * n // (head * tail) and (row.j, row.l, row.r) == (1, head, tail)


def test_odd_rows(spark):
    schema = "lang string, text string, k int, p long, g long, word string, n_lang long"
    rows = [("en", "a b " * 30, 1, 2, 3, "x", 4), ("en", "a b " * 30, 1, 2, 3, "x", 4), (None, None, 1, 2, 3, "x", 4),
            (None, "", None, None, None, None, None), ("en", "a" * 300_000, 1, 2, 3, "x", 4),
            ("de", " ".join("z" for _ in range(900_000)), 1, 2, 3, "x", 4)]
    df = spark.createDataFrame(rows, schema)
    assert mined(df, least=50, first=3) == plain([r[:2] for r in rows], 50, 5, 3)
    assert mined(df.limit(0)) == [] and mined(df, least=10 ** 9) == []
