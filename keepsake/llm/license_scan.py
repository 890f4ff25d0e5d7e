"""License scan by diagonal voting.

The hashes of all rolling word pairs of every text are joined in Spark with the positions they have in the templates.
A hit at text word ``p`` and template word ``q`` votes for the diagonal ``p - q``. Votes are gathered for each document,
template and diagonal; a diagonal with every vote of its template is the template word for word. Longer templates may
be changed a little: their diagonals with several votes are merged with neighbours (an inserted or missing word shifts
the rest). A merged span is then verified: enough distinct positions of the template must stand in it in their order,
within about the right length. A part that is repeated counts once.

One scan; only templates (a fixed list) are broadcast. Votes are summed before the shuffle, and a document's votes are
bounded by its length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm import kernels as K

GRAM = 2
#: diagonals that an edit may lie apart, share of a template that must be found, and how much longer a span may be
SLACK, COVERED, STRETCH = 3, 0.7, 1.5
#: word pairs a template may have; the positions found are bits of a number
MOST_PAIRS = 63

# Phrases that are counted wherever they stand, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Opening sentences of well-known licenses and notices, as words.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution", "cc"),
)


def _pairs(text: str) -> np.ndarray:
    data, offsets = K.text_bytes(pa.array([text]))
    words = K.find_words(data, offsets, K.ALNUM)
    return K.gram_hashes(K.span_hashes(data, words.start, words.end), GRAM)


def template_positions(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(h, template, exact, label, q, n_votes): where each word pair stands in the templates."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *notices]):
        hashes = K.signed(_pairs(text)).tolist()
        if len(hashes) > MOST_PAIRS:
            raise ValueError(f"a template has {MOST_PAIRS + GRAM - 1} words at most; cut it into several")
        rows += [(h, number, number < len(phrases), label, q, len(hashes)) for q, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "h long, template int, exact boolean, label string, q int, n_votes int")


def _rolling(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row for each document: its number in the scan, and the hashes of its word pairs behind one filler."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"),
                       F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, offsets = K.text_bytes(part.column("text"))
                data = K.LOWER[data]
                words = K.find_words(data, offsets, K.ALNUM)
                size = words.counts
                count = np.maximum(size - GRAM + 1, 0)
                hashes = K.gram_hashes(K.span_hashes(data, words.start, words.end), GRAM)
                hashes = hashes[K.gram_mask(words.first, GRAM)]
                limits = np.r_[0, np.cumsum(count)]
                filled = np.insert(K.signed(hashes), limits[:-1], 0)
                limits = (limits + np.arange(len(limits))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(limits), pa.array(filled))],
                    ["row", "doc_id", "n_words", "pairs"])

    return rows.mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n_words long, pairs array<long>")


def diagonal_votes(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases=PHRASES,
                   notices=NOTICES) -> DataFrame:
    """(row, doc_id, n_words, template, exact, label, n_votes, diagonal, votes, places).

    ``places`` has a bit for each template position that voted.
    A document without any vote keeps one row with null template.
    """
    templates = template_positions(docs.sparkSession, phrases, notices)
    grams = _rolling(docs, id, text).select("row", "doc_id", "n_words", F.posexplode("pairs").alias("p", "h"))
    met = grams.join(F.broadcast(templates), "h", "left").filter((F.col("p") == 0) | F.col("q").isNotNull())
    filler = F.col("p") == 0
    named = met.select("row", "doc_id", "n_words", *[
        F.when(~filler, F.col(c)).alias(c) for c in ("template", "exact", "label", "n_votes", "q")],
        F.when(~filler, F.col("p") - 1 - F.col("q")).alias("diagonal"))
    return named.groupBy("row", "doc_id", "n_words", "template", "exact", "label", "n_votes", "diagonal").agg(
        F.count("q").alias("votes"),
        F.bit_or(F.expr("shiftleft(1L, q)")).alias("places"))


def _ascending(places: np.ndarray) -> tuple[int, int]:
    """Length of the longest run of ascending template positions that begins with the first (p, q), and its last p."""
    (start, least), tails, ends = places[0], [], []
    k = 1
    while k < len(places):
        p, new = places[k][0], []
        while k < len(places) and places[k][0] == p:        # one text position holds one template position
            if places[k][1] > least and p > start:
                new.append(places[k][1])
            k += 1
        for q in sorted(new, reverse=True):
            at = bisect_left(tails, q)
            tails[at:at + 1], ends[at:at + 1] = [q], [p] if at == len(ends) else [ends[at]]
    return 1 + len(tails), ends[-1] if ends else start


def verified_places(diagonals: list[tuple[int, int]], n_votes: int) -> list[tuple[int, int, float]]:
    """(start, end, covered) of the places in one span of ``(diagonal, places)`` that hold enough of a template in order.

    Places don't overlap: the one with most of the template comes first, then the best of what is left beside it.
    """
    places = np.array(sorted((d + q, q) for d, mask in diagonals for q in range(n_votes) if mask >> q & 1))
    text, width = places[:, 0], int((n_votes + GRAM - 1) * STRETCH) - GRAM
    need = COVERED * n_votes - 1e-9
    found = []
    for i in range(len(places)):
        to = int(np.searchsorted(text, text[i] + width, side="right"))
        if to - i >= need:
            size, last = _ascending(places[i:to].tolist())
            if size >= need:
                found.append((-size, int(text[i]), int(last) + GRAM))
    kept: list[tuple[int, int, float]] = []
    for size, start, end in sorted(found):
        if all(end <= a or start >= b for a, b, _ in kept):
            kept.append((start, end, min(1.0, -size / n_votes)))
    return sorted(kept)


def license_spans(votes: DataFrame) -> DataFrame:
    """Verified places (row, doc_id, n_words, exact, label, start, end, covered), words from 0, end excluded.

    Rows without a place keep one row with null label; ``covered`` is then half of the best share of a template that was
    found.
    """
    exact = votes.filter("exact AND votes = n_votes").select(
        "row", "doc_id", "n_words", "exact", "label", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("n_votes") + (GRAM - 1)).alias("end"), F.lit(1.0).alias("covered"))
    loose = votes.filter("NOT exact AND (votes > 1 OR n_votes = 1)")
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_template) > SLACK).cast("int"), F.lit(0))
    grouped = loose.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by_template))
    share = F.bit_count(F.bit_or("places")) / F.first("n_votes")
    spans = grouped.groupBy("row", "doc_id", "n_words", "template", "label", "n_votes", "span").agg(
        share.alias("share"), F.collect_list(F.struct("diagonal", "places")).alias("diagonals"))
    names = ["row", "doc_id", "n_words", "label", "start", "end", "covered"]

    def verify(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                places = []
                if r["share"] >= COVERED:
                    places = verified_places([(d["diagonal"], d["places"]) for d in r["diagonals"]], r["n_votes"])
                own = [r["row"], r["doc_id"], r["n_words"]]
                rows += [[*own, r["label"], *p] for p in places] or [
                    [*own, None, None, None, min(r["share"], 0.99) / 2]]
            kinds = [pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int32(), pa.int32(),
                     pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    near = spans.mapInArrow(verify, f"row long, doc_id {dict(votes.dtypes)['doc_id']}, n_words long, label string, "
                                    "start int, end int, covered double").withColumn("exact", F.lit(False))
    none = votes.filter("template IS NULL").select(
        "row", "doc_id", "n_words", F.lit(False).alias("exact"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0.0).alias("covered"))
    return exact.unionByName(near).unionByName(none)


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases=PHRASES,
                  notices=NOTICES) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. ``n_base`` counts all
    places of the exact phrases; ``first_word`` and ``last_word`` are their smallest and largest start (null without
    one). Labels are distinct, sorted and joined by commas, empty without any. ``score`` is 1 with an exact phrase,
    else the share of the best notice found (halved below the threshold), 0 without votes. A null or empty text has no
    words; repeated rows and null ids come back each; an empty table gives an empty one.
    """
    # votes are read for exact, loose and missing places alike: one scan, stored once
    from keepsake.llm.ranks import shared_write

    spans = license_spans(shared_write(diagonal_votes(docs, id, text, phrases, notices)))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")    # noqa: E731  a template list bounds it
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        listed(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"),
        F.max("covered").alias("score")).drop("row")
