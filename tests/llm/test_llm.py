"""Operators for training data against plain versions, on the small tables and on odd rows."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import plain
from keepsake.llm import (decontaminate, fingerprints, html_main, license_scan, near_duplicates, packing, pretokens,
                          quality, queries, ranks, substrings, token_counts)

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PASSAGE = " ".join(f"common{i}" for i in range(60))
ODD = "doc_id long, text string, lang string, n_words long, score double, hits string, u long, row long, h long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns called as the operators call theirs."""
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, LONG), (5, LONG), (6, "All rights reserved. " * 3),
             (6, "cc by"), (None, "one two three"), (None, None), (7, PASSAGE), (8, "lead in " + PASSAGE + " tail"),
             (9, "!!! ???"), (10, "ünï côdé 漢字 CC BY cc by <|endoftext|> x"), (11, "a"), (12, "A")]
    rows = [(i, t, None, 0, 0.0, "x", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary_path()


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


# ---- tokens ---------------------------------------------------------------------------------------------------------

def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_pretokens_match_the_library(path):
    rng = np.random.default_rng(5)
    parts = ["a", "'s", "'", "'re", " ", "  ", "\n", "\t", "é", "1", "²", "!", "…", " ", "　", "<|endoftext|>",
             "<|endof", "'ll", "'LL", "漢", "😀", "\x1c", "\x85", " '", "''s", "'ve", "ǅ", "١"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)] + ["", "'", " ", "\n"]
    memory = pretokens.Memory(pretokens.load_vocabulary(path))
    import pyarrow as pa
    from keepsake.llm import kernels
    ids, first = pretokens.row_ids(*kernels.text_bytes(pa.array(texts)), memory)
    for i, e in enumerate(library(path).encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[first[i]:first[i + 1]].tolist(), texts[i]


def test_pretoken_memory_is_bounded(path):
    memory = pretokens.Memory(pretokens.load_vocabulary(path))
    memory.BITS = 17
    memory.reset()
    import pyarrow as pa
    from keepsake.llm import kernels
    for part in range(6):
        texts = [f"w{part}q{i}z" for i in range(12_000)]
        counts = pretokens.row_counts(*kernels.text_bytes(pa.array(texts)), memory)
        assert counts.tolist() == [len(e.ids) for e in library(path).encode_batch(texts)]
    assert memory.used <= 1 << 17


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, empty, name):
    import public_tokenizers
    file = public_tokenizers.path(name)
    got = token_counts.count_tokens(odd, file)
    rows = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got.collect())
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        p = SentencePieceProcessor(model_file=file)
        count = lambda t: len(p.encode(t))
    else:
        t = library(file)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), count(r["text"] or "")) for r in odd.collect())
    assert rows == want
    assert token_counts.count_tokens(empty, file).count() == 0


def check_packing(rows, texts, path, limit, end_id):
    tok = library(path)
    by, pieces = {}, {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    for i, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        got = sorted(pieces.pop(i), key=lambda r: r["piece"])
        assert [r["start"] for r in got] == np.cumsum([0] + [r["length"] for r in got[:-1]]).tolist()
        assert sum(r["length"] for r in got) == len(ids)
        assert all(r["length"] == limit for r in got[1:]) and (len(ids) > limit or len(got) == 1)
        for r in got:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert not pieces
    return len(by)


def test_packing(spark, documents, path):
    rows = packing.pack_documents(documents, path, 256).collect()
    used = check_packing(rows, texts_of(documents), path, 256, 2)
    assert used <= -(-sum(r["length"] for r in rows) // 256) * 1.05 + 1


def test_packing_odd_rows(spark, odd, empty, path):
    rows = packing.pack_documents(odd, path, 64).collect()
    tok = library(path)
    want = sum(len(tok.encode(r["text"] or "").ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == want
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert len({s[:2] for s in spans}) == len(spans)
    assert packing.pack_documents(empty, path, 64).count() == 0


def test_pieces_keep_ids(spark, odd, path):
    for r in packing.token_pieces(odd, path, 64, 2, keep_ids=True).collect():
        assert len(r["ids"]) == r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_best_two_fit_replaces_the_smallest():
    # greedy: 6 + 3, gap 1; 3 gives way to 2 + 2, which fill the gap of 4
    first = [s for s in packing.plan_best_two_fit({6: 1, 3: 1, 2: 2}, 10) if s.base == 0]
    assert sorted((s.length, s.times) for s in first) == [(2, 2), (6, 1)]
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(rng.integers(1, 500)) for k in rng.choice(np.arange(1, 101), 12, replace=False)}
        placed, size = {}, {}
        for s in packing.plan_best_two_fit(counts, 100):
            placed[s.length] = placed.get(s.length, 0) + s.times * s.bins
            size[s.base] = size.get(s.base, 0) + s.length * s.times
        assert placed == counts and max(size.values()) <= 100


# ---- substrings, benchmarks -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("base", [2, 4, 7, 13])
def test_substrings(spark, documents, base):
    got = as_dict(substrings.remove_repeats(documents, base=base))
    want = plain.without_repeats(texts_of(documents))
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in got.items()} == want


def test_substrings_odd_rows(spark, odd, empty):
    got = substrings.remove_repeats(odd, others=("lang", "n_words", "hits"), joined=False)
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[4, 20_000]["n_removed"] == 0 and by[5, 20_000]["n_removed"] == 20_000
    assert sum(r["n_removed"] for r in rows if r["doc_id"] == 5) == 40_000
    assert by[8, 63]["n_removed"] == 60 and by[8, 63]["kept_text"] == "lead in tail"
    assert by[3, 0]["kept_text"] == "  \n\t " and by[3, 0]["others"]["hits"] == "x"
    assert by[None, 3]["n_removed"] == 0
    assert substrings.remove_repeats(empty).count() == 0


def test_level_lengths():
    assert substrings.level_lengths(13, 7) == [7, 13]
    assert substrings.level_lengths(13, 2) == [2, 4, 7, 13]


def test_fm_index_matches_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = rng.integers(2, 6, rng.integers(1, 400))
        index = decontaminate.FMIndex(text, every=5)
        phrases = [rng.integers(2, 7, rng.integers(1, 6)) for _ in range(30)]
        first = np.r_[0, np.cumsum([len(p) for p in phrases])]
        low, high = index.search(np.concatenate(phrases), first)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(text) - len(p) + 1) if (text[k:k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_words", [50, 10**6])
def test_decontamination(spark, documents, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate.phrase_blocks, "__defaults__", ("item_id", "text", block_words))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(
        [(900, "all rights"), (901, None), (902, "!!"), (None, "of the"), (903, "x")], "item_id long, text string"))
    found = decontaminate.contamination(decontaminate.find_phrases(documents, items))
    known = {r["item_id"]: r["text"] for r in items.collect() if r["item_id"] is not None}
    for r in found.collect():
        n, hit, names = plain.contamination(r["text"], known)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == plain.sha(",".join(names))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert sum(h["end"] - h["start"] for h in r["hits"]) == hit


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "rights reserved"), (2, PASSAGE)], "item_id long, text string")
    rows = decontaminate.contamination(decontaminate.find_phrases(odd, items)).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["n_hit"] for r in rows if r["n_hit"]} == {6: 6, 7: 60, 8: 60}
    assert decontaminate.find_phrases(empty, items).count() == 0
    none = decontaminate.contamination(decontaminate.find_phrases(odd, items.limit(0))).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == len(rows)


# ---- near duplicates ----------------------------------------------------------------------------------------------------

def test_alignment_is_bounded_by_shingles():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a = rng.integers(1, 40, 120).astype(np.uint64)
        b = list(a)
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(0, len(b)))
            kind = rng.integers(0, 3)
            if kind == 0:
                b[k] = np.uint64(99)
            elif kind == 1:
                b.insert(k, np.uint64(77))
            else:
                del b[k]
        got = near_duplicates.aligned_similarity(a, np.array(b, np.uint64), 0.0)
        want = plain.shingle_similarity(a.tolist(), [int(x) for x in b])
        assert want - 0.08 <= got <= want + 1e-9
    a = np.arange(100, dtype=np.uint64)
    assert near_duplicates.aligned_similarity(a, a) == 1.0
    assert near_duplicates.aligned_similarity(a, a[::-1].copy()) == 0.0


def edited(base, rng, edits):
    words = base.split()
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def test_near_duplicates_find_planted_copies(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"t{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(base)]
    group = {}
    for i in range(0, 60):
        for copy in range(3):
            text = edited(base[i], rng, max(1, len(base[i].split()) // 60))
            if plain.shingle_similarity(plain.words(base[i]), plain.words(text)) >= 0.82:
                group[1000 + 10 * i + copy] = i
                rows.append((1000 + 10 * i + copy, text))
    # a large group whose copies are only similar to their base, not to each other
    for k in range(300):
        rows.append((5000 + k, edited(base[100], rng, max(1, len(base[100].split()) // 55))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = as_dict(near_duplicates.near_duplicate_classes(docs))
    assert len(got) == len(rows)
    assert all(got[i]["class_id"] == g for i, g in group.items())
    near = [5000 + k for k in range(300)
            if plain.shingle_similarity(plain.words(base[100]), plain.words(dict(rows)[5000 + k])) >= 0.8]
    assert near and all(got[i]["class_id"] == 100 for i in near)
    alone = set(range(150)) - set(group.values()) - {100}
    assert all(got[i]["class_id"] == i for i in alone)


def test_short_near_duplicates_are_found_exactly(spark):
    rng = np.random.default_rng(7)
    texts = ["a b c d e f g h i", "a b c d e f g h"]        # shingles 5 and 4 of 5
    for _ in range(60):
        base = [f"v{rng.integers(4000)}" for _ in range(int(rng.integers(5, 42)))]
        texts.append(" ".join(base))
        for _ in range(4):
            left, right = rng.integers(0, 3, 2)
            ends = [[f"n{rng.integers(9)}" for _ in range(int(k))] for k in rng.integers(0, 3, 2)]
            texts.append(" ".join(ends[0] + base[left:len(base) - right] + ends[1]))
        texts.append(edited(" ".join(base), rng, 1))
    words = [t.split() for t in texts]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    met = 0
    number = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
    coded = [near_duplicates.K.mix(np.array([number[w] for w in t], np.uint64) + np.uint64(1)) for t in words]
    for i in range(len(texts)):
        for j in range(i):
            if near_duplicates.aligned_similarity(coded[i], coded[j]) >= 0.8:
                met += words[i] != words[j]
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert met > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = as_dict(near_duplicates.near_duplicate_classes(docs))
    assert got[0]["class_id"] == got[1]["class_id"]
    assert {i: got[i]["class_id"] for i in got} == {i: top(i) for i in range(len(texts))}


def test_near_duplicates_odd_rows(spark, odd, empty):
    rows = near_duplicates.near_duplicate_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[5] == {4} and by[12] == {11} and by[1] == {1} and by[2] == {2} and by[9] == {9} and by[None] == {None}
    assert near_duplicates.near_duplicate_classes(empty).count() == 0


def test_labels_joined_bit_by_bit(spark):
    """Classes after several batches of links are those of all links at once."""
    rng = np.random.default_rng(8)
    links = [tuple(map(int, rng.choice(120, 2, replace=False))) for _ in range(90)]
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    classes = lambda df: {frozenset(v) for v in _groups((r["label"], r["u"]) for r in df.collect()).values()}
    labels = None
    for k in range(0, 90, 30):
        labels = near_duplicates._joined_labels(labels, frame(links[k:k + 30]))
    assert classes(labels) == classes(near_duplicates.components(frame(links)))
    assert near_duplicates._joined_labels(None, frame([])) is None


def _groups(pairs):
    import collections
    out = collections.defaultdict(set)
    for k, v in pairs:
        out[k].add(v)
    return out


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (20, 10), (10, 11)], "a long, b long")
    got = {r["u"]: r["label"] for r in near_duplicates.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 8, 8: 8, 20: 10, 10: 10, 11: 10}


# ---- licenses, quality, fingerprints ------------------------------------------------------------------------------------

def check_licenses(rows, docs):
    assert len(rows) == len(docs)
    want = []
    for i, t in docs:
        w, places = plain.phrase_places(t, license_scan.PHRASES)
        starts = [k for k, _ in places]
        want.append((i or 0, len(w), len(places), min(starts, default=-1), max(starts, default=-1),
                     ",".join(sorted({x for _, x in places}))))
    got = [(r["doc_id"] or 0, r["n_words"], r["n_base"], -1 if r["first_word"] is None else r["first_word"],
            -1 if r["last_word"] is None else r["last_word"], r["base_labels"]) for r in rows]
    assert sorted(got) == sorted(want)
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_licenses(spark, documents, odd, empty):
    for docs in (documents, odd):
        rows = license_scan.scan_licenses(docs).collect()
        check_licenses(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert license_scan.scan_licenses(empty).count() == 0


def test_licenses_with_edits(spark):
    texts = {1: "x y Released under the MIT License.", 2: "Licensed under the new Apache License, Version 2.0 ok",
             3: "permission is granted free of charge to any person who is obtaining a copy of this software and its "
                "associated documentation files the software to deal in the software without any restriction",
             4: "the license of the version under the", 5: "cc cc by by cc by"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = as_dict(license_scan.scan_licenses(docs))
    assert [got[i]["labels"] for i in sorted(texts)] == ["mit", "apache-2.0", "mit", "", "cc-by"]
    assert got[5]["n_base"] == 2 and got[5]["first_word"] == 1 and got[4]["score"] < 0.7 < got[3]["score"]


def covered_by(words, notice):
    """Largest share of a notice's word pairs that stand in order inside a window of the allowed length."""
    pairs, wanted = list(zip(words, words[1:])), list(zip(notice, notice[1:]))
    width, best = int(len(notice) * license_scan.STRETCH) - 1, 0
    for start in range(len(pairs)):
        row = [0] * (len(wanted) + 1)
        for pair in pairs[start:start + width]:
            new = row[:]
            for q, other in enumerate(wanted):
                new[q + 1] = max(new[q], row[q + 1], row[q] + 1 if pair == other else 0)
            row = new
        best = max(best, row[-1])
    return best / len(wanted)


def test_license_spans_hold_the_notice_in_order(spark):
    """Repeated parts of a notice are no notice; every label is one that a plain alignment finds, and none is lost."""
    rng = np.random.default_rng(12)
    notices = [(text.split(), label) for text, label in license_scan.NOTICES]
    texts = {1: "you may not " * 5, 2: "in the software " * 12, 3: "of this software and " * 9,
             4: "you may not " * 40 + "you may not use this file except in compliance with the license " + "you may " * 9}
    planted = {4: "apache-2.0"}
    for i in range(10, 160):
        words, label = notices[rng.integers(len(notices))]
        words = list(words)
        kind = i % 3
        if kind == 0:       # one word missing or added: still there
            k = int(rng.integers(2, len(words) - 2)) if len(words) > 8 else 0
            words[k:k] = ["extra"] if len(words) > 8 and rng.random() < 0.5 else []
            planted[i] = label
        elif kind == 1:     # pieces in another order, some twice
            cut = [words[k:k + 3] for k in range(0, len(words), 3)]
            words = [w for k in rng.integers(0, len(cut), len(cut) + 3) for w in cut[k]]
        else:
            words = words[:len(words) // 2]
        texts[i] = " ".join([*(f"a{k}" for k in range(rng.integers(0, 6))), *words, *(f"b{k}" for k in range(4))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: set(filter(None, r["labels"].split(","))) for i, r in as_dict(license_scan.scan_licenses(docs)).items()}
    assert not got[1] and not got[2] and not got[3]
    exact = {label for _, label in license_scan.PHRASES}
    for i, t in texts.items():
        may = {label for words, label in notices if covered_by(plain.words(t), words) >= license_scan.COVERED}
        assert got[i] - exact <= may, t
    for i, label in planted.items():
        assert label in got[i], texts[i]


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = as_dict(quality.score_documents(docs, labels))
    assert len(scored) == docs.count()
    assert all(r["held_out"] == (plain.fold(i) == 0) for i, r in scored.items())
    held = [(scored[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if plain.fold(r["doc_id"]) == 0]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in scored.values())


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 8] < 0.6)).astype(float)
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) <= 200
    frame = spark.createDataFrame([(tuple(map(float, r)),) for r in x[:200]],
                                  "_statistics struct<" + ",".join(f"{s}: double" for s in quality.STATISTICS) + ">")
    got = np.array([r["s"] for r in frame.select(model.column().alias("s")).collect()])
    z = np.full(200, model.intercept)
    for rule, weight in model.rules:
        z += rule.holds(x[:200]) * weight
    for s, weight, low, high in model.linear:
        z += np.clip(x[:200, s], low, high) * weight
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert ((got > 0.5) == y[:200]).mean() > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(empty, labels.limit(0)).count() == 0
    kept = quality.score(odd, quality.RuleModel(0.0, (), ()))
    assert set(kept.columns) == set(odd.columns)


def test_fingerprints(spark, documents):
    rows = as_dict(fingerprints.edit_robustness(documents))
    texts = texts_of(documents)
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    same = lambda a, b: np.mean([a[k:k + 4] == b[k:k + 4] for k in range(0, len(a), 4)])
    by_text = {}
    for i in ids:
        r, t, head = rows[i], texts[i] or "", texts[after[i]] or ""
        k = len(t) // 4
        assert r["n_chars"] == len(t) and r["edited_sha256"] == plain.sha(t[:len(t) - k] + head[:k])
        assert r["near_edited"] == pytest.approx(same(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(same(r["fingerprint"], rows[after[i]]["fingerprint"]))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.4
    assert np.mean([r["near_next"] for r in rows.values()]) < 0.05


def test_subsets_are_the_same_for_every_document():
    """A subset's hash covers all of a document's terms in a fixed share of the lexicon, not only its smallest ones."""
    words = [f"w{i}" for i in range(3000)]
    data = [" ".join(words), " ".join(words[:5])]
    hashes = lambda t: fingerprints._terms(*fingerprints.K.text_bytes(fingerprints.pa.array(t)))[0]
    lexicon = hashes(data[:1])
    marks = lambda t: fingerprints.subset_hashes(*fingerprints.K.text_bytes(fingerprints.pa.array([t])), lexicon)[0]
    whole, short = marks(data[0]), marks(data[1])
    touched = np.zeros(len(words))
    for k in range(0, 3000, 30):
        touched[k] = np.sum(marks(" ".join(words[:k] + words[k + 1:])) != whole)
    # 32 subsets of one term in 128 each: a term is in a quarter of a subset on average
    assert 0.12 < touched[::30].mean() < 0.42
    # too few terms for most subsets: each takes its nearest term, and only documents with other ones differ
    assert (marks(" ".join(words[4::-1])) == short).all()
    assert (marks(" ".join(words[:4])) == short).sum() > 16 and (marks("w2000 w2001 w2002") == short).sum() < 3


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = fingerprints.edit_robustness(odd).collect()
    assert len(rows) == odd.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert fingerprints.edit_robustness(empty).count() == 0
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    (r,) = fingerprints.edit_robustness(one).collect()
    assert r["edited_sha256"] == plain.sha("abcdefab") and r["near_next"] == 1.0


def test_next_documents_across_cells_and_filled_by_one_id(spark):
    """Cut at many places, with an id that holds a third of all rows, next documents are those of a plain pass."""
    rng = np.random.default_rng(5)
    rows = [(int(k), f"text {k} " + "ab " * int(k % 7)) for k in rng.choice(10**6, 150, replace=False)]
    rows += [(500_000, f"copy {i} of one id") for i in range(80)] + [(None, f"no id {i}") for i in range(70)]
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    low = min(i for i, _ in rows if i is not None) - 1
    least = {}
    for i, t in rows:
        k = low if i is None else i
        least[k] = min(least.get(k, t), t)
    ids = sorted(least)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    want = []
    for i, t in rows:
        cut = len(t) // 4
        want.append((str(i), len(t), plain.sha(t[:len(t) - cut] + least[after[low if i is None else i]][:cut])))
    for cells in (1, 3, 40, 500):
        got = fingerprints.edit_robustness(docs, cells=cells).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    largest = (fingerprints.beside_next(docs, cells=40).filter("NOT _edge").groupBy("_cell").count()
               .agg({"count": "max"}).first()[0])
    assert largest < 40


def test_document_frequencies(spark, documents):
    import collections
    want = collections.Counter(w for t in texts_of(documents).values() for w in set(plain.words(t)))
    for most in (50, 1 << 20):
        got = fingerprints.document_frequencies(documents, most=most).collect()
        assert sorted(r["df"] for r in got) == sorted(want.values())


def test_next_values(spark):
    values = [5, -3, 100, 7, 7, 2**40, 8, None] + list(range(1000, 1400))
    keys = spark.createDataFrame([(v,) for v in values], "k long")
    ordered = sorted({v for v in values if v is not None})
    for rows in (10, 10**6):
        got = {r["k"]: r["next"] for r in ranks.with_next(keys, "k", rows=rows).collect()}
        assert got == dict(zip(ordered, ordered[1:] + ordered[:1]))


# ---- pages --------------------------------------------------------------------------------------------------------------

def article(page):
    import html
    import re
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def field(spark):
    return html_main.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_main_text_of_all_pages(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_main.extract_main(pages, field).collect()
    assert len(rows) == len(source)
    assert all(r["text"] == article(source[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_main_text_in_other_layouts(field):
    rng = np.random.default_rng(77)
    texts = [[f"Paragraph {k} of page {i} says that much, and it ends." for k in range(6)] for i in range(80)]
    others = [t for own in texts for t in own]
    right = total = 0
    for own in texts:
        blocks, labels = html_main.laid_out(own, others, rng)
        got = html_main.decode(field, html_main.block_features(blocks))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.95


def test_viterbi_is_the_best_path(field):
    import itertools
    rng = np.random.default_rng(6)
    for n in (1, 2, 5):
        features = [sorted(rng.choice(html_main.N_FEATURES, 5, replace=False).tolist()) for _ in range(n)]

        def worth(path):
            total = field.first[path[0]] + field.last[path[-1]] + sum(
                field.features[f, y] for own, y in zip(features, path) for f in own)
            return total + sum(field.pairs[a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=worth)
        assert worth(html_main.decode(field, features)) == pytest.approx(worth(best))


def test_leaf_blocks():
    page = ('<!DOCTYPE html><title>T &amp; t</title><style>p{}</style><body><nav><a href="x">Home</a></nav><article>'
            "<p>caf&eacute;&nbsp; &#8217;x&mdash; <b>bold<p>next<!-- no --> one<br>two<script>var a='</p>';</script>"
            "<ul><li>a<li>b</ul>tail</article><form><input value='>'><label>Mail</label></form>")
    got = [b.text for b in html_main.leaf_blocks(page)]
    assert got == ["Home", "café ’x— bold", "next one two", "a", "b", "tail", "Mail"]
    for broken in ("", "<", "<p", "a < b", "<p>x</div></p>", "<script>", "&#xZZ;", "<" * 50):
        html_main.leaf_blocks(broken)


@pytest.mark.parametrize("page, want", [
    ("<head><title>T</title><meta charset=utf-8><p>one<p>two", ["one", "two"]),
    ("<head><title>T</title><article><p>one</article>", ["one"]),
    ("<html><head><link href=x>one <b>two</b>", ["one two"]),
    ("<head><script>x</script><template><p>no</template></head><body><p>one", ["one"]),
    ("<p>x <math><mi>y</mi><annotation>no</annotation></math> z</p>", ["x y z"]),
    ("<p>x <svg><title>no</title><text>no</text></svg> y <canvas>no</canvas> z", ["x y z"]),
    ("<p>x <select><option>no</select> y <object><p>no</p></object> z</p><p>next", ["x y z", "next"]),
    ("<p>x <button>no</button> y <label>z</label> end</p>", ["x y z end"]),
    ("<div>x <button>no</div><div>y</div>", ["x", "y"]),
])
def test_blocks_with_omitted_and_hidden_elements(page, want):
    assert [b.text for b in html_main.leaf_blocks(page)] == want


def test_deep_pages_take_time_in_proportion():
    import time
    spent = []
    for depth in (2_000, 16_000):
        page = "<div><p>text" * depth + "</section></i>" * depth
        start = time.process_time()
        blocks = html_main.leaf_blocks(page)
        html_main.block_features(blocks)
        spent.append(time.process_time() - start)
        assert len(blocks) == depth
    assert spent[1] < 24 * spent[0] + 0.2


def test_pages_odd_rows(spark, field):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None, "x", 1), (None, "u", "", "x", 1), (2, "u", "<article><p>Hi there.</p></article>", "", 0),
            (2, "u", "<article><p>Hi there.</p></article>", "", 0)]
    got = html_main.extract_main(spark.createDataFrame(rows, schema), field).collect()
    assert sorted(r["text"] for r in got) == ["", "", "Hi there.", "Hi there."]
    none = spark.createDataFrame([], schema)
    assert html_main.extract_main(none).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    start = texts_of(docs)
    (_, classify), (_, near), (_, cut), (_, clean), (_, pack) = corpus_pipeline.STAGES
    good = ranks.shared_write(classify(spark, docs, folder))
    scored = as_dict(quality.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert set(texts_of(good)) == {i for i in start if scored[i]["predicted"]} and good.columns == columns
    single = ranks.shared_write(near(spark, good, folder))
    kept = texts_of(single)
    first = {}
    for i, t in sorted(texts_of(good).items()):
        first.setdefault(tuple(plain.words(t)) or i, i)
    assert set(kept) <= set(first.values()) and len(kept) > 0.8 * len(first) and single.columns == columns
    rest = ranks.shared_write(cut(spark, single, folder))
    want = {}
    for i, (n, gone, text) in plain.without_repeats(kept).items():
        if n == 0 or gone < n:
            want[i] = text if gone else kept[i]
    assert texts_of(rest) == want and rest.columns == columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in rest.collect())
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    clear = ranks.shared_write(clean(spark, rest, folder))
    judged = {i: plain.contamination(t, items) for i, t in want.items()}
    assert set(texts_of(clear)) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    rows = pack(spark, clear, folder).collect()
    check_packing(rows, texts_of(clear), queries.vocabulary_path(), 1024, 2)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        docs = docs.withColumn("n_chars", docs["n_words"])
        for name, stage in corpus_pipeline.STAGES:
            out = ranks.shared_write(stage(spark, docs, SF))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
                docs = out
        assert (out.count() > 0) == (docs.count() > 0)


def test_pipeline_keeps_the_values_of_clashing_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("n_words", "hits", "_text", "_kept", "contaminated", "n_hit", "items_sha256", "_score", "score", "row"):
        docs = docs.withColumn(name, (-docs.doc_id).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, folder)
        assert rows.schema.names == docs.schema.names
        got = rows.collect()
        assert got and all(r[c] == str(-r["doc_id"]) for r in got for c in docs.columns[5:])


def test_registered_queries():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names
