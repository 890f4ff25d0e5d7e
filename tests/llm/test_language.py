"""Language identification against a plain fusion of the same evidence."""

import collections
import math
import re

import numpy as np
import pytest

from keepsake.llm import kernels, language

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, lang string, host string, score double, own int"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_text(spark.read.parquet(f"{SF}/documents.parquet"))


def split(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    host = m[1].lower() if m else ""
    domain = re.search(r"([^.]+\.[^.]+)$", host)
    suffix = re.search(r"([^.]+)$", host)
    path = re.match(r"[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", url or "")
    suffix = suffix[1] if suffix else ""
    return host, domain[1] if domain else "", suffix, f"{suffix}/{path[1].lower() if path else ''}"


def plain_fusion(rows, languages):
    """{page_id: (language, posterior)} of (page_id, url, declared, evidence) rows, page by page."""
    n = len(languages)
    known = []
    for i, url, declared, evidence in rows:
        host, domain, suffix, address = split(url)
        known.append((i, int(np.argmax(evidence)), {"host": host, "domain": domain, "suffix": suffix,
                                                    "address": address, "declared": declared or ""}, evidence))
    counts = {k: collections.Counter((kinds[k], own) for _, own, kinds, _ in known)
              for k in ("host", "domain", "suffix", "address", "declared")}
    total = collections.Counter(own for _, own, _, _ in known)
    kinds_of = {k: len({kinds[k] for _, _, kinds, _ in known}) for k in ("address", "declared")}
    out = {}
    for i, own, kinds, evidence in known:
        less = [int(x == own) for x in range(n)]
        left = [total[x] - less[x] for x in range(n)]
        prior = [(left[x] + 1) / (sum(left) + n) for x in range(n)]
        for level in language.LEVELS:
            c = [counts[level][kinds[level], x] - less[x] for x in range(n)]
            prior = [(c[x] + prior[x] * language.STRENGTH) / (sum(c) + language.STRENGTH) for x in range(n)]
        weight = [math.log(prior[x]) + evidence[x] + sum(
            math.log((counts[k][kinds[k], x] - less[x] + language.UNSEEN) / (left[x] + kinds_of[k] * language.UNSEEN))
            for k in ("declared", "address")) for x in range(n)]
        best = int(np.argmax(weight))
        out[i] = (languages[best], 1 / sum(math.exp(w - weight[best]) for w in weight))
    return out


def test_fusion_matches_the_plain_one(spark):
    rng = np.random.default_rng(9)
    languages = ("de", "en", "fr")
    hosts = ["a.x.com", "b.x.com", "c.y.de", "d.z.fr", "e.z.fr"]
    rows = []
    for i in range(300):
        host = hosts[0] if i % 3 == 0 else str(rng.choice(hosts))
        path = str(rng.choice(["en/", "fr/", "", "de/"]))
        rows.append((i, f"http://{host}/{path}{i}", str(rng.choice(["en", "de", "fr"])) if i % 4 else None,
                     [float(x) for x in rng.normal(0, 2, 3)]))
    rows += [(900, None, None, [0.0, 0.0, 0.0]), (901, "not an address", "xx", [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, declared string, evidence array<double>")
    got = {r["page_id"]: (r["lang"], r["score"]) for r in language.fuse(frame, languages).collect()}
    want = plain_fusion(rows, languages)
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(w[1]) for i, w in want.items())


def test_pages_get_the_language_of_their_document(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = language.identify(pages, documents).collect()
    assert len(rows) == pages.count()
    right = [r["lang"] == truth[int(m[1])] for r in rows for m in [re.search(r"/(\d+)(?:[?#]|$)", r["url"])]
             if m and int(m[1]) in truth]
    assert len(right) > 100 and np.mean(right) > 0.98


def test_text_overrules_a_wrong_declaration(spark, model):
    assert model.languages == ("de", "en", "es", "fr")
    text = "der die das und nicht mit einem für auf ist im von den sich auch als dem des zu ein" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    assert int(model.evidence(data, np.array([0, len(data)])).argmax()) == 0


def test_runs_stay_inside_rows():
    data = np.frombuffer("abcdefghij".encode(), np.uint8)
    runs, limits = language.byte_runs(data, np.array([0, 3, 3, 10]))
    assert limits.tolist() == [0, 0, 0, 4] and len(runs) == 4
    assert runs[0] == language.byte_runs(data[3:7], np.array([0, 4]))[0][0]
    assert len(kernels.ALNUM) == 256


def test_odd_pages(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(1, None, None), (None, "http://h.de/", ""), (2, "::", "<html lang=de><p>x"), (2, "::", "<html lang=de><p>x")]
    pages = spark.createDataFrame([(*r, "x", "y", 0.0, 1) for r in rows], PAGES)
    got = language.identify(pages, documents).collect()
    assert len(got) == 4 and all(r["lang"] and 0 < r["score"] <= 1 for r in got)
    assert language.identify(pages.limit(0), documents).count() == 0
    none = language.identify(pages, documents.limit(0)).collect()
    assert len(none) == 4 and all(r["lang"] is None for r in none)


def test_fixed_samples(spark):
    from pyspark.sql import functions as F

    from keepsake.llm import ranks
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = [r["id"] for r in df.orderBy("h", "id").limit(100).collect()]
    assert [r["id"] for r in ranks.smallest_hashes(df, "h", 100, F.col("id")).collect()] == want
    assert ranks.smallest_hashes(df, "h", 9000).count() == 5000 and ranks.smallest_hashes(df.limit(0), "h", 9).count() == 0


def test_every_language_of_the_documents_is_kept(spark):
    names = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    rows = [(i, f"{n} {n * 3} x{n}y{n} " * 4, n) for i, n in enumerate(names)]
    rows += [(100 + i, "common words of a large language " * 3, "en") for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_text(documents, sample=100)
    assert model.languages == tuple(sorted([*names, "en"]))
    for i, text, name in rows[:70]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert model.languages[int(model.evidence(data, np.array([0, len(data)])).argmax())] == name
