"""Plain versions of the operators, text by text, to compare with."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def solid(text):
    return SOLID.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def without_repeats(docs, width=13):
    """{doc_id: (n_words, n_removed, kept text)} of {doc_id: text}."""
    split = {i: solid(t) for i, t in docs.items()}
    least = {}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            least.setdefault(tuple(split[i][k:k + width]), i)
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - width + 1) if least[tuple(w[k:k + width])] < i for j in range(width)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def contamination(text, items, width=13):
    """(n_words, n_hit, items) of a text for {item_id: text}."""
    w, hit, found = words(text), set(), set()
    for item, t in items.items():
        p = words(t)
        n = min(width, len(p))
        if not n:
            continue
        windows = {tuple(p[k:k + n]) for k in range(len(p) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingle_similarity(a, b, width=5):
    one = collections.Counter(tuple(a[k:k + width]) for k in range(len(a) - width + 1))
    two = collections.Counter(tuple(b[k:k + width]) for k in range(len(b) - width + 1))
    common = sum((one & two).values())
    return common / (sum(one.values()) + sum(two.values()) - common)


def phrase_places(text, phrases):
    w = words(text)
    places = [(k, label) for phrase, label in phrases for p in [phrase.split()]
              for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
    return w, places
