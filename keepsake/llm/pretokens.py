"""Pre-tokens of byte-level BPE vocabularies, split and looked up with array arithmetic.

A byte-level BPE never merges across pre-tokens, so a text's ids are the ids of its pre-tokens in a row. The split of
``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+`` only depends on runs of four character classes; it is found
for a whole slice at once. The vocabulary strings that encode alone as one token are proved once on the driver (encode
each of them and see) and shipped as hashes: such a pre-token needs no merging. Every other distinct pre-token goes
through the library once and is remembered in a table of bounded size, which is emptied when full.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from keepsake.llm import kernels as K

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: fixed values: contractions of the split pattern
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs; its size depends on the vocabulary file alone."""

    definition: str
    fast: bool
    classes: np.ndarray
    specials: tuple[tuple[bytes, int], ...]
    whole_hash: np.ndarray
    whole_id: np.ndarray


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


def _classes() -> np.ndarray:
    """Class of every code point, as the library's own pattern engine sees it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # letters and numbers are only assigned in planes 0 to 3; what lies beyond is unassigned, private or a mark
    points = np.array([p for p in range(0x40000) if not 0xD800 <= p < 0xE000], np.int64)
    text = "".join(map(chr, points.tolist()))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        outside = np.zeros(len(text), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            outside[a:b] = True
        table[points[~outside]] = kind
    return table


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file on the driver and prove its whole tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        definition = f.read()
    spec = json.loads(definition)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    fast = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
    none = np.zeros(0, np.uint64)
    if not fast:
        return Vocabulary(definition, False, np.zeros(0, np.uint8), (), none, none.astype(np.int64))
    tokenizer, alphabet, texts = Tokenizer.from_str(definition), _byte_alphabet(), []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(alphabet[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue            # not a text of its own
    split = tokenizer.pre_tokenizer
    alone = [(t, e.ids[0]) for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))
             if len(e.ids) == 1 and len(split.pre_tokenize_str(t)) == 1]
    raw = [t.encode() for t, _ in alone]
    end = np.cumsum([len(r) for r in raw])
    hashes = K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, end[:-1]], end)
    return Vocabulary(definition, True, _classes(), tuple((t["content"].encode(), t["id"]) for t in added),
                      hashes, np.array([i for _, i in alone], np.int64))


def _byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[:256][data].copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data.astype(np.int64)
        width = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        last = len(data) - 1
        at = [b[np.minimum(lead + i, last)] & 0x3F for i in range(4)]
        point = np.where(width == 2, (b[lead] & 0x1F) << 6 | at[1],
                         np.where(width == 3, (b[lead] & 0x0F) << 12 | at[1] << 6 | at[2],
                                  (b[lead] & 0x07) << 18 | at[1] << 12 | at[2] << 6 | at[3]))
        kind = table[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            wide = width > i
            out[np.minimum(lead[wide] + i, last)] = kind[wide]
    return out


def split(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary):
    """Start of every pre-token, the first pre-token of each row (n+1 values), and (position, id) of special ones."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(offsets), np.int64), (none, none)
    kinds = _byte_classes(data, vocabulary.classes)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    special_at, special_id = _mark_specials(data, offsets, vocabulary.specials, kinds, edge)

    token = np.empty(size + 1, bool)
    token[0] = token[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=token[1:-1])
    token |= edge
    begin = np.flatnonzero(token[:-1])
    end = np.r_[begin[1:], size]
    kind = kinds[begin]

    # white space before a word: its last character leaves the run; a plain space joins the word
    inner = (kind == SPACE) & ~edge[end]
    a, b = begin[inner], end[inner]
    plain = data[b - 1] == 0x20
    token[b[plain]] = False
    token[b[plain] - 1] = True
    last = b[~plain] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    token[last] = True

    # a lone apostrophe that starts a token takes the suffix of a contraction from the letters behind it
    quote = (kind == OTHER) & (end - begin == 1) & (data[begin] == 0x27) & token[begin] & ~edge[end]
    where = np.flatnonzero(quote)
    where = where[where + 1 < len(begin)]
    where = where[kind[where + 1] == LETTER]
    if len(where):
        letters, stop = begin[where + 1], end[where + 1]
        taken = np.zeros(len(where), np.int64)
        for suffix in SUFFIXES:
            fits = (taken == 0) & (stop - letters >= len(suffix))
            for i, c in enumerate(suffix):
                fits &= data[np.minimum(letters + i, size - 1)] == c
            taken[fits] = len(suffix)
        hit = taken > 0
        token[letters[hit]] = False
        token[letters[hit] + taken[hit]] = True
    start = np.flatnonzero(token[:-1])
    return start, np.searchsorted(start, offsets), (np.searchsorted(start, special_at), special_id)


def _mark_specials(data, offsets, specials, kinds, edge):
    """Special strings (leftmost first) become tokens of their own and part the text on both sides."""
    found: list[tuple[int, int, int]] = []
    if specials:
        raw = data.tobytes()
        for content, number in specials:
            at = raw.find(content)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right"))
                if at + len(content) <= offsets[row]:
                    found.append((at, -len(content), number))
                at = raw.find(content, at + 1)
    reach, kept = 0, []
    for at, minus, number in sorted(found):
        if at >= reach:
            reach = at - minus
            kinds[at:reach] = SPECIAL
            edge[at] = edge[reach] = True
            kept.append((at, number))
    return (np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64))


class Memory:
    """Ids of distinct pre-tokens, found by hash in an open table; bounded, emptied when full."""

    BITS = 21
    PROBES = 12

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_str(vocabulary.definition)
        self.reset()

    def reset(self) -> None:
        size = 1 << self.BITS
        self.keys = np.zeros(size, np.uint64)
        self.values = np.zeros(size, np.int32)
        self.used = 0
        self.count = np.zeros(1 << 17, np.int64)
        self.place = np.zeros(1 << 17, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n_ids = self.n = 0
        v = self.vocabulary
        self._insert(v.whole_hash, self._store(np.ones(len(v.whole_hash), np.int64), v.whole_id))

    def _store(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n, m = self.n + len(counts), self.n_ids + len(ids)
        while n > len(self.count):
            self.count, self.place = np.r_[self.count, self.count], np.r_[self.place, self.place]
        while m > len(self.ids):
            self.ids = np.r_[self.ids, self.ids]
        self.count[self.n:n] = counts
        self.place[self.n:n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids:m] = ids
        number = np.arange(self.n, n)
        self.n, self.n_ids = n, m
        return number

    def _slot(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes >> np.uint64(64 - self.BITS)) + np.uint64(probe)).astype(np.int64) & ((1 << self.BITS) - 1)

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        for probe in range(self.PROBES):
            slot = self._slot(hashes, probe)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            won = free & (self.keys[slot] == hashes)
            self.values[slot[won]] = numbers[won]
            hashes, numbers = hashes[~won], numbers[~won]
            self.used += int(won.sum())
            if not len(hashes):
                return

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, special) -> np.ndarray:
        """The stored number of each pre-token; unknown ones are merged by the library and stored."""
        if self.used > 0.6 * (1 << self.BITS) or self.n_ids > 1 << 24:
            self.reset()
        hashes = K.span_hashes(data, start, end)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for probe in range(self.PROBES):
            h = hashes[left]
            slot = self._slot(h, probe)
            key = self.keys[slot]
            hit = key == h
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (key != 0)]
            if not len(left):
                break
        at, ids = special
        if len(at):
            out[at] = self._store(np.ones(len(ids), np.int64), ids)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            texts = [raw[start[i]:end[i]].decode() for i in miss[first]]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            numbers = self._store(np.array([len(c) for c in coded], np.int64),
                                  np.fromiter((i for c in coded for i in c), np.uint32))
            self._insert(new, numbers)
            out[miss] = numbers[back]
        return out


_MEMORIES: dict[int, Memory] = {}


def memory_for(vocabulary: Vocabulary) -> Memory:
    """One memory for each vocabulary and worker process."""
    key = hash(vocabulary.definition)
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Memory(vocabulary)
    return _MEMORIES[key]


def row_counts(data: np.ndarray, offsets: np.ndarray, memory: Memory) -> np.ndarray:
    """Number of tokens of each row."""
    start, first, special = split(data, offsets, memory.vocabulary)
    numbers = memory.numbers(data, start, np.r_[start[1:], len(data)], special)
    total = np.r_[0, np.cumsum(memory.count[numbers])]
    return total[first[1:]] - total[first[:-1]]


def row_ids(data: np.ndarray, offsets: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in a row, and n+1 row offsets into them."""
    start, first, special = split(data, offsets, memory.vocabulary)
    numbers = memory.numbers(data, start, np.r_[start[1:], len(data)], special)
    count = memory.count[numbers]
    total = np.r_[0, np.cumsum(count)]
    at = np.repeat(memory.place[numbers] - total[:-1], count) + np.arange(total[-1])
    return memory.ids[at], total[first]
