"""Vectorised text kernels shared by the operators of this folder.

All of them work on one bounded slice of an Arrow batch at a time: the texts of the slice as one byte array plus
row offsets. Words, hashes of byte spans and hashes of word n-grams come from array arithmetic, so a task's memory
follows ``SLICE_BYTES`` (or its longest single text), not the size of the table.

Hashes are polynomial hashes modulo 2**64 over random byte values, finished with a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xBF58476D1CE4E5B9 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def member_table(excluded: str | bytes | Iterable[int]) -> np.ndarray:
    """True for each byte that belongs to a word; bytes from 0x80 on always do."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


LOWER = ascii_lower_table()
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = member_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: words ``[^\x20\x09-\x0D]+``
NONSPACE = member_table([0x20, *range(0x09, 0x0E)])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes (a longer text stands alone)."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(column))[1][1:]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


@dataclass
class Words:
    """Word spans of a slice: byte starts and ends, and the first word of each row (n+1 values)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = np.empty(size + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.take(member, data, out=inside[1:-1])
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    end = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    return Words(start, end, np.searchsorted(start, offsets))


_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 2 + 1))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_byte_values(seed)[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (row limits are the caller's)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size].copy()
    for i in range(1, n):
        out *= BASE
        out += words[i:i + size]
    return mix(out + np.uint64(n))


def gram_mask(first: np.ndarray, n: int) -> np.ndarray:
    """True at each word position whose run of ``n`` words stays inside its row (length: all words - n + 1)."""
    size = int(first[-1]) - n + 1
    if size <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first))[:size] - np.arange(size)
    return left >= n


def run_mask(length: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """True at every position covered by one of the runs ``[start, start + width)``."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + width, length), 1)
    return np.cumsum(edge[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
