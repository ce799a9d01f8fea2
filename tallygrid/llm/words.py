"""Word hashes of whole texts on Arrow buffers, shared by the operators on word shingles.

A word is a maximal run of bytes other than the six ASCII white-space bytes; A-Z are lower-cased.
A word's hash is a 64-bit polynomial over its bytes, mixed; no word is built as a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {}


def powers(base: np.uint64, size: int) -> np.ndarray:
    """base ** (0 .. size-1) modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held) < size:
        held = np.full(max(size, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[int(base)] = held
    return held[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    marks = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[marks[0]:marks[-1]], marks - marks[0]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes at most (a longer text is a run of its own): first, last, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, marks = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(marks, marks[lo] + limit, side="right")) - 1)
        yield lo, hi, data[marks[lo]:marks[hi]], marks[lo:hi + 1] - marks[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one more entry at the end).

    ``inside`` marks the bytes that words are made of; by default all but white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13)) if inside is None else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20,
                kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and each text's first word. ``kinds`` says of each byte value whether it is in words."""
    data = lowered(data)
    starts, ends, firsts = word_spans(data, offsets, None if kinds is None else kinds[data])
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        base = starts[lo]
        span = int(ends[hi - 1] - base)
        sums = np.empty(span + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[base:base + span].astype(np.uint64) + np.uint64(1)) * powers(BASE, span), out=sums[1:])
        first = starts[lo:hi] - base
        out[lo:hi] = (sums[ends[lo:hi] - base] - sums[first]) * powers(INVERSE, span)[first]
        lo = hi
    return mix(out), starts, ends, firsts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words of one text; a shorter text is one shingle, no words give none."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    h = np.full(count, width, np.uint64)
    for i in range(width):
        h = mix(h * BASE + words[i:i + count])
    return h
