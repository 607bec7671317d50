"""Vectorised words: 64-bit codes of all words of a batch of texts, in numpy.

Texts stay UTF-8 bytes. Separators are given as ASCII bytes, so every byte of a longer
character belongs to a word and byte-wise splitting equals splitting by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
BLOCK = 1 << 19  # bytes that are coded at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """Maps A-Z to a-z and separators to 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: Separators of words made of digits, letters and everything past ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Separators of words between white space; other bytes move up by one, so a NUL is part of a word
#: (0xFF, which would move to 0, is in no UTF-8 text).
SPACE = np.where(byte_table(bytes([0x20, *range(0x09, 0x0E)])) == 0, 0, byte_table(b"") + np.uint8(1))
SPACE[0] = 1
#: The same without lower-casing.
BLANKS = np.where(SPACE == 0, 0, np.arange(256, dtype=np.uint8) + np.uint8(1))


def text_parts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's start, with the end as last; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = pc.cast(column, pa.large_binary())
    if raw.null_count:
        raw = pc.fill_null(raw, b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, at


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts and (exclusive) ends of all words, where ``inside`` says which bytes are in one."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begin[firsts] = inside[firsts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    finals = at[1:][at[:-1] < at[1:]] - 1
    last[finals] = inside[finals]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def word_codes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the words from ``starts`` to ``ends``, which are in order and apart."""
    codes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # blocks that end with a word; a longer word gets its own powers
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:
            j = i + 1
            up, down = _powers(_BASE, int(ends[i] - base)), _DOWN
        else:
            up, down = _UP, _DOWN
        part = low[base : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        codes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return codes


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, starts and ends of all words, and for each text the number of words before it.

    ``ends`` are exclusive; ``starts`` and ``ends`` are offsets in ``data``.
    """
    low = table[data]
    starts, ends = spans(low != 0, at)
    return word_codes(low, starts, ends), starts, ends, np.searchsorted(starts, at)
