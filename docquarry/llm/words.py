"""Words of whole Arrow batches as numpy arrays: byte ranges and hashes.

A word is a run of bytes other than space and 0x09-0x0D; in UTF-8 those bytes
never occur inside another character, so the ranges hold for any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WORD = np.ones(256, bool)  # all but ASCII letters, digits and bytes of other characters
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOPS = np.zeros(256, bool)
STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """Words of some documents. Word ``i`` is ``text[start[i]:end[i]]``; document ``d`` has words ``first[d]:first[d + 1]``.

    Words of one document stand one space apart in ``text``.
    """

    rows: slice
    text: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of ``column`` in runs of whole documents of about ``size`` bytes."""
    data, at = flat(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1))
        yield _split(data[at[low] : at[high]], at[low : high + 1] - at[low], slice(low, high), lower)
        low = high


def _ranges(blank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other than blank bytes, and the first run of each document."""
    inside = ~blank
    opens = np.zeros(len(blank), bool)
    opens[at[:-1][at[:-1] < len(blank)]] = True
    after = np.ones(len(blank), bool)
    after[1:] = blank[:-1]
    start = np.flatnonzero(inside & (after | opens))
    closes = np.ones(len(blank), bool)
    closes[:-1] = blank[1:] | opens[1:]
    return start, np.flatnonzero(inside & closes) + 1, np.searchsorted(start, at)


def _split(data: np.ndarray, at: np.ndarray, rows: slice, lower: bool) -> Words:
    blank = BLANK[data]
    start, end, first = _ranges(blank, at)
    data = np.where(blank, np.uint8(32), LOWER[data] if lower else data)
    size = end - start
    gap = np.diff(start) - size[:-1]
    inner = np.ones(len(gap), bool)
    borders = first[1:-1] - 1
    inner[borders[(borders >= 0) & (borders < len(gap))]] = False
    if (gap[inner] != 1).any():
        keep = ~blank
        keep[np.minimum(end, len(data) - 1)] = True
        data = data[keep]
        moved = np.cumsum(keep) - keep
        start = moved[start]
        end = start + size
    return Words(rows, data.tobytes(), start, end, first)


def sentence_words(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[Words, np.ndarray]]:
    """Lower-cased runs of letters and digits, and the number of the sentence of each; sentences end at ``.!?`` and line ends."""
    data, at = flat(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1))
        own, bounds = data[at[low] : at[high]], at[low : high + 1] - at[low]
        start, end, first = _ranges(NOT_WORD[own], bounds)
        ends = STOPS[own].astype(np.int64)
        ends[bounds[:-1][bounds[:-1] < len(own)]] += 1  # a document opens a sentence
        sentence = np.cumsum(ends)[start] if len(own) else np.zeros(0, np.int64)
        yield Words(slice(low, high), LOWER[own].tobytes(), start, end, first), sentence
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE_BYTES)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def hashes(words: Words, stem: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, or of its first ``stem`` bytes."""
    data = np.frombuffer(words.text, np.uint8)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    end = words.end if stem is None else np.minimum(words.end, words.start + stem)
    own = (sums[end] - sums[words.start]) * down[words.start]
    kind = 0 if stem is None else stem
    return mix(own + (end - words.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind))


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word; runs may cross documents."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    out = word_hashes[: len(word_hashes) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(BASE)
        out += word_hashes[j : len(word_hashes) - n + 1 + j]
    return mix(out)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Marks the words from which a run of ``n`` words stays in its document."""
    total = int(first[-1])
    marks = np.zeros(total + 1, np.int64)
    lows, highs = first[:-1], np.maximum(first[:-1], first[1:] - n + 1)
    np.add.at(marks, lows, 1)
    np.add.at(marks, highs, -1)
    return np.cumsum(marks)[:total] > 0


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
