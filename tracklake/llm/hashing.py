"""Words of a batch of texts as 64-bit hashes, computed on arrays.

A batch is worked on in runs of whole texts of about ``RUN_BYTES``, so memory does not
follow the batch.  Hashes depend on the bytes of a word alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
# fixed value: the white space of the word rule
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept and grown as needed."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(n, 4096, 2 * (0 if known is None else len(known)))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        known = _POWERS[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return known


_POWERS: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (constants of a published 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums_of_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of ``values`` that begins at ``starts``, order included."""
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return np.add.reduceat(values * powers(int(place.max()) + 1)[place], starts)


@dataclass(slots=True)
class Words:
    """Words of some whole texts: place in the bytes, text they belong to, hash."""

    data: np.ndarray  # bytes of the texts of this run
    text_end: np.ndarray  # where each text ends
    first_text: int  # number of the run's first text in the batch
    texts: int
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # word numbers at which each text begins, and the number of words
    hash: np.ndarray


def words_of(column: pa.Array, lower: bool) -> Iterator[Words]:
    """Runs of whole texts of a string column; null texts count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        yield _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, lower)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first_text: int, lower: bool) -> Words:
    none = np.zeros(0, dtype=np.int64)
    ink = ~_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = ink[edges]  # a text begins a word even where no white space stands before it
    start = np.flatnonzero(begins)
    if not len(start):
        return Words(data, offsets[1:], first_text, len(offsets) - 1, none, none, np.zeros(len(offsets), dtype=np.int64), none.astype(np.uint64))
    gap = np.flatnonzero(~ink | begins)  # every place where a word may end: white space or the next word
    nxt = np.searchsorted(gap, start, side="right")
    end = np.where(nxt < len(gap), gap[np.minimum(nxt, len(gap) - 1)], len(data))
    shown = _LOWER[data] if lower else data
    inside = np.arange(len(data)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
    value = (shown.astype(np.uint64) + np.uint64(1)) * powers(int((end - start).max()) + 1)[np.minimum(inside, int((end - start).max()))]
    value[~ink] = 0
    total = np.add.reduceat(value, start)
    return Words(data, offsets[1:], first_text, len(offsets) - 1, start, end, np.searchsorted(start, offsets), mixed(total + _BASE * (end - start).astype(np.uint64)))


def distinct_shingles(words: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct hashes of its runs of ``n`` words); with fewer words the whole sequence is one, without words none."""
    h, k = words.hash, powers(n + 1)
    runs = max(len(h) - n + 1, 0)
    rolled = np.zeros(runs, dtype=np.uint64)
    for i in range(n):
        rolled += h[i : i + runs] * k[n - i]
    rolled = mixed(rolled + np.uint64(n))
    for t in range(words.texts):
        a, b = int(words.bounds[t]), int(words.bounds[t + 1])
        if b - a >= n:
            yield words.first_text + t, np.unique(rolled[a : b - n + 1])
        elif b > a:
            own = sum((int(x) * int(k[b - a - i]) for i, x in enumerate(h[a:b])), b - a) & ((1 << 64) - 1)
            yield words.first_text + t, mixed(np.array([own], dtype=np.uint64))
        else:
            yield words.first_text + t, np.zeros(0, dtype=np.uint64)
