"""Word shingles of texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .flat import FOLD, bounds, mix, span_hashes, text_slices, words

WORDS = 5


def shingle_sets(column, size: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, hashes, offsets) by slices: the distinct shingles of each text, ascending.

    A-Z are lower-cased; words are runs without white space. Fewer words than
    `size` make one shingle of the whole sequence; no words make none.
    """
    for lo, hi, data, offsets in text_slices(column):
        data = FOLD[data]
        starts, ends, at = words(data, offsets)
        n = np.diff(at)
        h = span_hashes(data, starts, ends)
        shingles = np.maximum(n - size + 1, np.minimum(n, 1))
        first = np.repeat(at[:-1], shingles) + np.arange(int(shingles.sum())) - np.repeat(bounds(shingles)[:-1], shingles)
        length = np.repeat(np.minimum(n, size), shingles)
        value = np.zeros(len(first), np.uint64)
        for k in range(size):
            here = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else np.zeros(0, np.uint64)
            value = np.where(k < length, mix(value * np.uint64(0x9E3779B97F4A7C15) + here + np.uint64(k + 1)), value)
        row = np.repeat(np.arange(len(n)), shingles)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, value[keep], bounds(np.bincount(row[keep], minlength=len(n)))
