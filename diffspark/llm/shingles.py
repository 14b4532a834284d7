"""Distinct word shingles of documents as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from diffspark.llm import textbatch as tb


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ascending distinct hashes)`` of every text.

    A-Z is lower-cased.  With fewer than ``size`` words, the whole sequence is the one shingle; without words the set is empty.
    """
    for first, last, data, offsets in tb.pieces(texts):
        data = tb.lowered(data)
        starts, ends, owner = tb.spans(data, offsets)
        words = tb.hashes(data, starts, ends)
        count = np.bincount(owner, minlength=last - first)
        at, value = tb.windows(words, owner, size)
        begin = np.searchsorted(owner[at], np.arange(last - first + 1))
        word_at = np.concatenate([[0], np.cumsum(count)])
        for i in range(last - first):
            if count[i] >= size:
                yield first + i, np.unique(value[begin[i] : begin[i + 1]])
            elif count[i]:
                some = words[word_at[i] : word_at[i + 1]]
                yield first + i, tb.windows(some + np.uint64(count[i]), np.zeros(len(some), int), len(some))[1]
            else:
                yield first + i, np.zeros(0, np.uint64)
