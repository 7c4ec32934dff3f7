"""Distinct word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm import kernel


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each document.

    A-Z are lower-cased; a text with fewer than `width` words has its whole sequence as
    the one shingle; a text without words, or null, has none.
    """
    for first, last, data, offsets in kernel.slices(column):
        data = kernel.LOWER[data]
        starts, ends, word_of = kernel.runs(~kernel.IS_SPACE[data], offsets)
        words = kernel.span_hashes(kernel.prefix_sums(data), starts, ends)
        made, of = kernel.windows(words, word_of, width)
        for k in range(last - first):
            n = word_of[k + 1] - word_of[k]
            if n >= width:
                yield first + k, np.unique(made[of[k] : of[k + 1]])
            elif n:
                yield first + k, kernel.windows(words[word_of[k] : word_of[k + 1]], np.array([0, n]), int(n))[0]
            else:
                yield first + k, np.zeros(0, np.uint64)
