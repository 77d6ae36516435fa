"""Simple-8b word-aligned integer coding, vectorised.

A 64-bit word holds a selector in its 4 high bits and as many integers of one width as fit into the other 60, the
first in the lowest bits. Selectors 1 to 15 hold 60 x 1, 30 x 2, 20 x 3, 15 x 4, 12 x 5, 10 x 6, 8 x 7, 7 x 8, 6 x 10,
5 x 12, 4 x 15, 3 x 20, 2 x 30, 1 x 60 bits, and 120 zeros. Selector 0 is an escape: the word names a place in a list
of whole 64-bit integers. The last word of a block may hold zeros past the end; the reader knows the block's length.
"""

from __future__ import annotations

import numpy as np

from metricloom.llm.textarrays import U

#: Fixed values of the format: integers and bits of each selector, best first.
SELECTORS = ((15, 120, 0), (1, 60, 1), (2, 30, 2), (3, 20, 3), (4, 15, 4), (5, 12, 5), (6, 10, 6), (7, 8, 7), (8, 7, 8), (9, 6, 10), (10, 5, 12), (11, 4, 15), (12, 3, 20), (13, 2, 30), (14, 1, 60))
ESCAPE = 0


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped integers of unsigned 64-bit ``values``. Greedy: each word takes as many as fit."""
    values = np.asarray(values, U)
    n = len(values)
    if not n:
        return np.zeros(0, U), np.zeros(0, U)
    best = np.zeros(n, np.uint8)                        # the selector of a word that starts here; none fits: escape
    for selector, count, bits in reversed(SELECTORS):
        fits = values < (U(1) << U(bits))
        width = 1
        while width < count:                            # all of the next ``count`` fit; nothing after the end can't
            step = min(width, count - width)
            if step < n:
                fits[:-step] &= fits[step:]
            width += step
            if not fits.any():
                break
        best[fits] = selector
    size = np.ones(16, np.int64)
    for selector, count, _ in SELECTORS:
        size[selector] = count
    step, chosen, at = size[best].astype(np.uint8).tobytes(), [], 0
    while at < n:
        chosen.append(at)
        at += step[at]
    at = np.array(chosen)
    kind = best[at]
    words = kind.astype(U) << U(60)
    padded = np.concatenate((values, np.zeros(128, U)))
    for selector, count, bits in SELECTORS:
        here = np.flatnonzero(kind == selector)
        if bits and len(here):
            own = words[here]
            for k in range(count):
                own |= padded[at[here] + k] << U(bits * k)
            words[here] = own
    escaped = np.flatnonzero(kind == ESCAPE)
    words[escaped] = np.arange(len(escaped), dtype=U)
    return words, values[at[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` integers of a block."""
    kind = (words >> U(60)).astype(np.int64)
    size = np.ones(16, np.int64)
    for selector, count, _ in SELECTORS:
        size[selector] = count
    ends = np.cumsum(size[kind]) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(max(n, int(ends[-1]) if len(ends) else 0), U)
    begins = ends - size[kind]
    for selector, count, bits in SELECTORS:
        here = np.flatnonzero(kind == selector)
        if bits and len(here):
            mask = (U(1) << U(bits)) - U(1)
            for k in range(count):
                out[begins[here] + k] = (words[here] >> U(bits * k)) & mask
    escaped = np.flatnonzero(kind == ESCAPE)
    out[begins[escaped]] = escapes[(words[escaped] & U((1 << 60) - 1)).astype(np.int64)]
    return out[:n]
