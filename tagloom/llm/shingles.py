"""Word shingle sets of documents as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64, pieces, span_hashes, translated, word_spans, words_table

WORDS = words_table("visible")
_STEP = np.uint64(0x9FB21C651E98DF25)
_WHOLE = np.uint64(0xA24BAED4963EE407)


def _fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive numbers."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = mix64((out ^ hashes[i:i + len(out)]) * _STEP + np.uint64(i + 1))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its ``n`` consecutive words; of all words if there are fewer."""
    for a, b in pieces(offsets, step):
        part = translated(data[offsets[a]:offsets[b]], WORDS)
        starts, ends, rows = word_spans(part, offsets[a:b + 1] - offsets[a])
        hashes = span_hashes(part, starts, ends, step)
        folded = _fold(hashes, n)
        first = np.searchsorted(rows, np.arange(b - a + 1))
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            if high - low >= n:
                yield np.unique(folded[low:high - n + 1])
            elif high > low:
                whole = np.uint64(high - low)
                for h in hashes[low:high]:
                    whole = mix64(np.array([(whole ^ h)]) * _WHOLE)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
