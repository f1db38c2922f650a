"""Content-defined anchors: equal strings of a fixed length have equal anchors at equal places."""

from __future__ import annotations

import numpy as np

from .common import _BASE, _BYTE_CODES, _INVERSE, _powers, mix64

#: Positions are told apart within a piece by this many low bits of the sort key.
PLACE_BITS = 20


class Anchors:
    """For strings of ``length`` bytes: the anchor is the leftmost ``gram``-byte substring of smallest hash in it."""

    def __init__(self, length: int, gram: int):
        if not 0 < gram <= length:
            raise ValueError("a gram must fit in the string")
        self.length, self.gram, self.reach = length, gram, length - gram + 1

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram at every position."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * _powers(_BASE, 1 << PLACE_BITS)[:n], out=sums[1:])
        found = sums[self.gram:] - sums[:n + 1 - self.gram]
        found *= _powers(_INVERSE, 1 << PLACE_BITS)[:len(found)]
        return mix64(found)

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor position, first and last start of the strings it serves, gram hash), in order.

        ``data`` is a piece of a document, shorter than 2 ** PLACE_BITS bytes.
        """
        if len(data) < self.length:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        hashes = self.hashes(data)
        low = np.uint64((1 << PLACE_BITS) - 1)
        best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= self.reach:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        rest = self.reach - width
        if rest:
            best = np.minimum(best[:-rest], best[rest:])
        change = np.flatnonzero(best[1:] != best[:-1])
        first, last = np.concatenate(([0], change + 1)), np.concatenate((change, [len(best) - 1]))
        at = (best[first] & low).astype(np.int64)
        return at, first, last, hashes[at]

    def contexts(self, data: np.ndarray) -> np.ndarray:
        """All runs of a document as rows of (gram hash, hash of the run's bytes, anchor, first start, last start)."""
        step = (1 << PLACE_BITS) - 2 * self.length
        found = []
        for begin in range(0, max(1, len(data) - self.length + 1), step):
            piece = data[begin:begin + step + self.length - 1]
            at, first, last, grams = self.runs(piece)
            if not len(at):
                continue
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[piece] * _powers(_BASE, 1 << PLACE_BITS)[:len(piece)], out=sums[1:])
            end = last + self.length
            whole = mix64((sums[end] - sums[first]) * _powers(_INVERSE, 1 << PLACE_BITS)[first] + (end - first).astype(np.uint64))
            places = [(x + begin).astype(np.uint64) for x in (at, first, last)]
            found.append(np.stack((grams, whole, *places), 1))
        return np.concatenate(found) if found else np.zeros((0, 5), np.uint64)
