"""Sorted runs of byte strings: front coding, and a multiway merge that never compares a known common prefix again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix with the row before, and the remaining bytes of all rows; rows are sorted and of one width."""
    n, width = rows.shape
    lcps = np.zeros(n, np.uint16)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcps[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return lcps, rows[np.arange(width) >= lcps[:, None]]


def decode(lcps: np.ndarray, tails: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the string before, string) for every string of a run."""
    last, at = b"", 0
    for lcp in lcps.tolist():
        end = at + width - lcp
        last = last[:lcp] + tails[at:end]
        at = end
        yield lcp, last


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings of one width that agree up to ``start``."""
    x = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
    return len(a) - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of strings of one width.

    Every loser keeps the length of the prefix it shares with the string that beat it. Two players with different
    lengths are ordered by these alone; only with equal lengths are their bytes looked at, from that place on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.strings: list[bytes | None] = [None] * self.size
        self.nodes: list[tuple[int, int]] = [(0, -1)] * self.size  # (run, shared prefix) of the loser; -1: run at its end
        self.winner = self._build(1)

    def _pull(self, run: int) -> tuple[int, int]:
        lcp, self.strings[run] = next(self.runs[run], (-1, None)) if run < len(self.runs) else (-1, None)
        return run, lcp

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            run, lcp = self._pull(node - self.size)
            return run, min(lcp, 0)
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        if a[1] == b[1] and a[1] >= 0:
            x, y = self.strings[a[0]], self.strings[b[0]]
            lcp = common_prefix(x, y, a[1])
            if lcp == len(x) or x[lcp] < y[lcp]:
                self.nodes[node] = b[0], lcp
                return a
            self.nodes[node] = a[0], lcp
            return b
        if a[1] >= b[1]:
            self.nodes[node] = b
            return a
        self.nodes[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(common prefix with the string before, run, string) in order."""
        while self.winner[1] >= 0:
            run, lcp = self.winner
            yield lcp, run, self.strings[run]
            player, node = self._pull(run), (run + self.size) // 2
            while node:
                other = self.nodes[node]
                if player[1] > other[1]:
                    pass
                elif player[1] < other[1]:
                    self.nodes[node], player = player, other
                else:
                    player = self._play(node, player, other)
                node //= 2
            self.winner = player
