"""Double-array tries over sequences of dense ids.

A state s with base b has the child of code c at slot b + c, which is its own only if CHECK there names s. Codes are dealt level
by level in the order in which edges first appear, so the children of a state stand close together and fill the array
densely. Sequences are added, and walked, one level at a time for all of them.
"""

from __future__ import annotations

import numpy as np

ROOT, FREE = 0, -1


class DoubleArray:
    """BASE and CHECK arrays of the trie of given sequences.

    ``symbols`` holds all sequences one after another as whole numbers from 0 to ``n_symbols`` - 1; sequence i stands at
    ``offsets[i]:offsets[i + 1]``. ``paths`` holds the state that each of the symbols leads to.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, n_symbols: int):
        self.codes = np.full(n_symbols, -1, np.int64)
        self.base, self.check = np.zeros(16, np.int64), np.full(16, FREE, np.int64)
        self.check[ROOT] = ROOT
        self.depth, self.n_codes, self._low, self._top = np.zeros(16, np.int64), 0, 1, 1
        lengths = np.diff(offsets)
        state = np.full(len(lengths), ROOT, np.int64)
        self.paths = np.zeros(len(symbols), np.int64)
        alive, level = np.flatnonzero(lengths > 0), 0
        while len(alive):
            at = offsets[alive] + level
            level += 1
            self._add(state[alive], symbols[at], level)
            state[alive] = self.step(state[alive], symbols[at])
            self.paths[at] = state[alive]
            alive = alive[lengths[alive] > level]

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol each, -1 where there is none."""
        code = self.codes[symbols]
        slot = self.base[state] + code
        known = (state >= 0) & (code >= 0) & (slot > 0) & (slot < len(self.check))
        slot = np.where(known, slot, 0)
        return np.where(known & (self.check[slot] == state), slot, -1)

    def states(self) -> np.ndarray:
        """All states, in the order of their slots."""
        return np.flatnonzero(self.check != FREE)

    def _add(self, state: np.ndarray, symbols: np.ndarray, level: int) -> None:
        pairs = np.unique(np.stack([state, symbols]), axis=1)
        new = pairs[1][self.codes[pairs[1]] < 0]
        if len(new):
            _, first = np.unique(new, return_index=True)
            fresh = new[np.sort(first)]
            self.codes[fresh] = self.n_codes + np.arange(len(fresh))
            self.n_codes += len(fresh)
        code = self.codes[pairs[1]]
        order = np.lexsort((code, pairs[0]))
        parents, code = pairs[0][order], code[order]
        cuts = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            base = self._place(code[a:b])
            self.base[parents[a]] = base
            slots = base + code[a:b]
            self.check[slots], self.depth[slots] = parents[a], level
            self._top = max(self._top, int(slots[-1]) + 1)

    def _place(self, code: np.ndarray, tries: int = 32) -> int:
        """A base at which all the codes fall on free slots: one of the first free slots, or behind all that is used."""
        low, slot = int(code[0]), self._low
        self._reserve(self._top + int(code[-1]) - low + 2)
        check = self.check
        while check[slot] != FREE:
            slot += 1
        self._low = slot
        for _ in range(tries):
            if slot >= self._top:
                break
            self._reserve(slot + int(code[-1]) - low + 1)
            if (self.check[slot - low + code] == FREE).all():
                return slot - low
            slot += 1
            while slot < self._top and self.check[slot] != FREE:
                slot += 1
        return self._top - low

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.depth = np.concatenate((self.depth, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, FREE, np.int64)))


def subtree_sums(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums over the subtree of every node, itself included; ``parent`` holds indices, -1 for none."""
    out = [v.copy() for v in values]
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, cuts):
        rows = rows[parent[rows] >= 0]
        for v in out:
            np.add.at(v, parent[rows], v[rows])
    return out
