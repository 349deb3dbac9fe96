"""Recompression: a run-length grammar of sequences, and longest common extensions on it.

Levels alternate: in a block level each run of one symbol becomes one symbol, in a pair level symbols are dealt to
a left and a right side and each left symbol with a right one after it becomes one symbol. Equal pieces of the
sequence get equal symbols but for those at their edges, so an extension climbs while both places begin a symbol of
the next level and the symbols are equal, and goes down again where they differ: a few steps a level, for any number
of queries at once.

Sequences are laid side by side; an end mark, which is like no other symbol, follows each and is never joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .shingles import mix


class Level:
    """Symbols of one level, and the way to the next: for each symbol its group there; for each group its first and last symbol here."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols

    def grouped(self, begins: np.ndarray, blocks: bool) -> None:
        """begins: whether a symbol begins a group; blocks: groups are runs of one symbol, else pairs."""
        self.blocks = blocks
        self.up = np.cumsum(begins, dtype=np.int32) - np.int32(1)
        self.first = np.flatnonzero(begins).astype(np.int32)
        self.last = np.r_[self.first[1:], np.int32(len(begins))].astype(np.int32) - np.int32(1)


class Grammar:
    """The levels above symbols, numbers from 0; ends: the places of the end marks, of which the first is place 0."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        kinds = int(symbols.max(initial=0)) + 1
        symbols = symbols.astype(np.int64)
        symbols[ends] = np.arange(kinds, kinds + len(ends))
        self.names = kinds + len(ends)
        closed = np.zeros(len(symbols), bool)
        closed[ends] = True
        self.levels = [Level(symbols)]
        step = 0
        while len(symbols) > 2 * len(ends):  # some sequence has more than one symbol
            for pairs in (False, True):
                level = self.levels[-1]
                symbols, closed = self._pairs(level, closed, step) if pairs else self._blocks(level, closed)
                self.levels.append(Level(symbols))
            step += 1

    def _named(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A new symbol for each different (a, b)."""
        codes, kinds = pd.factorize(a * (b.max() + 1) + b)
        codes = codes.astype(np.int64) + self.names
        self.names += len(kinds)
        return codes

    def _blocks(self, level: Level, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = level.symbols
        level.grouped(np.r_[True, s[1:] != s[:-1]], True)
        size = level.last - level.first + 1
        out, long = s[level.first], np.flatnonzero(size > 1)
        if len(long):
            out = out.copy()
            out[long] = self._named(out[long], size[long].astype(np.int64))
        return out, closed[level.first]

    def _pairs(self, level: Level, closed: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        s = level.symbols
        right = mix(s.astype(np.uint64) + np.uint64(step << 40)) & np.uint64(1) == 1
        joined = np.r_[False, right[1:] & ~right[:-1] & ~closed[1:] & ~closed[:-1]]
        level.grouped(~joined, False)
        out, two = s[level.first].copy(), np.flatnonzero(level.last > level.first)
        if len(two):
            out[two] = self._named(s[level.first[two]], s[level.last[two]])
        return out, closed[level.first]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on and from j on are equal; i and j differ."""
        return self._extend(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j are equal."""
        return self._extend(i - 1, j - 1, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        x, y = i.astype(np.int32), j.astype(np.int32)
        stopped = np.full(len(x), -1, np.int32)  # the level where the symbols differ
        live = np.arange(len(x))
        for k, level in enumerate(self.levels):
            live = self._level(level, x, y, live, stopped, k, way)
            if not len(live):
                break
            x[live], y[live] = level.up[x[live]], level.up[y[live]]
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(stopped == k)
            if not len(down):
                continue
            level = self.levels[k - 1]
            edge = level.first if way > 0 else level.last
            x[down], y[down] = edge[x[down]], edge[y[down]]
            same = down[level.symbols[x[down]] == level.symbols[y[down]]]
            self._jump(level, x, y, same, way)
            stopped[down] = k - 1
        return way * (x.astype(np.int64) - i)

    def _jump(self, level: Level, x, y, at: np.ndarray, way: int) -> None:
        """Over equal symbols: in a block level as many as the shorter of both runs still has, else one."""
        edge = level.last if way > 0 else level.first
        n = np.minimum(way * (edge[level.up[x[at]]] - x[at]), way * (edge[level.up[y[at]]] - y[at])) + 1 if level.blocks else 1
        x[at] += way * n
        y[at] += way * n

    def _level(self, level: Level, x, y, live: np.ndarray, stopped: np.ndarray, k: int, way: int) -> np.ndarray:
        """The queries of live that go to the next level; the others' symbols differ here."""
        differ = level.symbols[x[live]] != level.symbols[y[live]]
        stopped[live[differ]] = k
        live = live[~differ]
        if level is self.levels[-1]:  # a few symbols a sequence
            while len(live):
                x[live] += way
                y[live] += way
                differ = level.symbols[x[live]] != level.symbols[y[live]]
                stopped[live[differ]] = k
                live = live[~differ]
        if not len(live):
            return live
        edge = level.first if way > 0 else level.last
        inside = live[(edge[level.up[x[live]]] != x[live]) | (edge[level.up[y[live]]] != y[live])]
        if len(inside):
            self._jump(level, x, y, inside, way)
            differ = inside[level.symbols[x[inside]] != level.symbols[y[inside]]]
            stopped[differ] = k
            live = live[stopped[live] < 0]
        return live
