"""Suffix order and common prefixes by external induced sorting.

A suffix is of type S if it is smaller than the next one, else L; S* suffixes are those of type S after one of type L. The
substrings between S* positions are sorted and named; the string of names is sorted the same way (recursion), or in memory by
doubling if it is short. The sorted S* suffixes then induce the order of all L suffixes, from the smallest symbol to the
largest, and these that of all S suffixes, from the largest to the smallest. What is induced waits in a queue of its first
symbol, as tuples of a position and the common prefix with the tuple before; a queue's tuples arrive in their order, so a
queue is read once from its beginning. Queues over the memory limit are appended to files. Common prefixes are induced along:
two tuples from one symbol's suffixes share one symbol more than the least common prefix between their sources, and those
from different symbols share one. Values stop at a cap, which is all that finding repeated windows needs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


class SymbolQueues:
    """First-in first-out queues of (position, common prefix), one for each symbol; the fullest go to disk over `memory` bytes."""

    _TUPLE = 9

    def __init__(self, memory: int) -> None:
        self.memory, self.held = memory, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.files: dict[int, str] = {}
        self.folder: tempfile.TemporaryDirectory | None = None
        self.spilled = 0

    def push(self, symbol: int, positions: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((positions, lcp))
        self.held += self._TUPLE * len(positions)
        while self.held > self.memory:
            self._spill(max(self.parts, key=lambda s: sum(len(x) for x, _ in self.parts[s])))

    def _spill(self, symbol: int) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="queues-")
        path = self.files.setdefault(symbol, os.path.join(self.folder.name, str(symbol)))
        for name, k, kind in ((path + ".p", 0, np.int64), (path + ".l", 1, np.uint8)):
            with open(name, "ab") as f:
                for part in self.parts[symbol]:
                    part[k].astype(kind).tofile(f)
        n = sum(len(x) for x, _ in self.parts.pop(symbol))
        self.held -= self._TUPLE * n
        self.spilled += n

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of the symbol, and its queue is empty."""
        parts = []
        if path := self.files.pop(symbol, None):
            parts.append((np.fromfile(path + ".p", np.int64), np.fromfile(path + ".l", np.uint8)))
            os.remove(path + ".p")
            os.remove(path + ".l")
        rest = self.parts.pop(symbol, [])
        self.held -= self._TUPLE * sum(len(x) for x, _ in rest)
        parts += rest
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return (parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True)))  # type: ignore[return-value]

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


class RangeMin:
    """Least value of ranges of an array, from tables of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while 2 << len(self.tables) - 1 <= len(values):
            half = 1 << len(self.tables) - 1
            t = self.tables[-1]
            self.tables.append(np.minimum(t[: len(t) - half], t[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low..high, both included."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for level in np.unique(k).tolist():
            some = k == level
            t = self.tables[level]
            out[some] = np.minimum(t[low[some]], t[high[some] - (1 << level) + 1])
        return out


class Sorter:
    """cap: common prefixes are counted to it, and the order is right to it at least. memory: bytes of queued tuples in memory.
    base: names up to so many are sorted in memory."""

    def __init__(self, cap: int, memory: int = 64 << 20, base: int = 4 << 20) -> None:
        if not 0 < cap < 255:
            raise ValueError("0 < cap < 255")
        self.cap, self.memory, self.base = cap, memory, base
        self.spilled = 0

    def buckets(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each symbol (numbers from 1), from the largest: positions of the suffixes that begin with it, from the largest, and the
        common prefix of each with the one before it (0 for the first)."""
        n = len(text)
        if not n:
            return
        text = text.astype(np.int64)
        step = np.append(np.diff(text), -1)  # the end is smaller than any symbol
        differs = np.where(step != 0, np.arange(n), n)
        at = np.minimum.accumulate(differs[::-1])[::-1]  # last of the run of equal symbols
        small = step[at] > 0  # type S
        run = np.minimum(at - np.arange(n) + 1, self.cap).astype(np.uint8)
        del differs, at, step
        seeds, seed_lcp = self._seeds(text, small)
        larger = self._induce(text, small, run, np.unique(text), seeds, seed_lcp)
        yield from self._induce_small(text, small, run, larger)

    def order(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in ascending order and each one's common prefix with the one before it, capped."""
        parts = list(self.buckets(text))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        order = np.concatenate([p for p, _ in parts])[::-1]
        lcp = np.concatenate([x for _, x in parts])[::-1]
        return order, np.concatenate((np.zeros(1, np.uint8), lcp[:-1]))

    # -- S* suffixes ------------------------------------------------------------------------------------------------

    def _seeds(self, text: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in order of their suffixes, and common prefixes of neighbours."""
        star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        if len(star) < 2:
            return star, np.zeros(len(star), np.uint8)
        names = self._names(text, small, star)
        if names.max() + 1 == len(names):
            order, same = np.argsort(names), np.zeros(len(names), np.int64)
        elif len(names) <= self.base:
            order, same = doubled(names, self.cap)
        else:
            order, same = self.order(names + 1)
            same = same.astype(np.int64)
        # equal names are equal symbols; beyond them the symbols decide
        first, second = star[order[:-1]], star[order[1:]]
        ends = np.append(star, len(text))
        reach = np.minimum(ends[np.minimum(order[1:] + same[1:], len(star))] - second, self.cap)
        live = np.flatnonzero(reach < self.cap)
        while len(live):
            a, b = first[live] + reach[live], second[live] + reach[live]
            ok = (a < len(text)) & (b < len(text))
            live, a, b = live[ok], a[ok], b[ok]
            live = live[text[a] == text[b]]
            reach[live] += 1
            live = live[reach[live] < self.cap]
        return star[order], np.concatenate((np.zeros(1, np.uint8), reach.astype(np.uint8)))

    def _names(self, text: np.ndarray, small: np.ndarray, star: np.ndarray) -> np.ndarray:
        """Ranks of the substrings from each S* position to the next, types included, equal ones alike."""
        element = text * 2 + small
        bits = int(element.max()).bit_length()
        per = max(1, 62 // bits)
        packed = np.zeros(len(text), np.int64)
        for k in range(min(per, len(text))):
            packed[: len(text) - k] |= element[k:] << (bits * (per - 1 - k))
        length = np.append(np.diff(star) + 1, len(text) - star[-1] + 1)

        def key(who: np.ndarray, done: int) -> np.ndarray:
            at = star[who] + done
            out = packed[np.minimum(at, len(text) - 1)]
            out[at >= len(text)] = 0
            cut = np.maximum(per - (length[who] - done), 0)
            return out >> (bits * cut) << (bits * cut)

        rank = np.unique(key(np.arange(len(star)), 0), return_inverse=True)[1].astype(np.int64)
        done = per
        live = np.flatnonzero(length > done)
        while len(live):
            counts = np.bincount(rank, minlength=int(rank.max()) + 1)
            live = live[counts[rank[live]] > 1]
            if not len(live):
                break
            k = key(live, done)
            order = np.lexsort((k, rank[live]))
            r, k = rank[live][order], k[order]
            new = np.concatenate(([0], ((r[1:] == r[:-1]) & (k[1:] != k[:-1])).astype(np.int64)))
            total = np.cumsum(new)
            start = np.concatenate(([True], r[1:] != r[:-1]))
            sub = total - np.repeat(total[start], np.diff(np.append(np.flatnonzero(start), len(r))))
            wide = rank * (int(sub.max()) + 1)
            wide[live[order]] += sub
            rank = np.unique(wide, return_inverse=True)[1].astype(np.int64)
            done += per
            live = live[length[live] > done]
        return rank

    # -- induction ---------------------------------------------------------------------------------------------------

    def _rounds(self, queues: SymbolQueues, symbol: int, text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol's queued suffixes, and those that they induce under the same symbol, round by round."""
        got, lcp = queues.pop(symbol)
        if len(lcp):
            lcp = lcp.copy()
            lcp[0] = 0
        every, prefixes = [got], [lcp]
        size, source_before = 0, -1
        flat = lcp
        while len(got):
            before = got - 1
            some = np.flatnonzero((got > 0) & wanted[before] & (text[before] == symbol))
            if not len(some):
                break
            source = size + some
            value = np.ones(len(some), np.uint8)
            if source_before >= 0:
                cuts = np.concatenate(([source_before], source))
                value = self._more(np.minimum.reduceat(flat[: source[-1] + 1], cuts[:-1] + 1))
            elif len(some) > 1:
                value[1:] = self._more(np.minimum.reduceat(flat[: source[-1] + 1], source[:-1] + 1))
            source_before = int(source[-1])
            size += len(got)
            got = before[some]
            every.append(got)
            prefixes.append(value)
            flat = np.concatenate((flat, value))
        return (np.concatenate(every), flat) if len(every) > 1 else (every[0], flat)

    def _more(self, lcp: np.ndarray) -> np.ndarray:
        return np.minimum(lcp, self.cap - 1).astype(np.uint8) + np.uint8(1)

    def _send(self, queues: SymbolQueues, symbol: int, text: np.ndarray, wanted: np.ndarray, positions: np.ndarray, lcp: np.ndarray) -> None:
        """Queue what a symbol's suffixes induce under other symbols."""
        before = positions - 1
        some = np.flatnonzero((positions > 0) & wanted[before] & (text[before] != symbol))
        if not len(some):
            return
        target = text[before[some]]
        order = np.argsort(target, kind="stable")
        source, target = some[order], target[order]
        value = np.ones(len(source), np.uint8)
        inner = np.flatnonzero(target[1:] == target[:-1]) + 1
        if len(inner):
            value[inner] = self._more(RangeMin(lcp)(source[inner - 1] + 1, source[inner]))
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            queues.push(int(target[a]), before[source[a:b]], value[a:b])

    def _induce(self, text: np.ndarray, small: np.ndarray, run: np.ndarray, symbols: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray) -> SymbolQueues:
        """The L suffixes of each symbol in ascending order, queued by symbol."""
        queues, out, large = SymbolQueues(self.memory // 2), SymbolQueues(self.memory // 2), ~small
        try:
            last = len(text) - 1  # induced by the end
            queues.push(int(text[last]), np.array([last]), np.ones(1, np.uint8))
            cuts = np.searchsorted(text[seeds], np.append(symbols, symbols[-1] + 1))
            for k, symbol in enumerate(symbols.tolist()):
                got, lcp = self._rounds(queues, symbol, text, large)
                if len(got):
                    out.push(symbol, got, lcp)
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    mine = seed_lcp[a:b].copy()
                    mine[0] = min(run[got[-1]], run[seeds[a]]) if len(got) else 0
                    got, lcp = np.concatenate((got, seeds[a:b])), np.concatenate((lcp, mine))
                self._send(queues, symbol, text, large, got, lcp)
            self.spilled += queues.spilled + out.spilled
        finally:
            queues.close()
        return out

    def _induce_small(self, text: np.ndarray, small: np.ndarray, run: np.ndarray, larger: SymbolQueues) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        queues = SymbolQueues(self.memory // 2)
        try:
            for symbol in np.unique(text)[::-1].tolist():
                got, lcp = self._rounds(queues, symbol, text, small)
                up, up_lcp = larger.pop(symbol)
                if len(up):
                    down = np.concatenate((up_lcp[1:], [np.uint8(0)]))[::-1].astype(np.uint8)  # with the next larger one
                    if len(got):
                        down[0] = min(run[got[-1]], run[up[-1]])
                    got, lcp = np.concatenate((got, up[::-1])), np.concatenate((lcp, down))
                self._send(queues, symbol, text, small, got, lcp)
                yield got, lcp
            self.spilled += queues.spilled
        finally:
            queues.close()
            larger.close()


def doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a string of names in the order of their first `cap` names at least, and how many names neighbours share (to cap)."""
    ranks, size, n = [names + 1], 1, len(names)
    while size < cap and int(ranks[-1].max()) < n:
        r = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: n - size] = r[size:] if size < n else 0
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[level], 0)
        hit = (a < n) & (b < n)
        hit &= r[np.minimum(a, n)] == r[np.minimum(b, n)]
        for x in (a, b, same):
            x[hit] += 1 << level
    return order, np.minimum(np.concatenate(([0], same)), cap)
