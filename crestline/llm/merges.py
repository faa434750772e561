"""Merging adjacent symbol pairs by rank, for byte-pair vocabularies.

`MergeTable` holds which pairs merge, into what and how early. `merge_all` runs an agenda for
many short units in lockstep with numpy: in each round every unit merges its best pair (lowest
rank, leftmost among equals), which is what a priority queue would take next. `merge_one` is
that queue itself, for units that are too long for rounds.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Symbols in a unit from which on the queue is used.
LONG = 64
_SHIFT = np.int64(21)
_NONE = np.iinfo(np.int64).max


class MergeTable:
    """Pairs (a, b) -> (rank, merged), kept sorted by a packed key; lower ranks merge first."""

    def __init__(self, a, b, rank, merged):
        key = (np.asarray(a, np.int64) << _SHIFT) | np.asarray(b, np.int64)
        order = np.lexsort((np.asarray(rank), key))
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        self.key = key[first]
        self.rank = np.asarray(rank, np.int64)[order][first]
        self.merged = np.asarray(merged, np.int64)[order][first]
        self._dict: dict[int, int] | None = None

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into rank and merged, or -1."""
        key = (a << _SHIFT) | b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, -1)

    def get(self, a: int, b: int) -> int:
        if self._dict is None:
            self._dict = {k: i for i, k in enumerate(self.key.tolist())}
        return self._dict.get((a << int(_SHIFT)) | b, -1)


def merge_one(symbols: list[int], table: MergeTable) -> list[int]:
    """One unit, by a queue of adjacent pairs ordered by rank, then position."""
    n = len(symbols)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    symbols = list(symbols)
    agenda: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (k := table.get(symbols[i], symbols[j])) >= 0:
            heapq.heappush(agenda, (int(table.rank[k]), i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = right[i]
        if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has merged with another since
        symbols[i] = int(table.merged[table.get(a, b)])
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s for s, ok in zip(symbols, alive, strict=True) if ok]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """All units, laid end to end in `symbols`: the merged symbols, laid the same way, and their lengths."""
    symbols, lengths = np.asarray(symbols, np.int64), np.asarray(lengths, np.int64)
    n = len(lengths)
    out_len = lengths.copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []  # unit of each symbol, symbol
    starts = np.cumsum(lengths) - lengths
    slow = np.flatnonzero(lengths > LONG)
    for u in slow.tolist():
        got = merge_one(symbols[starts[u] : starts[u] + lengths[u]].tolist(), table)
        out_len[u] = len(got)
        done.append((np.full(len(got), u), np.asarray(got, np.int64)))
    unit = np.repeat(np.arange(n), lengths)
    quick = lengths <= LONG
    if slow.size:
        keep = quick[unit]
        unit, symbols = unit[keep], symbols[keep]
    rank, merged = _ranks(symbols, unit, table)
    while len(symbols):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat(rank, first)
        stop = best == _NONE
        if stop.any():
            size = np.diff(np.r_[first, len(symbols)])
            gone = np.repeat(stop, size)
            out_len[unit[first[stop]]] = size[stop]
            done.append((unit[gone], symbols[gone]))
            keep = ~gone
            unit, symbols, rank, merged = unit[keep], symbols[keep], rank[keep], merged[keep]
            if not len(symbols):
                break
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = best[~stop]
        # the leftmost symbol of each unit that has its best rank
        hit = np.flatnonzero(rank == np.repeat(best, np.diff(np.r_[first, len(symbols)])))
        at = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol before each of them has gone
        unit, symbols, rank, merged = unit[keep], symbols[keep], rank[keep], merged[keep]
        again = np.unique(np.r_[at, at[at > 0] - 1])
        rank[again], merged[again] = _ranks_at(symbols, unit, again, table)
    who = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    what = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
    return what[np.argsort(who, kind="stable")], out_len


def _ranks(symbols, unit, table):
    return _ranks_at(symbols, unit, np.arange(len(symbols)), table)


def _ranks_at(symbols, unit, at, table):
    rank, merged = np.full(len(at), _NONE), np.zeros(len(at), np.int64)
    ok = at + 1 < len(symbols)
    ok[ok] = unit[at[ok]] == unit[at[ok] + 1]
    i = at[ok]
    k = table.find(symbols[i], symbols[i + 1])
    rank[ok], merged[ok] = np.where(k >= 0, table.rank[k], _NONE), table.merged[k]
    return rank, merged
