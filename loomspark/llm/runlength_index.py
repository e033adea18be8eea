"""A run-length compressed Burrows-Wheeler index of a set of byte strings, with sampled run ends.

What stays of the transform are its runs: for each run its symbol's place in the first column, and, from the text
positions of the runs' first and last rows, how far the suffix at a run's border agrees with the nearest run of the
same symbol above and below. Strings stream through it from their ends, all at once, a byte a step; their matching
statistics with respect to everything but themselves need nothing else, not even the text.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling, from seven bytes on; only unresolved groups are sorted again.

    data: the strings, each followed by one separator; left: bytes up to the suffix's separator; owner: its string.
    A separator is less than any byte; separators differ, by their string's number."""
    n = len(data)
    sym = data.astype(np.int64) + 1
    sym[left == 0] = 0
    padded = np.concatenate([sym, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key |= np.where(left >= j, padded[j : j + n], 0) << (9 * (6 - j))
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n + 1, bool)
    new[1:n] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    k = 7
    while True:
        slots = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(slots):
            return sa
        s = sa[slots]
        second = np.where(left[s] < k, owner[s], rank[np.minimum(s + k, n - 1)])
        key = group[slots] * np.int64(n + 1) + second
        order = np.argsort(key)
        key, sa[slots] = key[order], s[order]
        new[slots[1:]] |= key[1:] != key[:-1]
        group[slots] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        rank[sa[slots]] = group[slots]
        k *= 2


class RunLengthIndex:
    """run_start: first row of each run; step: row that its first row goes to by one step of backward search, -1 for a
    string's beginning; above, below: bytes that the suffix thereby reached shares with the next row on that side."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.count = len(strings)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        data = np.frombuffer(b"\0".join([*strings, b""]) if strings else b"", np.uint8)
        self.n = n = len(data)
        self.owner = np.repeat(np.arange(self.count), sizes + 1)
        self.left = (self.starts + sizes)[self.owner] - np.arange(n) if n else np.zeros(0, np.int64)
        if not n:
            self.run_start = self.step = self.above = self.below = np.zeros(0, np.int64)
            return
        sa = suffix_order(data, self.left, self.owner)
        # what stands before each suffix: a byte, or a border of its own
        bwt = np.where(self.left[sa - 1] == 0, -1 - self.owner[sa], data[sa - 1].astype(np.int64))
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        self.run_start = np.flatnonzero(head)
        run_end = np.append(self.run_start[1:], n) - 1
        symbol = bwt[self.run_start]
        # runs of one symbol follow each other in the first column
        order = np.argsort(symbol, kind="stable")
        order = order[symbol[order] >= 0]
        length = (run_end - self.run_start + 1)[order]
        self.step = np.full(len(symbol), -1)
        self.step[order] = self.count + np.cumsum(length) - length
        twin = symbol[order][1:] == symbol[order][:-1]
        upper, lower = order[:-1][twin], order[1:][twin]
        shared = 1 + self._common(data, sa[run_end[upper]], sa[self.run_start[lower]])
        self.above, self.below = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
        self.above[lower] = self.below[upper] = shared

    def _common(self, data: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, up to the nearer separator; eight bytes at a time."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.zeros(self.n, np.uint64)
        for k in range(8):
            words |= padded[k : k + self.n].astype(np.uint64) << np.uint64(8 * k)
        most = np.minimum(self.left[i], self.left[j])
        out = np.zeros(len(i), np.int64)
        at = np.flatnonzero(most > 0)
        while len(at):
            x = words[i[at] + out[at]] ^ words[j[at] + out[at]]
            low = (x & (~x + np.uint64(1))).astype(np.float64)
            same = np.where(x == 0, 8, (np.frexp(low)[1] - 1) // 8)
            out[at] += same
            at = at[(same == 8) & (out[at] < most[at])]
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """For each text position: how many bytes from there on also start somewhere else in the index.

        All strings are streamed backwards together. A string's row is known at its end (separators come first, in
        order of the strings); one step takes the row to that of the suffix one byte longer. The row above (below)
        goes along, its match growing by one, while both stand in one run; at a run's border the sample there says
        what the nearest suffix with the same byte before it shares."""
        out = np.zeros(self.n, np.int64)
        row, at = np.arange(self.count), self.starts + np.bincount(self.owner, minlength=self.count) - 1
        up, down = np.zeros(self.count, np.int64), np.zeros(self.count, np.int64)
        last = np.append(self.run_start[1:], self.n) - 1
        while len(row):
            run = np.searchsorted(self.run_start, row, side="right") - 1
            on = self.step[run] >= 0
            row, run, at, up, down = row[on], run[on], at[on] - 1, up[on], down[on]
            up = np.where(row == self.run_start[run], self.above[run], up + 1)
            down = np.where(row == last[run], self.below[run], down + 1)
            out[at] = np.maximum(up, down)
            row = self.step[run] + row - self.run_start[run]
        return out
