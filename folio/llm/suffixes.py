"""Suffix sort by hashes: prefix polynomial hashes and binary search find how far two suffixes agree, so a comparison takes a logarithmic number of steps, in a merge sort that advances all its merges together.

Hashes can collide, so the agreement of neighbours is verified byte by byte after the sort, which is done anew with
other hashes if one is wrong.
"""

from __future__ import annotations

import numpy as np

from folio.llm.textbytes import BASE, BYTE, mixed, powers


class Suffixes:
    """Pieces of a byte array: from ``start`` on, at most ``cap`` bytes long (at most ``most`` for all)."""

    def __init__(self, data: np.ndarray, start: np.ndarray, cap: np.ndarray, most: int, seed: int = 0):
        self.data, self.start, self.cap, self.most = data, start, cap, most
        values = mixed(BYTE + np.uint64(seed)) | np.uint64(1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers(len(data))[: len(data)], dtype=np.uint64)])
        self.inverse = powers(len(data), True)

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of pieces how many bytes from their start are the same."""
        a, b = self.start[i], self.start[j]
        most = np.minimum(self.cap[i], self.cap[j])
        sa, sb, ia, ib = self.sums[a], self.sums[b], self.inverse[a], self.inverse[b]
        known = np.zeros(len(i), np.int64)
        step = 1 << (int(self.most).bit_length() - 1)
        while step:
            more = known + step
            at = np.minimum(more, most)
            same = (self.sums[a + at] - sa) * ia == (self.sums[b + at] - sb) * ib
            known = np.where(same & (more <= most), more, known)
            step >>= 1
        return known

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether piece i stands before piece j; ties: what holds where they are the same."""
        n = self.agree(i, j)
        ci, cj = self.cap[i], self.cap[j]
        inside = (n < ci) & (n < cj)
        limit = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, limit)], self.data[np.minimum(self.start[j] + n, limit)]
        return np.where(inside, x < y, np.where(ci != cj, ci < cj, ties))


def merge_sorted(s: Suffixes, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The pieces ``order``, sorted inside each run of equal ``group`` (which is in order)."""
    order = order.copy()
    n = len(order)
    if not n:
        return order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - base
    width = 1
    while width < sizes.max():
        on = np.flatnonzero(size > width)
        run = place[on] // width
        other = run ^ 1
        low = np.minimum(other * width, size[on]) + base[on]
        high = np.minimum((other + 1) * width, size[on]) + base[on]
        start, is_left, mine = low.copy(), run % 2 == 0, order[on]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            # of equal pieces the left run's come first
            passed = s.before(order[middle], mine[open_], ~is_left[open_])
            low[open_] = np.where(passed, middle + 1, low[open_])
            high[open_] = np.where(passed, high[open_], middle)
        to = base[on] + run // 2 * 2 * width + (place[on] - run * width) + (low - start)
        new = order.copy()
        new[to] = mine
        order = new
        width *= 2
    return order


def neighbours(s: Suffixes, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each piece in the order agrees with the one before, 0 at a group's first."""
    out = np.zeros(len(order), np.int64)
    inside = np.flatnonzero(group[1:] == group[:-1]) + 1
    out[inside] = s.agree(order[inside - 1], order[inside])
    return out


def verified(s: Suffixes, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether the bytes bear the agreement of neighbours out, and end it where it ends."""
    limit = len(s.data) - 1
    for k in range(0, len(order), 50_000):
        some = np.flatnonzero(common[k : k + 50_000]) + k
        if not len(some):
            continue
        a, b = s.start[order[some - 1]], s.start[order[some]]
        n, most = common[some], np.minimum(s.cap[order[some - 1]], s.cap[order[some]])
        at = np.arange(s.most)
        same = s.data[np.minimum(a[:, None] + at, limit)] == s.data[np.minimum(b[:, None] + at, limit)]
        if (~same & (at < n[:, None])).any() or (same[np.arange(len(n)), np.minimum(n, s.most - 1)] & (n < most)).any():
            return False
    return True


def suffix_order(data: np.ndarray, start: np.ndarray, cap: np.ndarray, most: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the pieces, sorted inside groups."""
    by_group = np.argsort(group, kind="stable")
    grouped = group[by_group]
    for seed in range(8):
        s = Suffixes(data, start, cap, most, seed)
        order = merge_sorted(s, by_group, grouped)
        common = neighbours(s, order, grouped)
        if verified(s, order, common):
            return order, common
    raise RuntimeError("hashes collide under every seed")


__all__ = ["BASE", "Suffixes", "suffix_order"]
