"""Suffix sort by compared hashes: the heart of operator 2.

Prefix polynomial hashes over a byte buffer give the hash of any substring in constant time; a binary search over lengths
finds the common extension of two suffixes, so one comparison takes logarithmic time; a bottom-up mergesort orders the
suffixes. Equality found by hashes is verified on the bytes, and where a collision is found the bytes decide.
All comparisons of a merge level are made at once.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mixed, ragged

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, remembered up to the longest asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=U64)
    return have[:n]


class PrefixHash:
    """Hashes of substrings of a buffer: equal substrings have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.undo = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.undo[start]

    def windows(self, length: int) -> np.ndarray:
        """The hash of every substring of one length."""
        n = len(self.data) - length + 1
        return (self.sums[length:] - self.sums[: n if n > 0 else 0]) * self.undo[: max(n, 0)] if n > 0 else np.zeros(0, U64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray, rows: int = 1 << 15, other: np.ndarray | None = None) -> np.ndarray:
    """Whether data[a:a+len] equals data[b:b+len] (or other[b:b+len]), for each row."""
    other = data if other is None else other
    out = np.ones(len(a), bool)
    for at in range(0, len(a), rows):
        n = lens[at : at + rows]
        if not n.sum():
            continue
        x, y = data[ragged(a[at : at + rows], n)], other[ragged(b[at : at + rows], n)]
        has = np.flatnonzero(n)
        begin = (np.cumsum(n) - n)[has]
        out[at + has] = np.logical_and.reduceat(x == y, begin)
    return out


def distinct_slices(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one slice's number for each distinct data[first:first+n], for each slice the place of its own among these, each one's hash). Slices meet by
    hashes; each is compared with its representative byte by byte, and where hashes collided the bytes decide."""
    h = mixed(PrefixHash(data).of(first, n) ^ n.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    uniq, one, of = np.unique(h, return_index=True, return_inverse=True)
    head = one[of]
    equal = n == n[head]
    some = np.flatnonzero(equal & (head != np.arange(len(n))))
    equal[some] = same_bytes(data, first[some], first[head[some]], n[some])
    if not equal.all():
        known, extra = {}, []
        for i in np.flatnonzero(~equal).tolist():
            raw = data[first[i] : first[i] + n[i]].tobytes()
            if raw not in known:
                known[raw] = len(one) + len(extra)
                extra.append(i)
            of[i] = known[raw]
        one = np.concatenate([one, np.array(extra, one.dtype)])
        uniq = h[one]
    return one, of, uniq


class SuffixSorter:
    """Orders suffixes by their first depth bytes; every suffix must have that many."""

    def __init__(self, data: np.ndarray, depth: int):
        self.hash, self.data, self.depth = PrefixHash(data), data, depth

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair of suffixes, depth at most, by hashes."""
        low = np.full(len(x), self.depth, np.int64)
        part = np.flatnonzero(self.hash.of(x, self.depth) != self.hash.of(y, self.depth))
        if len(part):
            a, b = x[part], y[part]
            lo, hi = np.zeros(len(part), np.int64), np.full(len(part), self.depth - 1, np.int64)
            for _ in range(self.depth.bit_length()):
                mid = (lo + hi + 1) >> 1
                eq = self.hash.of(a, mid) == self.hash.of(b, mid)
                lo, hi = np.where(eq, mid, lo), np.where(eq, hi, np.maximum(mid - 1, lo))
            low[part] = lo
        return low

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """extension(), verified on the bytes: where hashes collide, the bytes decide."""
        n = self.extension(x, y)
        for i in np.flatnonzero(~same_bytes(self.data, x, y, n)).tolist():
            n[i] = int(np.argmax(self.data[x[i] : x[i] + self.depth] != self.data[y[i] : y[i] + self.depth]))
        short = np.flatnonzero(n < self.depth)
        for i in short[self.data[x[short] + n[short]] == self.data[y[short] + n[short]]].tolist():
            differ = self.data[x[i] : x[i] + self.depth] != self.data[y[i] : y[i] + self.depth]
            n[i] = int(np.argmax(differ)) if differ.any() else self.depth
        return n

    def before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x sorts before y; ties: or is equal to it."""
        n = self.extension(x, y)
        full = np.flatnonzero(n >= self.depth)
        if len(wrong := full[~same_bytes(self.data, x[full], y[full], n[full])]):
            n[wrong] = self.verified(x[wrong], y[wrong])
        at = np.minimum(n, self.depth - 1)
        mine, theirs = self.data[x + at], self.data[y + at]
        if (odd := (n < self.depth) & (mine == theirs)).any():  # the next bytes must differ: else hashes collided
            some = np.flatnonzero(odd)
            n[some] = self.verified(x[some], y[some])
            at = np.minimum(n, self.depth - 1)
            mine, theirs = self.data[x + at], self.data[y + at]
        return np.where(n >= self.depth, ties, mine < theirs)

    def sort(self, group: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """group: ascending numbers; suffixes of a group are ordered among themselves. Gives the order and, for each place
        in it, whether it begins a run of suffixes with equal first depth bytes."""
        n = len(starts)
        order = np.arange(n)
        if not n:
            return order, np.zeros(0, bool)
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, n])
        first = np.repeat(begin, size)
        width, most = 1, int(size.max())
        total = np.repeat(size, size)
        while width < most:
            at = np.flatnonzero(total > width)  # places in groups with more than one run
            rel = at - first[at]
            run = rel // width
            left = run % 2 == 0
            other = first[at] + (run + np.where(left, 1, -1)) * width
            end = first[at] + total[at]
            low = np.minimum(other, end)
            stop = np.minimum(other + width, end)
            base = low.copy()
            mine = starts[order[at]]
            # how many of the other run come before: a left element lets equal ones pass after it, a right one before it
            while True:
                open_ = np.flatnonzero(low < stop)
                if not len(open_):
                    break
                mid = (low[open_] + stop[open_]) >> 1
                theirs = starts[order[mid]]
                goes = np.zeros(len(open_), bool)
                for side in (True, False):
                    s = np.flatnonzero(left[open_] == side)
                    goes[s] = self.before(theirs[s], mine[open_[s]], ties=not side)
                low[open_] = np.where(goes, mid + 1, low[open_])
                stop[open_] = np.where(goes, stop[open_], mid)
            pair = first[at] + (run // 2) * 2 * width
            place = pair + rel % width + (low - base)
            moved = order[at]
            order[place] = moved
            width *= 2
        fresh = np.ones(n, bool)
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        fresh[inner] = self.verified(starts[order[inner - 1]], starts[order[inner]]) < self.depth
        return order, fresh
