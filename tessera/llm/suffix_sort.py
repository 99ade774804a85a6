"""Hash-compared sorting of suffixes.

Two suffixes are compared by the length that they have in common, found by
binary search over prefix polynomial hashes: a comparison takes a number of
steps logarithmic in the length.  A bottom-up mergesort orders many groups of
suffixes at once, each step for all of them.  The common lengths of neighbours
are then verified on the bytes; after a collision the sort starts anew with
another base.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix64


class Polynomial:
    """Prefix hashes of byte strings modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.value = mix64(np.arange(256, dtype=np.uint64) + np.uint64(self.base & 0xFFFF))
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self._up, self._down = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))) for b in (self.base, self.inverse))
        return self._up, self._down

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * up[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hash of `length` bytes from each place of `at`."""
        with np.errstate(over="ignore"):
            return (prefixes[at + length] - prefixes[at]) * self._down[at]


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class _Sorter:
    def __init__(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, base: int) -> None:
        self.data, self.at, self.length = data, at.astype(np.int64), length.astype(np.int64)
        self.hash = Polynomial(base)
        self.prefixes = self.hash.prefixes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length that suffixes i and j have in common."""
        a, b = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash.of(self.prefixes, a, mid) == self.hash.of(self.prefixes, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones do not."""
        n = self.common(i, j)
        ended, other = n == self.length[i], n == self.length[j]
        last = len(self.data) - 1
        return np.where(ended | other, ended & ~other, self.data[np.minimum(self.at[i] + n, last)] < self.data[np.minimum(self.at[j] + n, last)])

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """Suffix numbers group by group, in order within each; `group` is not decreasing."""
        n = len(group)
        order, place = np.arange(n), np.arange(n)
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        width = 1
        while len(active := np.flatnonzero(size > width)):
            inside = place[active] - first[active]
            run = inside // width
            left = run % 2 == 0
            start = first[active] + (run ^ 1) * width  # of the run to merge with
            stop = np.minimum(start + width, first[active] + size[active])
            low, high = np.minimum(start, stop), stop.copy()
            own = order[active]
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                other = order[mid]
                # On the left, count what sorts before; on the right, what does not sort after.
                goes = np.empty(len(k), bool)
                a = left[k]
                goes[a] = self.before(other[a], own[k[a]])
                goes[~a] = ~self.before(own[k[~a]], other[~a])
                low[k[goes]] = mid[goes] + 1
                high[k[~goes]] = mid[~goes]
            passed = low - np.minimum(start, stop)
            to = first[active] + run // 2 * 2 * width + inside % width + passed
            order[to] = own
            width *= 2
        return order

    def verified(self, order: np.ndarray, common: np.ndarray) -> bool:
        """Whether each suffix really shares `common` bytes with the one before it."""
        reach = int(common.max(initial=0)) + 1
        step = np.arange(reach)
        for k in range(1, len(order), 2048):
            a, b = order[k - 1 : k + 2047], order[k : k + 2048]
            a = a[: len(b)]
            n = common[k : k + len(b), None]
            last = len(self.data) - 1
            same = self.data[np.minimum(self.at[a][:, None] + step, last)] == self.data[np.minimum(self.at[b][:, None] + step, last)]
            if not (same | (step >= n)).all():
                return False
        return True


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes data[at : at + length] in order within each group.

    `common` holds for each in that order the length shared with the one
    before; -1 for the first of a group.
    """
    for base in BASES:
        sorter = _Sorter(data, at, length, base)
        order = sorter.sorted(group)
        common = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        common[inner] = sorter.common(order[inner - 1], order[inner])
        if sorter.verified(order, common):
            return order, common
    raise ArithmeticError("hashes collide in every base")
