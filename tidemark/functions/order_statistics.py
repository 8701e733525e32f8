"""Order statistics of many frames of one series at once, in numpy.

A wavelet matrix holds the ranks of a series bit by bit, with running counts of the zeros. The k-th smallest value of any frame [a, b) then takes one step
for each bit, so a frame of any width costs the logarithm of the series' length; all frames are answered together.
"""

from __future__ import annotations

import numpy as np


class FrameOrder:
    """values: no nulls; NaN counts as largest."""

    def __init__(self, values: np.ndarray):
        self.sorted, ranks = np.unique(np.asarray(values, float), return_inverse=True)
        self.levels: list[tuple[np.ndarray, int]] = []
        ranks = ranks.reshape(-1)
        for bit in range(max(1, int(len(self.sorted) - 1).bit_length()) - 1, -1, -1):
            ones = (ranks >> bit) & 1 == 1
            zeros_before = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((zeros_before, int(zeros_before[-1])))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def kth(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with index k (from 0) of each frame [a, b) in ascending order; k has to be within."""
        a, b, k = (np.array(x, np.int64) for x in (a, b, k))
        if not len(a):
            return np.zeros(0)
        rank = np.zeros(len(a), np.int64)
        for zeros_before, n_zeros in self.levels:
            low, high = zeros_before[a], zeros_before[b]
            right = k >= high - low
            k = np.where(right, k - (high - low), k)
            a = np.where(right, n_zeros + a - low, low)
            b = np.where(right, n_zeros + b - high, high)
            rank = 2 * rank + right
        return self.sorted[rank]

    def quantile(self, a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
        """Linear interpolation between the neighbours of p * (n - 1); frames must not be empty."""
        at = p * (np.asarray(b) - a - 1)
        low = np.floor(at)
        below, above = self.kth(a, b, low), self.kth(a, b, np.ceil(at))
        return below + (above - below) * (at - low)

    def median(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean of the two middle values."""
        n = np.asarray(b) - a
        return (self.kth(a, b, (n - 1) // 2) + self.kth(a, b, n // 2)) / 2

    def deviation(self, a: np.ndarray, b: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Median of |x - middle| over each frame.

        Values from the middle down and from the middle up are two ascending runs of deviations; how many of the k smallest come from the lower run is found by bisection.
        """
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        n = b - a
        under = self.count_below(a, b, middle)
        first = self._kth_deviation(a, b, middle, under, (n - 1) // 2)
        return (first + self._kth_deviation(a, b, middle, under, n // 2)) / 2

    def count_below(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of each frame are less than its limit."""
        want = np.searchsorted(self.sorted, limit)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        found = np.zeros(len(a), np.int64)
        everything = want >= 1 << len(self.levels)
        whole = b - a
        for level, (zeros_before, n_zeros) in enumerate(self.levels):
            right = (want >> (len(self.levels) - 1 - level)) & 1 == 1
            low, high = zeros_before[a], zeros_before[b]
            found += np.where(right, high - low, 0)
            a, b = np.where(right, n_zeros + a - low, low), np.where(right, n_zeros + b - high, high)
        return np.where(everything, whole, found)

    def _kth_deviation(self, a, b, middle, under, k):
        n = b - a
        lower = lambda j: middle - self.kth(a, b, np.clip(under - 1 - j, 0, n - 1))  # noqa: E731  j-th deviation below the middle
        upper = lambda j: self.kth(a, b, np.clip(under + j, 0, n - 1)) - middle
        # The least number of values taken from below such that the next one from below isn't under the last one taken from above.
        least, most = np.maximum(0, k + 1 - (n - under)), np.minimum(under, k + 1)
        while (least < most).any():
            half = (least + most) // 2
            open_ = least < most
            enough = lower(half) >= upper(k - half)
            most = np.where(open_ & enough, half, most)
            least = np.where(open_ & ~enough, half + 1, least)
        taken = least
        below = np.where(taken > 0, lower(np.maximum(taken - 1, 0)), -np.inf)
        above = np.where(k + 1 - taken > 0, upper(np.maximum(k - taken, 0)), -np.inf)
        return np.maximum(below, above)
