"""Structures that are kept while a symbol's bars pass by: first breaks of levels, weights by price over a window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np


def first_breaks(closes: list[float], levels: list[float | None], touch: bool = False) -> list[int | None]:
    """For each bar the next one whose close lies under the bar's level (or touches it), None if there is none.

    One pass from the end.  What a bar can break through are the closes after it that are lower than
    all between: a stack whose values fall with distance.  A close that comes in takes off those that
    are not lower than itself, and the first one under a level is found by halving.
    """
    out: list[int | None] = [None] * len(closes)
    lows, where = [], []  # from far to near, so values rise
    for k in range(len(closes) - 1, -1, -1):
        level = levels[k]
        if level is not None and level == level:
            near = bisect_right(lows, level) if touch else bisect_left(lows, level)
            out[k] = where[near - 1] if near else None
        close = closes[k]
        while lows and lows[-1] >= close:
            lows.pop()
            where.pop()
        lows.append(close)
        where.append(k)
    return out


class PriceWeights:
    """Weights by rank of price (a Fenwick tree): put one in, take one out, sums below a rank, the rank at a share of all."""

    def __init__(self, ranks: int) -> None:
        self.tree = np.zeros(ranks + 1, np.int64)
        self.total = 0
        self.top = 1 << max(0, ranks.bit_length() - 1)

    def add(self, rank: int, weight: int) -> None:
        tree, k = self.tree, rank + 1
        while k < len(tree):
            tree[k] += weight
            k += k & -k
        self.total += weight

    def below(self, ranks: np.ndarray) -> np.ndarray:
        """Weights of the ranks before each of ``ranks``."""
        k, out = ranks.copy(), np.zeros(len(ranks), np.int64)
        while (open_ := k > 0).any():
            out += np.where(open_, self.tree[k], 0)
            k = np.where(open_, k & (k - 1), 0)
        return out

    def at(self, share: float) -> int:
        """The least rank up to which the weights make at least ``share`` of all."""
        need, k, sum_, step = self.total * share, 0, 0, self.top
        while step:
            if k + step < len(self.tree) and sum_ + self.tree[k + step] < need:
                k += step
                sum_ += self.tree[k]
            step >>= 1
        return k


def profiles(prices: np.ndarray, weights: np.ndarray, window: int):
    """(bar, prices in order, weights of the window's bars by rank) for each bar from the ``window``-th on.

    Every bar goes in once and out once; ``weights`` are whole numbers, so nothing is lost on the way.
    """
    ordered, rank = np.unique(prices, return_inverse=True)
    held = PriceWeights(len(ordered))
    for k, r in enumerate(rank.tolist()):
        if weights[k] > 0:
            held.add(r, int(weights[k]))
        if k >= window and weights[k - window] > 0:
            held.add(int(rank[k - window]), -int(weights[k - window]))
        if k >= window - 1 and held.total:
            yield k, ordered, held


#: Windows that are worked out at once; a block's tables stay in a core's cache.
BLOCK = 128


def whole_weights(volumes: np.ndarray, parts: int) -> np.ndarray:
    """Volumes in whole parts; missing and negative ones weigh nothing."""
    return np.rint(np.where(volumes > 0, volumes, 0.0) * parts).astype(np.int64)


def block_quantiles(prices: np.ndarray, weights: np.ndarray, window: int, shares: tuple[float, ...]):
    """(bars, one array of prices for each share): the least price up to which a window's weights make the share of all.

    The windows of a block share one order of their bars' prices; a window is the running sum of its own bars' weights along it.
    """
    for first in range(window - 1, len(prices), BLOCK):
        at = np.arange(first, min(first + BLOCK, len(prices)))
        since = first - window + 1
        order = np.argsort(prices[since : at[-1] + 1], kind="stable")
        start = (at - first)[:, None]
        sums = np.cumsum(np.where((order >= start) & (order < start + window), weights[since + order], 0), axis=1)
        some = sums[:, -1] > 0
        at, sums = at[some], sums[some]
        yield at, [prices[since + order[(sums < sums[:, -1:] * q).sum(axis=1)]] for q in shares]


def block_histograms(prices: np.ndarray, weights: np.ndarray, window: int, bins: int):
    """(bars, lowest and highest price with weight, weights by equal bins between them); a range without width gets some."""
    if len(prices) < window:
        return
    views = [np.lib.stride_tricks.sliding_window_view(x, window) for x in (prices, np.where(np.isnan(prices), 0, weights))]
    for first in range(0, len(views[0]), BLOCK):
        own, held = (x[first : first + BLOCK] for x in views)
        some = held.any(axis=1)
        at, own, held = first + window - 1 + np.flatnonzero(some), own[some], held[some]
        if not len(at):
            continue
        low, high = np.where(held > 0, own, np.inf).min(axis=1), np.where(held > 0, own, -np.inf).max(axis=1)
        half = np.where(low == high, np.maximum(np.abs(low) * 0.005, 0.005), 0.0)
        low, high = low - half, high + half
        bin_of = np.minimum(np.floor((own - low[:, None]) / (high - low)[:, None] * bins), bins - 1)
        place = np.where(held > 0, bin_of, 0).astype(np.int64) + np.arange(len(at))[:, None] * bins
        # Sums of whole numbers below 2^53 are exact in doubles.
        yield at, low, high, np.bincount(place.ravel(), held.ravel(), len(at) * bins).reshape(-1, bins)
