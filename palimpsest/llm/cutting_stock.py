"""Cutting-stock plans by column generation over a length histogram.

The linear program covers the demand for each length class with patterns (a
multiset of classes that fits one sequence) at the least number of sequences.
Columns are made as they are needed: a knapsack dynamic program finds the best
pattern under the current dual prices. Cutting one piece of a class into two
smaller classes is a column too, at a small price, so that lengths that do not
combine well are cut, and no others. Fractions are rounded down, and a greedy
fill packs what is left.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Slot:
    """Pieces from documents of one class, ranks ``low`` to ``high`` (excluded).

    Rank r goes to sequence ``sequence + (first + r - low) % copies``.
    """

    source: int
    low: int
    high: int
    offset: int
    length: int
    sequence: int
    copies: int
    first: int


def price_patterns(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the value of each room up to size, and the class to take there."""
    value = np.zeros(size + 1)
    pick = np.zeros(size + 1, int)
    useful = np.flatnonzero(price > 1e-12) + 1
    worth = price[useful - 1]
    for c, n in zip(range(1, size + 1), np.searchsorted(useful, np.arange(1, size + 1), "right").tolist(), strict=True):
        value[c] = value[c - 1]
        if n:
            got = value[c - useful[:n]]
            got += worth[:n]
            k = got.argmax()
            if got[k] > value[c]:
                value[c], pick[c] = got[k], useful[k]
    return value, pick


def pattern_of(pick: np.ndarray, room: int) -> np.ndarray:
    """The multiset of classes that the knapsack takes for a room."""
    counts = np.zeros(len(pick) - 1, int)
    while room > 0:
        if pick[room]:
            counts[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return counts


def solve(demand: np.ndarray, cut_price: float, gap: float = 5e-4, most: int = 6000, together: int = 8) -> list[tuple[str, np.ndarray | tuple[int, int], float]]:
    """Columns of a near-optimal basis with their values.

    Revised simplex with an explicit inverse. One knapsack prices the best
    pattern around each class; up to ``together`` of them enter one after the
    other while they still gain at the prices of that moment, and as many cuts.
    It stops when the best pattern is worth at most 1 + gap, at which the bound
    of the duals is that close, or when the sequences are within twice the gap
    of what the lengths alone would fill.
    """
    m = len(demand)
    size = np.arange(1, m + 1)
    columns: list[tuple[str, object]] = []
    inverse = np.zeros((m, m))
    for k in range(m):
        a = np.zeros(m, int)
        a[k] = m // (k + 1)
        columns.append(("pattern", a))
        inverse[k, k] = 1 / a[k]
    cost = np.ones(m)
    x = inverse @ (demand + 1e-7 * (1 + demand.mean()) * (1 + np.sin(size)))  # keeps ties of the ratio test apart
    price = cost @ inverse
    low, high = np.meshgrid(size, size)
    halves = 2 * low <= high  # a cut of class `high` into `low` and the rest
    low, high = low[halves], high[halves]
    filled = demand @ size / m
    entered = 0

    def enter(kind: str, column: object, c: float, a: np.ndarray, least: float) -> bool:
        nonlocal price, x, entered
        gain = price @ a - c
        if gain <= least:
            return False
        d = inverse @ a
        pos = np.flatnonzero(d > 1e-9)
        if not len(pos):
            return False
        r = int(pos[np.argmin(x[pos] / d[pos])])
        step = x[r] / d[r]
        x -= step * d
        x[r] = step
        inverse[r] /= d[r]
        d[r] = 0
        rows = np.flatnonzero(d)
        inverse[rows] -= np.outer(d[rows], inverse[r])
        price = price - gain * inverse[r]
        cost[r] = c
        columns[r] = (kind, column)
        entered += 1
        return True

    while entered < most and cost @ x > (1 + 2 * gap) * filled:
        before = entered
        price = cost @ inverse  # afresh, so that rounding does not add up
        if price.min() < -1e-9:  # a slot may stay empty
            a = np.zeros(m)
            k = int(np.argmin(price))
            a[k] = -1
            if not enter("empty", (k + 1, 0), 0.0, a, 0.0):
                break
            continue
        value, pick = price_patterns(price, m)
        gain = price[high - 1] - price[low - 1] - price[high - low - 1] - cut_price
        worth = np.flatnonzero(gain > max(value[m] - 1, gap))
        for k in worth[np.argsort(-gain[worth])[:together]]:
            h, lo = int(high[k]), int(low[k])
            a = np.zeros(m)
            a[h - 1] += 1
            a[lo - 1] -= 1
            a[h - lo - 1] -= 1
            enter("cut", (h, lo), cut_price, a, gap)
        around = price + value[m - size]  # the best pattern with each class
        tried: set[bytes] = set()
        for k in np.argsort(-around)[: 4 * together]:
            if around[k] <= 1 + gap or len(tried) == together:
                break
            counts = pattern_of(pick, m - int(k) - 1)
            counts[k] += 1
            if counts.tobytes() not in tried:
                tried.add(counts.tobytes())
                enter("pattern", counts, 1.0, counts.astype(float), gap)
        if entered == before:
            break
    return [(kind, column, float(v)) for (kind, column), v in zip(columns, x, strict=True)]


class _Stock:
    """Unpacked pieces by class, as runs of (source class, rank, count, offset)."""

    def __init__(self, demand: np.ndarray):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.left = np.concatenate([[0], demand]).astype(int)
        for k, n in enumerate(demand, 1):
            if n:
                self.runs[k].append((k, 0, int(n), 0))

    def take(self, k: int, n: int) -> list[tuple[int, int, int, int]]:
        self.left[k] -= n
        out = []
        while n:
            source, rank, count, offset = self.runs[k].pop()
            used = min(n, count)
            out.append((source, rank, used, offset))
            if used < count:
                self.runs[k].append((source, rank + used, count - used, offset))
            n -= used
        return out

    def cut(self, k: int, first: int, n: int) -> None:
        for source, rank, count, offset in self.take(k, n):
            for size, at in ((first, offset), (k - first, offset + first)):
                self.runs[size].append((source, rank, count, at))
                self.left[size] += count


def plan(demand: np.ndarray, cut_price: float = 0.02, least_piece: int = 8) -> tuple[list[Slot], int]:
    """Slots for every piece of the histogram, and the number of sequences."""
    m = len(demand)
    stock, slots, used = _Stock(demand), [], 0

    def place(counts: np.ndarray, copies: int) -> None:
        nonlocal used
        for k in np.flatnonzero(counts) + 1:
            first = 0
            for source, rank, count, offset in stock.take(int(k), int(counts[k - 1]) * copies):
                slots.append(Slot(source, rank, rank + count, offset, int(k), used, copies, first % copies))
                first += count
        used += copies

    if demand.sum():
        basis = solve(demand.astype(float), cut_price)
        cuts = sorted(((c, v) for kind, c, v in basis if kind == "cut"), reverse=True)
        for (high, low), v in cuts:  # pieces of a cut are smaller, so larger classes come first
            stock.cut(high, low, min(int(v + 1e-6), stock.left[high]))
        for kind, counts, v in sorted(basis, key=lambda c: -c[2]):
            if kind == "pattern":
                need = np.flatnonzero(counts)
                copies = min(int(v + 1e-6), *(stock.left[need + 1] // counts[need]))
                if copies > 0:
                    place(counts, copies)
    while stock.left.sum():  # what rounding has left: fill the largest first, cut where a gap is worth it
        counts, gap = np.zeros(m, int), m
        while gap:
            fit = np.flatnonzero(stock.left[1 : gap + 1] - counts[:gap] > 0)
            if len(fit):
                k = int(fit[-1]) + 1
                n = min(gap // k, int(stock.left[k] - counts[k - 1]))
                counts[k - 1] += n
                gap -= n * k
                continue
            longer = np.flatnonzero(stock.left[gap + 1 :] - counts[gap:] > 0)
            if gap < least_piece or not len(longer):
                break
            stock.cut(gap + 1 + int(longer[-1]), gap, 1)
        copies = max(1, int(min(stock.left[k + 1] // counts[k] for k in np.flatnonzero(counts))))
        place(counts, copies)
    return slots, used
