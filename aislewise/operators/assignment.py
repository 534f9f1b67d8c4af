"""Optimal assignment of the few rows of one group (M1, M2): the kernel of the matching operators."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost assignment of min(n, m) pairs, by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    price_row, price_col, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, via, done, row, last = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), start, -1
        shift = 0.0
        while True:  # grow the tree of tight edges until it meets a free column
            slack = shift + cost[row] - price_row[row] - price_col
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], last
            column = int(np.where(done, np.inf, reach).argmin())
            shift = reach[column]
            done[column] = True
            last = column
            if owner[column] < 0:
                break
            row = owner[column]
        price_row[start] += shift
        for c in np.flatnonzero(done):
            if c != column:
                price_row[owner[c]] += shift - reach[c]
                price_col[c] -= shift - reach[c]
        while column >= 0:  # flip the path
            before = via[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def most_pairs_least_distance(distance: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """As many allowed pairs as possible, and of those sets one with the smallest summed distance."""
    if not allowed.any():
        return []
    apart = (float(distance[allowed].max()) + 1) * (min(allowed.shape) + 1)
    rows, cols = assign(np.where(allowed, distance, apart))
    return [(int(r), int(c)) for r, c in zip(rows, cols) if allowed[r, c]]


def heaviest_total(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest one-to-one matching of weighted pairs (M10), one connected group of ends at a time."""
    _, a = np.unique(left, return_inverse=True)
    _, b = np.unique(right, return_inverse=True)
    label = np.arange(a.max(initial=-1) + 1)
    while True:  # the smallest left end that is reachable
        of_right = np.full(b.max(initial=-1) + 1, len(label))
        np.minimum.at(of_right, b, label[a])
        low = label.copy()
        np.minimum.at(low, a, of_right[b])
        if (low == label).all():
            break
        label = low
    order = np.argsort(label[a], kind="stable")
    total = 0.0
    for group in np.split(order, np.flatnonzero(np.diff(label[a][order])) + 1) if len(order) else []:
        rows, i = np.unique(a[group], return_inverse=True)
        cols, j = np.unique(b[group], return_inverse=True)
        table = np.zeros((len(rows), len(cols)))
        np.add.at(table, (i, j), weight[group])
        total += table[assign(-table)].sum()
    return total


def in_order(a: np.ndarray, b: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a matching of the sorted times a and b with -before <= b[j] - a[i] <= after (M2).

    It has as many pairs as possible and of those the least sum of distances. Crossing pairs can be swapped without a
    loss, as every row has the same window, so a table over both in order is enough, and row i of it only changes for the
    partners in i's window. ValueError where the totals of so many pairs and so wide a window exceed 62 bits.
    """
    pairs = min(len(a), len(b))
    weight = pairs * max(before, after, 0) + 1  # one pair more goes before any distances
    if pairs * weight >= 1 << 62:
        raise ValueError(f"{pairs} pairs in one cluster are too many for windows of {max(before, after)}")
    pair = np.int64(weight)
    low, high = np.searchsorted(b, a - before, "left"), np.searchsorted(b, a + after, "right")
    best, first = np.zeros(1, np.int64), 0  # best[k]: value of the rows so far with the partners before first + k
    taken: list[np.ndarray] = []
    for i in range(len(a)):
        if high[i] - first >= len(best):  # no row so far reaches these partners
            best = np.concatenate([best, np.full(high[i] - first - len(best) + 1, best[-1])])
        best, first = best[low[i] - first :], low[i]  # later rows reach no earlier partner
        with_pair = best[:-1] + pair - np.abs(b[low[i] : first + len(best) - 1] - a[i])
        with_pair[high[i] - low[i] :] = -1
        new = np.maximum.accumulate(np.maximum(best, np.concatenate([best[:1], with_pair])))
        gains = np.concatenate([[False], (with_pair > best[1:]) & (with_pair == new[1:]) & (new[1:] > new[:-1])])
        # where the row's own pair makes the value, the last such partner up to k is the one to take
        at = np.maximum.accumulate(np.where(gains, np.arange(len(new)), 0))
        taken.append(np.where(new > best, at, 0).astype(np.int32))
        best = new
    rows, cols, k = [], [], len(b)
    for i in range(len(a) - 1, -1, -1):
        here = min(k - low[i], len(taken[i]) - 1)
        if here > 0 and taken[i][here]:
            k = low[i] + int(taken[i][here]) - 1
            rows.append(i)
            cols.append(k)
    return np.array(rows[::-1], np.int64), np.array(cols[::-1], np.int64)
