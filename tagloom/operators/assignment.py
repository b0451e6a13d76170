"""Best assignment of rows to columns by shortest augmenting paths."""

from __future__ import annotations

import numpy as np


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest sum of ``scores``: each row of the smaller
    side is assigned, each column at most once. Negative scores count like all others."""
    rows, cols = scores.shape
    if not rows or not cols:
        return []
    if rows > cols:
        return sorted((r, c) for c, r in best_assignment(scores.T))
    cost = -np.asarray(scores, float)
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        reach = np.full(cols, np.inf)  # cheapest known path to each column
        came = np.full(cols, -1)  # column before it on that path
        done = np.zeros(cols, bool)
        row, last, length = start, -1, 0.0
        while True:
            through = length + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], came[better] = through[better], last
            last = int(np.where(done, np.inf, reach).argmin())
            length = reach[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        # prices along the searched tree keep reduced costs non-negative
        inside = np.flatnonzero(done)
        gain = length - reach[inside]
        assigned = owner[inside] >= 0
        row_price[owner[inside][assigned]] += gain[assigned]
        row_price[start] += length
        col_price[inside] -= gain
        while last >= 0:
            before = came[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    return sorted((int(owner[c]), c) for c in range(cols) if owner[c] >= 0)
