"""Linear assignment in NumPy: shortest augmenting paths with potentials."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of an assignment of least cost; each row (or column, if there are fewer) is assigned once."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, base = row, -1, 0.0
        while True:
            reduced = base + cost[i] - u[i] - v
            closer = ~done & (reduced < dist)
            dist[closer], came[closer] = reduced[closer], j
            j = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[j] = dist[j], True
            if owner[j] < 0:
                break
            i = owner[j]
        settled = done & (dist < base)
        v[settled] -= base - dist[settled]
        u[row] += base
        u[owner[settled]] += base - dist[settled]
        while j >= 0:
            before = came[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]
