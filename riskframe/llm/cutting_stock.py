"""Cutting-stock plan over a histogram of sizes (numpy, driver side).

Works on the histogram alone: at most ``capacity`` sizes, whatever the number of
documents. A linear program chooses how often each pattern (a multiset of sizes
that fits in one sequence) is used; a knapsack dynamic program prices new
patterns from the dual values; the solution is rounded down and the rest packed
first-fit with the largest sizes first.
"""

from __future__ import annotations

import numpy as np


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of the largest total worth: unbounded knapsack by dynamic
    programming over the capacity. ``sizes`` ascend."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            gain = best[c - sizes[:k]] + worth[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return pattern, float(best[capacity])


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4,
          rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation with a revised simplex: (patterns by row, uses).

    Ends when the sequences used are within half a sequence or the relative
    ``gap`` of Farley's lower bound. Every basis on the way covers the demand
    exactly, so ``rounds`` bounds the time, not the result's completeness.
    """
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(patterns))
    uses = inverse @ demand
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        column, value = best_pattern(sizes, worth, capacity)
        used = uses.sum()
        if value <= 1 + 1e-9 or used - worth @ demand / value < max(0.5, gap * used):
            break
        step = inverse @ column
        grow = step > 1e-9
        if not grow.any():
            break
        ratio = np.full(m, np.inf)
        ratio[grow] = uses[grow] / step[grow]
        out = int(ratio.argmin())
        patterns[out] = column
        pivot = inverse[out] / step[out]
        t = ratio[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        uses = np.maximum(uses - step * t, 0)
        uses[out] = t
    return patterns.astype(np.int64), uses


def first_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of one sequence each that hold the counted sizes."""
    free = np.empty(0, np.int64)
    held: list[np.ndarray] = []
    for i in np.argsort(-sizes):
        left = int(counts[i])
        for j in np.flatnonzero(free >= sizes[i]):
            n = min(left, int(free[j] // sizes[i]))
            held[j][i] += n
            free[j] -= n * sizes[i]
            left -= n
            if not left:
                break
        per = int(capacity // sizes[i])
        new = []
        while left:
            n = min(left, per)
            p = np.zeros(len(sizes), np.int64)
            p[i] = n
            held.append(p)
            new.append(capacity - n * sizes[i])
            left -= n
        free = np.concatenate([free, np.array(new, np.int64)])
    return held


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern as pairs of size and count, uses) that together hold every
    counted size exactly once."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    patterns, uses = solve(sizes, demand.astype(float), capacity)
    whole = np.floor(uses + 1e-9).astype(np.int64)
    while (over := whole @ patterns > demand).any():     # rounding noise
        whole[np.flatnonzero((patterns[:, over] > 0).any(axis=1) & (whole > 0))] -= 1
    out = [(p, int(n)) for p, n in zip(patterns, whole) if n]
    rest: dict[bytes, int] = {}
    for p in first_fit_decreasing(sizes, demand - whole @ patterns, capacity):
        rest[p.tobytes()] = rest.get(p.tobytes(), 0) + 1
    out += [(np.frombuffer(p, np.int64), n) for p, n in rest.items()]
    return [(np.stack([sizes[p > 0], p[p > 0]], axis=1), n) for p, n in out]
