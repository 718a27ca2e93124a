"""Cutting stock: how many sequences of which lengths hold a histogram of pieces without any padding.

A pattern is a multiset of lengths that fills a sequence exactly, whose size is the capacity or a
smaller power of two (such sequences are not padded). The linear program asks how often
to use each pattern so that the most tokens lie in whole pieces. There are far too many
patterns to list, so they are made as the simplex method asks for them: given its prices
of lengths, a knapsack dynamic program finds the pattern worth most beyond them.

All sizes here are bounded by the capacity (rows of the program, basis, knapsack), whatever
the number of documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: What a sequence costs, in tokens: among patterns as good, fewer and longer sequences win.
SEQUENCE_COST = 1.0
#: Among patterns worth about as much: what a piece costs, and what one of a scarce length costs more (over 1 plus the pieces not yet covered), as shares of the capacity, so that patterns are of few pieces and usable often.
PIECE_COST, SCARCE_COST = 0.5 / 1024, 5 / 1024
EPSILON = 1e-7
#: Most rounds of the simplex method for each length.
ROUNDS = 4


def fills(capacity: int) -> list[int]:
    """The sizes of sequences that need no padding."""
    return [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity] + [capacity]


def dearest_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The exactly full pattern that is worth most beyond its prices, and by how much (counts of each size)."""
    least, choice = np.full(capacity + 1, np.inf), np.zeros(capacity + 1, np.int64)
    least[0] = 0
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        if k := upto[c]:
            own = least[c - sizes[:k]] + prices[:k]
            choice[c] = i = own.argmin()
            least[c] = own[i]
    gain, full = max((c - SEQUENCE_COST - float(least[c]), c) for c in fills(capacity))
    pattern = np.zeros(len(sizes))
    if np.isfinite(gain):
        while full:
            pattern[choice[full]] += 1
            full -= int(sizes[choice[full]])
    return gain, pattern


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, left_over: float = 4e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each (not rounded), by column generation.

    Ends when no pattern gains, when no more than a share ``left_over`` of the tokens
    lies in no pattern, or after ``ROUNDS`` rounds a length: what is left is cut, and padded no more.
    """
    m, tokens = len(sizes), float(sizes @ counts)
    inverse, amount, value = np.eye(m), counts.astype(float), np.zeros(m)
    basis: list[np.ndarray | None] = [None] * m
    alone = np.arange(m)  # the length that a row of the basis leaves uncovered, or -1
    for _ in range(ROUNDS * m):
        prices = value @ inverse
        if (worst := int(prices.argmin())) >= 0 and prices[worst] < -EPSILON:
            entering, column, worth, own = None, inverse[:, worst].copy(), 0.0, worst  # a length goes uncovered again
        else:
            spare = np.zeros(m)
            spare[alone[alone >= 0]] = amount[alone >= 0]
            prices = np.maximum(prices, 0)
            gain, pattern = dearest_pattern(sizes, prices + capacity * (PIECE_COST + SCARCE_COST / (1 + spare)), capacity)
            if gain <= 0:
                gain, pattern = dearest_pattern(sizes, prices, capacity)
                if gain <= EPSILON * capacity:
                    break
            entering, column, worth, own = pattern, inverse @ pattern, float(sizes @ pattern) - SEQUENCE_COST, -1
        ratio = np.where(column > EPSILON, amount / np.where(column > EPSILON, column, 1), np.inf)
        out = int(ratio.argmin())
        step = max(0.0, ratio[out])
        amount -= step * column
        np.maximum(amount, 0, out=amount)
        amount[out] = step
        inverse[out] /= column[out]
        column[out] = 0
        inverse -= np.outer(column, inverse[out])
        basis[out], value[out], alone[out] = entering, worth, own
        if float(sizes[alone[alone >= 0]] @ amount[alone >= 0]) <= left_over * tokens:
            break
    return [(p, float(x)) for p, x in zip(basis, amount, strict=True) if p is not None and x > EPSILON]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (count of each size) and whole numbers of times; no size is used more often than it is there."""
    if not counts:
        return []
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    used: Counter[int] = Counter()
    found = solve(sizes, left, capacity)
    patterns = [p.astype(np.int64) for p, _ in found]
    for k, (_, x) in enumerate(found):
        times = int(np.where(patterns[k] > 0, left // np.maximum(patterns[k], 1), left.max(initial=0) + 1).min())  # x may be too large by a rounding error
        used[k] = min(int(x + EPSILON), times)
        left -= used[k] * patterns[k]
    for k in sorted(range(len(found)), key=lambda k: (-(found[k][1] % 1), k)):
        if (patterns[k] <= left).all():  # round up where there is enough
            left -= patterns[k]
            used[k] += 1
    for k in range(len(found)):  # what rounding left
        if more := int(np.where(patterns[k] > 0, left // np.maximum(patterns[k], 1), left.max() + 1).min()):
            left -= more * patterns[k]
            used[k] += more
    return [({int(s): int(c) for s, c in zip(sizes, patterns[k], strict=True) if c}, n) for k, n in sorted(used.items()) if n]
