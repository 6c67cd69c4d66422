"""Edit-based scores of many short pairs of strings at once: the loops are over places of letters, each step is one of all pairs.

Common subsequences come from combing (Tiskin's semi-local LCS): strands that enter a grid of two strings' letters at its left and
top cross each other once at most and never where letters match. The strands that end at the bottom tell the longest common
subsequence of the first string with each part of the second one, so a best window needs no comparison of its own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Longest string: strands of both sides are numbered in a byte. Pairs of one step, and how few are scored one by one.
SHORT, STEP, FEW = 120, 4096, 48


def lengths(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([list(map(len, a)), list(map(len, b))], np.int64)


def scored(one: Callable, many: Callable, a: list[str], b: list[str], known: list[bool] | None, value: float) -> np.ndarray:
    """The score of each pair: `value` where known, `many` for those of short strings, `one` for the others and for few."""
    out = np.full(len(a), value, np.float64)
    longest = lengths(a, b).max(axis=0, initial=0)
    left = np.arange(len(a)) if known is None else np.flatnonzero(~np.array(known, bool))
    short = left[longest[left] <= SHORT]
    short = short[np.argsort(longest[short], kind="stable")]  # pairs of a step are filled up to its longest string
    for begin in range(0, len(short), STEP):
        at = short[begin : begin + STEP]
        if len(at) < FEW:
            left = np.concatenate([at, left[longest[left] > SHORT]])
            break
        out[at] = many([a[i] for i in at], [b[i] for i in at])
    else:
        left = left[longest[left] > SHORT]
    for i in left.tolist():
        out[i] = one(a[i], b[i])
    return out


def letters(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each place, a column for each pair. What is filled up matches nothing."""
    sides = []
    for x in (a, b):
        size = np.array(list(map(len, x)))
        n = max(1, size.max(initial=0))
        c = np.array(x, f"U{n}").view(np.uint32).reshape(len(x), n).T
        sides.append((c, np.arange(n)[:, None] >= size))
    kind = np.uint8 if max(c.max(initial=0) for c, _ in sides) < 254 else np.uint32
    most = np.iinfo(kind).max
    return tuple(np.where(beyond, kind(most - k), c.astype(kind)) for k, (c, beyond) in enumerate(sides))


def comb(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of b the strand that ends below it; the strand that begins above place j has the number len(a) + j."""
    m, n, count = len(a), len(b), a.shape[1]
    ends = np.repeat(np.arange(m, m + n, dtype=np.uint8)[:, None], count, axis=1)
    low, high, turn, across = (np.empty(count, np.uint8) for _ in range(4))
    for i in range(m):
        across.fill(m - 1 - i)
        match = np.negative((a[i] == b).view(np.uint8))
        for j in range(n):
            down = ends[j]
            np.minimum(across, down, out=low)
            np.maximum(across, down, out=high)
            np.bitwise_xor(low, down, out=turn)
            np.bitwise_and(turn, match[j], out=turn)
            np.bitwise_xor(low, turn, out=across)
            np.bitwise_xor(high, turn, out=down)
    return ends


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    x, y = letters(a, b)
    return len(y) - (comb(x, y) >= len(x)).sum(axis=0, dtype=np.int64)


def best_windows(a: list[str], b: list[str]) -> np.ndarray:
    """The best of 2 * common / (letters of both) of the shorter string with a part of the longer one that is no longer than it; of
    equally long ones both ways. No string is empty."""
    a, b = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)))
    out = windows(list(a), list(b))
    even = [i for i, (x, y) in enumerate(zip(a, b)) if len(x) == len(y)]
    if even:
        out[even] = np.maximum(out[even], windows([b[i] for i in even], [a[i] for i in even]))
    return out


def windows(short: list[str], long: list[str]) -> np.ndarray:
    x, y = letters(short, long)
    ends, m, n = comb(x, y), len(x), len(y)
    size, whole = lengths(short, long)
    inside = np.arange(n)[:, None] < size  # of a window from its first place on
    best = np.zeros(len(short))
    for l in range(n):  # noqa: E741
        # from l on, up to the short string's length; what is beyond the end matches nothing
        lost = ((ends[l:] >= m + l) & inside[: n - l]).sum(axis=0, dtype=np.uint8)
        met = np.minimum(size, n - l) - lost
        own = np.minimum(size, whole - l)
        np.maximum(best, np.where(own > 0, 2 * met / np.maximum(size + own, 1), 0.0), out=best)
    # parts before the first whole window
    met = np.zeros(len(short), np.int64)
    for r in range(n):
        met += ends[r] < m
        np.maximum(best, np.where(r + 1 < size, 2 * met / (size + r + 1), 0.0), out=best)
    return best


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Of strings that aren't equal."""
    x, y = letters(a, b)
    m, n, count = len(x), len(y), len(a)
    size_a, size_b = lengths(a, b)
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0).astype(np.int16)
    near = np.abs(np.arange(-m + 1, n)[:, None]) <= reach  # by j - i
    free, met = np.ones((n, count), bool), np.zeros((m, count), bool)
    hit = np.empty(count, bool)
    widest = int(reach.max(initial=0))
    for i in range(m):
        equal, open_ = x[i] == y, np.ones(count, bool)
        for j in range(max(0, i - widest), min(n, i + widest + 1)):
            np.logical_and(equal[j], free[j], out=hit)
            hit &= near[j - i + m - 1]
            hit &= open_
            open_ ^= hit
            free[j] ^= hit
        np.logical_not(open_, out=met[i])
    order = []
    for c, used in ((x, met), (y, ~free)):
        out, at = np.zeros((min(m, n) + 1, count), c.dtype), np.zeros(count, np.int64)
        for i in range(len(c)):
            who = np.flatnonzero(used[i])
            out[at[who], who] = c[i, who]
            at[who] += 1
        order.append(out)
    k = met.sum(axis=0)
    moved = (order[0] != order[1]).sum(axis=0) // 2
    some = np.maximum(k, 1)
    jaro = np.where(k > 0, (k / np.maximum(size_a, 1) + k / np.maximum(size_b, 1) + (k - moved) / some) / 3, 0.0)
    least = min(m, n, 4)
    prefix = np.logical_and.accumulate(x[:least] == y[:least], axis=0).sum(axis=0)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
