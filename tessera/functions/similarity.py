"""String similarities.

Set and number comparisons are built-in expressions. The edit-based scores have no built-in form; they are Arrow functions that
score each distinct pair of a batch once. Each has a plain form for one pair, with longest common subsequences from one big-integer
row (bit-parallel), and one for many short pairs at once (batch.py), which gives the same values."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import batch
from tessera.functions.text import tokens


def places(a: str) -> dict[str, int]:
    """For each letter a number with the bits of its places."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of b and the string of that size that the masks stand for."""
    full = (1 << size) - 1
    row = full
    for x in b:
        if met := row & masks.get(x, 0):
            row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return common(places(a), len(a), b) if a and b else 0


def indel(a: str, b: str) -> float:
    """1 for equal strings, also empty ones; else twice the common subsequence over both lengths."""
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


def ratio(a: str, b: str) -> float:
    return 100 * indel(a, b)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer, no longer than itself."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    best = best_window(a, b)
    return 100 * (max(best, best_window(b, a)) if len(a) == len(b) else best)


def best_window(short: str, long: str) -> float:
    m, masks = len(short), places(short)
    known = [0]  # letters of the short string in each prefix of the long one: no window has more in common
    for x in long:
        known.append(known[-1] + (x in masks))
    best = 0.0
    for end in range(1, len(long) + m):
        start, stop = max(0, end - m), min(end, len(long))
        edge = long[stop - 1] if end <= len(long) else long[start]
        if (edge in masks or end == len(long)) and 2 * (known[stop] - known[start]) > best * (m + stop - start):
            best = max(best, 2 * common(masks, m, long[start:stop]) / (m + stop - start))
    return best


def by_tokens(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(by_tokens(a), by_tokens(b))


def token_parts(a: str, b: str) -> tuple[str, str, str]:
    """Common tokens and those of either side alone, each sorted and joined."""
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = token_parts(a, b)
    if both and (not left or not right):
        return 100.0
    whole = [f"{both} {x}".strip() for x in (left, right)]
    return 100 * max([indel(*whole), *(indel(both, x) for x in whole if both)])


def partial_token_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = token_parts(a, b)
    return 100.0 if both else max(partial_ratio(by_tokens(a), by_tokens(b)), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, scaled by how much the lengths differ."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if lengths < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """1 for equal strings; prefix weight 0.1 over at most four characters, above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    met = []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == x), None)
        if j is not None:
            used[j] = True
            met.append(x)
    if not met:
        return 0.0
    other = [x for j, x in enumerate(b) if used[j]]
    moved = sum(x != y for x, y in zip(met, other)) // 2
    m = len(met)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(prefix, 4) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


Strings = list[str]

#: by_tokens() and the tokens of a text that many pairs have.
ordered = lru_cache(1 << 14)(by_tokens)
words_of = lru_cache(1 << 14)(lambda x: frozenset(x.split()))


def many_ratios(a: Strings, b: Strings) -> np.ndarray:
    def score(a: Strings, b: Strings) -> np.ndarray:
        return 100 * (2 * batch.common(a, b) / batch.lengths(a, b).sum(axis=0))

    return batch.scored(ratio, score, a, b, [x == y for x, y in zip(a, b)], 100.0)


def many_partial_ratios(a: Strings, b: Strings) -> np.ndarray:
    known = [x in y or y in x for x, y in zip(a, b)]  # an empty string is in any, but only in another empty one for 100
    out = batch.scored(partial_ratio, lambda a, b: 100 * batch.best_windows(a, b), a, b, known, 100.0)
    out[[bool(x) != bool(y) for x, y in zip(a, b)]] = 0.0
    return out


def many_token_sort_ratios(a: Strings, b: Strings) -> np.ndarray:
    return many_ratios([ordered(x) for x in a], [ordered(x) for x in b])


def many_token_set_ratios(a: Strings, b: Strings) -> np.ndarray:
    """The tokens in common are a prefix of either side; so they are counted, and the rest is compared."""
    out, at, left, right, before = np.zeros(len(a)), [], [], [], []
    for i, (x, y) in enumerate(zip(map(words_of, a), map(words_of, b))):
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 100.0
        elif x and y:
            at.append(i)
            left.append(" ".join(sorted(x - both)))
            right.append(" ".join(sorted(y - both)))
            before.append(sum(map(len, both)) + len(both) if both else 0)  # with a space behind each
    if at:
        same, own = np.array(before), batch.lengths(left, right)
        rest = batch.scored(lcs, batch.common, left, right, None, 0)
        whole = 2 * (same + rest) / (own + same).sum(axis=0)
        alone = 2 * (same - 1) / np.maximum(same - 1 + own + same, 1)
        out[at] = 100 * np.where(same > 0, np.maximum(whole, alone.max(axis=0)), whole)
    return out


def many_partial_token_ratios(a: Strings, b: Strings) -> np.ndarray:
    out, at = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(map(words_of, a), map(words_of, b))):
        if x & y:
            out[i] = 100.0
        elif x and y:
            at.append(i)
    if at:
        x, y = [a[i] for i in at], [b[i] for i in at]
        alone = [[" ".join(sorted(words_of(t))) for t in side] for side in (x, y)]
        out[at] = np.maximum(many_partial_ratios([ordered(t) for t in x], [ordered(t) for t in y]), many_partial_ratios(*alone))
    return out


def many_weighted_ratios(a: Strings, b: Strings) -> np.ndarray:
    sizes = batch.lengths(a, b)
    least, most = sizes.min(axis=0), sizes.max(axis=0)
    lengths = most / np.maximum(least, 1)
    plain = many_ratios(a, b)
    out = np.zeros(len(a))
    near, far = np.flatnonzero((least > 0) & (lengths < 1.5)), np.flatnonzero((least > 0) & (lengths >= 1.5))
    of = lambda f, at: f([a[i] for i in at], [b[i] for i in at])
    if len(near):
        out[near] = np.maximum(plain[near], 0.95 * np.maximum(of(many_token_sort_ratios, near), of(many_token_set_ratios, near)))
    if len(far):
        scale = np.where(lengths[far] <= 8, 0.9, 0.6)
        out[far] = np.maximum(plain[far], np.maximum(scale * of(many_partial_ratios, far), 0.95 * scale * of(many_partial_token_ratios, far)))
    return out


def many_jaro_winklers(a: Strings, b: Strings) -> np.ndarray:
    return batch.scored(jaro_winkler, batch.jaro_winklers, a, b, [x == y for x, y in zip(a, b)], 1.0)


def scorer(many: Callable[[Strings, Strings], np.ndarray]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        places: dict[tuple[str, str], int] = {}
        at = [places.setdefault(pair, len(places)) for pair in zip(a.fillna(""), b.fillna(""))]
        if not at:
            return pd.Series([], dtype="float64")
        return pd.Series(many([x for x, _ in places], [y for _, y in places])[at])

    return score


SCORERS = {
    "ratio": scorer(many_ratios),
    "partial_ratio": scorer(many_partial_ratios),
    "token_sort_ratio": scorer(many_token_sort_ratios),
    "token_set_ratio": scorer(many_token_set_ratios),
    "weighted_ratio": scorer(many_weighted_ratios),
    "jaro_winkler": scorer(many_jaro_winklers),
}


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; null if a is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def flag(c: Column) -> Column:
    return c.cast("byte")


def legal_state(a: Column, b: Column) -> Column:
    """0 neither side has a form, 1 one has, 2 equal, 3 overlapping, 4 apart. a, b: arrays."""
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    same = F.array_sort(a) == F.array_sort(b)
    return flag(F.when(none_a & none_b, 0).when(none_a | none_b, 1).when(same, 2).when(F.arrays_overlap(a, b), 3).otherwise(4))


def affixed(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)


def house_features(a: Column, b: Column) -> dict[str, Column]:
    """Equal, absent (1 on one side, 2 on both), prefix or suffix, difference of numbers under ten digits."""
    present = (a != "") & (b != "")
    short = (F.length(a) < 10) & (F.length(b) < 10)
    return {
        "h_eq": flag(present & (a == b)),
        "h_absent": flag(F.when(present, 0).when((a == "") & (b == ""), 2).otherwise(1)),
        "h_pref": flag(present & (a != b) & affixed(a, b)),
        "h_diff": F.when(present & short, F.abs(a.try_cast("long") - b.try_cast("long")).cast("double")),
    }


def three_way(a: Column, b: Column) -> Column:
    """0 if either is missing, 1 equal, 2 different."""
    return flag(F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(2))


def number_relation(a: Column, b: Column) -> Column:
    """0 equal, 1 equal but for leading zeros, 2 prefix or suffix, 3 one edit, 4 unrelated."""
    zero = F.lit("0")
    padded = F.ltrim(a, zero) == F.ltrim(b, zero)
    return flag(F.when(a == b, 0).when(padded, 1).when(affixed(a, b), 2).when(F.levenshtein(a, b) <= 1, 3).otherwise(4))


TYPO = 0.88


def align(a: list[str], b: list[str], alike: Callable[[str, str], float] = jaro_winkler) -> tuple[list[str], list[str], int, int]:
    """Tokens of a without a partner, tokens of b without one, equal partners, partners that are typos of each other.

    Each token of a in turn takes an equal token of b, else the most alike one (the first of equals) from TYPO up."""
    left, missing, equal, typos = list(b), [], 0, 0
    for t in a:
        if t in left:
            left.remove(t)
            equal += 1
            continue
        best, near = TYPO, None
        for u in left:
            if (x := alike(t, u)) > best or near is None and x >= TYPO:
                best, near = x, u
        if near is not None:
            left.remove(near)
            typos += 1
        else:
            missing.append(t)
    return missing, left, equal, typos


def aligned(pairs: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> list[tuple[list[str], list[str], int, int]]:
    """align() of each pair; the likeness of each two tokens that may be compared is computed once."""
    met: dict[tuple[str, str], float] = {}
    for a, b in pairs:
        for t in a:
            if t not in b:
                for u in b:
                    met[t, u] = 0.0
    if met:
        met = dict(zip(met, many_jaro_winklers([t for t, _ in met], [u for _, u in met]).tolist()))
    alike = lambda t, u: met[t, u] if (t, u) in met else jaro_winkler(t, u)
    return [align(list(a), list(b), alike) for a, b in pairs]


ALIGNED = T.StructType([T.StructField(x, T.ArrayType(T.StringType())) for x in ("missing", "extra")] + [T.StructField(x, T.IntegerType()) for x in ("n_exact", "n_typo")])


@F.pandas_udf(ALIGNED)
def alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Greedy alignment of two columns of token arrays."""
    places: dict[tuple, int] = {}
    at = [places.setdefault((tuple(x) if x is not None else (), tuple(y) if y is not None else ()), len(places)) for x, y in zip(a, b)]
    rows = aligned(list(places))
    return pd.DataFrame([rows[i] for i in at], columns=["missing", "extra", "n_exact", "n_typo"])
