"""Fuzzy string ratios (0 to 100) from the longest common subsequence, as Arrow UDFs."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of the longer one, cut at its ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_set(a: str, b: str, of=ratio) -> float:
    """Shared words against each side's own words beside them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (left and right):
        return 100.0
    if of is partial_ratio:
        return 100.0 if both else of(" ".join(left), " ".join(right))
    shared, p, q = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max([of(p, q)] + ([of(shared, p), of(shared, q)] if both else []))


@lru_cache(maxsize=200_000)
def weighted_ratio(a: str, b: str) -> float:
    """Whole, word-sorted and word-set ratios; with partial ones once lengths differ by half."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(ratio(_sorted(a), _sorted(b)), token_set(a, b)))
    scale = 0.9 if longer < 8 else 0.6
    words = max(partial_ratio(_sorted(a), _sorted(b)), token_set(a, b, partial_ratio))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * words)


def _udf(kernel):
    @pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


fuzzy_weighted = _udf(weighted_ratio)
fuzzy_partial = _udf(partial_ratio)
fuzzy_token_set = _udf(token_set)
fuzzy_ratio = _udf(ratio)
