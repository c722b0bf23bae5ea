"""Jaro-Winkler similarity (F9), a small per-pair helper.

Standard definition: characters match within a window of
``max(len) // 2 - 1``; ``t`` is half the number of matched characters out of
order (integer half); the Winkler boost adds ``0.1 * prefix * (1 - jaro)``
for a common prefix of at most four characters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Winkler prefix scale and cap; similarity threshold (strict)
# and the rounding applied before comparing with it.
PREFIX_SCALE = 0.1
PREFIX_CAP = 4
THRESHOLD = 0.85
ROUND_DIGITS = 12


def jaro(a: str, b: str) -> float:
    la, lb = len(a), len(b)
    if la == 0 and lb == 0:
        return 1.0
    if la == 0 or lb == 0:
        return 0.0
    window = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    a_hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(lb, i + window + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                a_hits.append(ch)
                break
    m = len(a_hits)
    if m == 0:
        return 0.0
    b_hits = [b[j] for j in range(lb) if used[j]]
    half_t = sum(x != y for x, y in zip(a_hits, b_hits)) // 2
    return (m / la + m / lb + (m - half_t) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    p = 0
    for x, y in zip(a[:PREFIX_CAP], b[:PREFIX_CAP]):
        if x != y:
            break
        p += 1
    return j + PREFIX_SCALE * p * (1.0 - j)


def is_similar(score: float) -> bool:
    return round(score, ROUND_DIGITS) > THRESHOLD


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
