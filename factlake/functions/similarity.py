"""Similarities of strings from 0 to 100, as pandas UDFs over Arrow batches.

ratio: twice the longest common subsequence over both lengths. token_sort: of the words in
order. token_set: the best of the shared words and each side's rest. partial: the best ratio
of the shorter string with a piece of the longer one as long as it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 100.0
    one, other = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    return max([ratio_of(one, other), *((ratio_of(shared, one), ratio_of(shared, other)) if shared else ())])


def partial_of(a: str, b: str) -> float:
    a, b = sorted((a, b), key=len)
    return max(ratio_of(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)) if a else 0.0


def _udf(one):
    @F.pandas_udf(DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])

    return similarity


ratio, token_sort, token_set, partial = (_udf(f) for f in (ratio_of, token_sort_of, token_set_of, partial_of))
