"""Token-set similarity of phrases, 0 to 100, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: bits of a word for each place of `a`."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best agreement of shared words and rests, with insertions and deletions only. Empty sides score 0, a subset scores 100."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, rest_x, rest_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (rest_x and rest_y):
        return 100.0
    gap = len(shared) > 0
    long_x, long_y = (len(shared) + gap + len(r) for r in (rest_x, rest_y))
    apart = len(rest_x) + len(rest_y) - 2 * common_subsequence(rest_x, rest_y)
    scores = [1 - apart / (long_x + long_y)]
    if shared:
        scores += [1 - (gap + len(r)) / (len(shared) + whole) for r, whole in ((rest_x, long_x), (rest_y, long_y))]
    return 100.0 * max(scores)


def similarity(a: Column, b: Column) -> Column:
    score = lambda x, y: pd.Series([token_set_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")
    score.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(a, b)
