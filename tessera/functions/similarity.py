"""String similarity on Arrow batches; each distinct pair of a batch is compared once.

ratio is 200*LCS/(len1+len2) (100 for two empty strings); token_sort compares sorted tokens; token_set is 100 if one
token set holds the other and 0 if either is empty; partial is the best window of the longer string; jaro_winkler is in
[0, 1] with a prefix weight of 0.1. A null on either side gives null.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u) | (v - u)
    return (~v & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    xs, ys = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    one, two = (f"{both} {r}".strip() for r in (xs, ys))
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


def partial(a: str, b: str) -> float:
    """The best window of the longer text; windows that can't beat the best by their letters alone are not compared."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    if short in long_:
        return 100.0
    n, have, best = len(short), Counter(short), 0.0
    for at in range(1 - n, len(long_)):
        lo, hi = max(0, at), min(len(long_), at + n)
        common = sum((have & Counter(long_[lo:hi])).values())
        if 200.0 * common / (n + hi - lo) > best:
            best = max(best, ratio(short, long_[lo:hi]))
    return best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _column(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memory: dict = {}
        out = np.full(len(a), np.nan, object)
        for i, pair in enumerate(zip(a, b)):
            if pair[0] is None or pair[1] is None:
                out[i] = None
                continue
            if pair not in memory:
                memory[pair] = fn(*pair)
            out[i] = memory[pair]
        return pd.Series(out)

    def call(a: Column, b: Column) -> Column:
        return run(a, b)

    return call


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf = map(_column, (ratio, token_sort, token_set, partial, jaro_winkler))


def distinct_pairs(t: DataFrame, a: str, b: str, scores: dict) -> DataFrame:
    """Each distinct pair of texts once with its scores, to be joined back: repeated pairs cost no comparison."""
    return t.select(a, b).distinct().withColumns({name: fn(F.col(a), F.col(b)) for name, fn in scores.items()})
