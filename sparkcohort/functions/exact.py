"""Exact null distributions of the rank statistics, for small samples without ties.

They act on the result frame (one row per test), never on measurements: the sample sizes are below 50, so one call is a few
thousand additions in numpy.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_BELOW = 50
SPEARMAN_MOST = 15       # below it: the distribution needs 2^n sets

# Executors need no copy of the package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rank_sum_frequencies(m: int, n: int) -> np.ndarray:
    """Number of ways to get each value 0..m*n of the rank-sum statistic.

    The largest of the m+n observations belongs to either sample, which adds n or nothing to the statistic.
    """
    size = m * n + 1
    rows = [np.eye(1, size)[0] for _ in range(n + 1)]
    for _ in range(m):
        new = [rows[0]]
        for k in range(1, n + 1):
            shifted = np.zeros(size)
            shifted[k:] = rows[k][:size - k]
            new.append(shifted + new[k - 1])
        rows = new
    return rows[n]


def signed_rank_frequencies(n: int) -> np.ndarray:
    """Number of subsets of 1..n with each sum."""
    ways = np.eye(1, n * (n + 1) // 2 + 1)[0]
    for rank in range(1, n + 1):
        shifted = np.zeros_like(ways)
        shifted[rank:] = ways[:-rank]
        ways = ways + shifted
    return ways


def squared_distance_frequencies(n: int) -> np.ndarray:
    """Number of permutations of 1..n with each sum 0..n(n^2-1)/3 of squared distances of the numbers from their places.

    Places are filled in order, and permutations that have used the same numbers are counted together: 2^n sets of numbers.
    """
    size = n * (n * n - 1) // 3 + 1
    layer = {0: np.eye(1, size)[0]}
    for place in range(n):
        new: dict[int, np.ndarray] = {}
        for used, ways in layer.items():
            for number in range(n):
                if not used >> number & 1:
                    step = (number - place) ** 2
                    into = new.setdefault(used | 1 << number, np.zeros(size))
                    into[step:] += ways[:size - step]
        layer = new
    return layer[(1 << n) - 1]


def _two_sided(frequencies: np.ndarray, statistic: float) -> float:
    w = int(round(statistic))
    share = frequencies / frequencies.sum()
    tail = share[w:].sum() if w > (len(frequencies) - 1) / 2 else share[:w + 1].sum()
    return float(min(1.0, 2.0 * tail))


@F.pandas_udf(T.DoubleType())
def rank_sum_exact_p(statistic: pd.Series, n1: pd.Series, n2: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(rank_sum_frequencies(int(a), int(b)), w) if use else None
                      for w, a, b, use in zip(statistic, n1, n2, wanted)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_exact_p(statistic: pd.Series, n: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(signed_rank_frequencies(int(a)), v) if use else None
                      for v, a, use in zip(statistic, n, wanted)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def spearman_exact_p(squares: pd.Series, n: pd.Series, wanted: pd.Series) -> pd.Series:
    ways = {int(k): squared_distance_frequencies(int(k)) for k in n[wanted.eq(True)].unique()}
    return pd.Series([_two_sided(ways[int(k)], v) if use else None for v, k, use in zip(squares, n, wanted)], dtype="float64")
