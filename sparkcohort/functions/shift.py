"""Exact null distributions of the rank statistics with ties, by the shift algorithm, in halves that run as tasks of their own.

With tied ranks the statistic is a sum of doubled mid-ranks, which are whole numbers.  Taking one more observation into a
sample of k shifts the distribution of k - 1 by its rank, so the distribution of the sum over all samples grows one
observation at a time.  A test's observations are cut in two halves in rank order; each half is a row of work, and one row per
sample size of the first half joins what both give.  Distributions are kept as shares (halved with every observation), only over
sums that can occur: a half of m observations holds at most about m^3 / 3 numbers for the rank sum and m^2 for signed ranks.

Tests of small strata run where their rows are sorted (``stratum_tests``), many to a batch.  Their p-value follows from how many
observations each distinct value has and the size of the first sample, so a task makes the distribution of a short list once.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.session import spread

# Executors need no copy of the package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Banded = tuple[int, np.ndarray]


def doubled_mid_ranks(ties: list[int]) -> np.ndarray:
    """Twice the mid-rank of every observation in order, from the number of observations of each distinct value."""
    t = np.asarray(ties, np.int64)
    return np.repeat(2 * (np.cumsum(t) - t) + t + 1, t)


def _sum(a: Banded | None, b: Banded | None) -> Banded | None:
    if a is None or b is None:
        return a if b is None else b
    low = min(a[0], b[0])
    out = np.zeros(max(a[0] + len(a[1]), b[0] + len(b[1])) - low)
    for base, share in (a, b):
        out[base - low:base - low + len(share)] += share
    return low, out


def sample_sums(ranks: np.ndarray, most: int) -> list[Banded | None]:
    """For k = 0..most: shares of the samples of k among all 2^m samples by the sum of their ranks, as (least sum, shares)."""
    rows: list[Banded | None] = [(0, np.ones(1))] + [None] * min(most, len(ranks))
    for rank in ranks:
        for k in range(len(rows) - 1, -1, -1):
            shifted = (rows[k - 1][0] + int(rank), rows[k - 1][1] * 0.5) if k and rows[k - 1] is not None else None
            stays = None if rows[k] is None else (rows[k][0], rows[k][1] * 0.5)
            rows[k] = _sum(stays, shifted)
    return rows


def subset_sums(ranks: np.ndarray) -> Banded:
    """Shares of all 2^m subsets by the sum of their ranks."""
    row: Banded = (0, np.ones(1))
    for rank in ranks:
        row = _sum((row[0], row[1] * 0.5), (row[0] + int(rank), row[1] * 0.5))
    return row


def half_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tid, half, k, base, shares) from rows (tid, half, ties, size); a null size asks for subsets of any size.

    k is the size of the sample in the first half, so that what belongs together has equal k.
    """
    for batch in batches:
        for tid, half, ties, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ranks = doubled_mid_ranks(ties)
            ranks = ranks[:len(ranks) // 2] if half == 0 else ranks[len(ranks) // 2:]
            rows = [subset_sums(ranks)] if size is None else sample_sums(ranks, size)
            out = [(0 if size is None else k if half == 0 else size - k, *row) for k, row in enumerate(rows) if row is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tid] * len(out), pa.int64()), pa.array([half] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                ["tid", "half", "k", "base", "shares"])


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def both_tails(first: pd.DataFrame, second: pd.DataFrame, target: pd.Series) -> pd.DataFrame:
    """Shares of the pairs of sums, one of each half, that are at most and at least the target."""
    low, high = [], []
    for b1, s1, b2, s2, t in zip(first["base"], first["shares"], second["base"], second["shares"], target):
        s1, s2 = np.asarray(s1), np.asarray(s2)
        below = np.concatenate([[0.0], np.cumsum(s2)])
        above = np.concatenate([np.cumsum(s2[::-1])[::-1], [0.0]])
        # the second half's sum may be at most (at least) what the first leaves of the target
        left = t - (b1 + np.arange(len(s1))) - b2
        low.append(float(s1 @ below[np.clip(left + 1, 0, len(s2))]))
        high.append(float(s1 @ above[np.clip(left, 0, len(s2))]))
    return pd.DataFrame({"low": low, "high": high})


@F.pandas_udf(T.DoubleType())
def samples_in_all(total: pd.Series, size: pd.Series) -> pd.Series:
    """2^n over the number of samples of the given size; one for subsets of any size."""
    return pd.Series([1.0 if pd.isna(k) else 2 ** int(n) / math.comb(int(n), int(k)) for n, k in zip(total, size)], dtype="float64")


KNOWN_LENGTH = 10        # observations of the tests whose distributions a task keeps: fewer than 10,000 in all


def p_values(ties: list[int], size: int | None) -> tuple[int, np.ndarray]:
    """(least sum, two-sided p of every sum from there on): all samples of ``size``, or all subsets, of the tied ranks."""
    ranks = doubled_mid_ranks(ties)
    base, shares = subset_sums(ranks) if size is None else sample_sums(ranks, size)[size]
    tails = np.minimum(np.cumsum(shares), np.cumsum(shares[::-1])[::-1])
    return base, np.minimum(1.0, 2 * tails * (1.0 if size is None else 2 ** len(ranks) / math.comb(len(ranks), size)))


class KnownTests:
    """P-values of tests given as runs of equal observations; those of short tests are kept, in one array."""

    def __init__(self, signed: bool):
        self.signed, self.values = signed, np.zeros(0)
        self.at = np.full(1 << (KNOWN_LENGTH + 8), np.iinfo(np.int64).min)     # by shape: where the p-value of a sum of zero would be

    def p(self, first: np.ndarray, ties: np.ndarray, place: np.ndarray, total: np.ndarray, size: np.ndarray, target: np.ndarray,
          wanted: np.ndarray) -> np.ndarray:
        """``first``: each test's first run; ``ties``, ``place``: observations of each run, and of its test before it."""
        out = np.full(len(first), np.nan)
        # a bit for every place at which a run begins tells the runs of a short test
        starts = np.add.reduceat(np.where(place > 0, 1 << np.minimum(place, KNOWN_LENGTH), 0), first) if len(first) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(ties))
        short = np.flatnonzero(wanted & (total <= KNOWN_LENGTH))
        shape = (starts[short] >> 1) << 8 | total[short] << 4 | (0 if self.signed else size[short])
        unknown, example = np.unique(shape, return_index=True)
        for key, i in zip(unknown, short[example]):
            if self.at[key] < -len(self.values) - (1 << 40):
                base, values = p_values(ties[first[i]:last[i]].tolist(), None if self.signed else int(size[i]))
                self.at[key] = len(self.values) - base
                self.values = np.concatenate([self.values, values])
        out[short] = self.values[self.at[shape] + target[short]]
        for i in np.flatnonzero(wanted & (total > KNOWN_LENGTH)):
            base, values = p_values(ties[first[i]:last[i]].tolist(), None if self.signed else int(size[i]))
            out[i] = values[target[i] - base]
        return out


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value of a key column is another than the one before (missing ones are equal)."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:])], bool)
    if column.null_count or not pa.types.is_integer(column.type):
        column = column.dictionary_encode("encode").indices
    values = column.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]


def stratum_tests(keys: list[str], pairs: list[tuple[int, int]] | None, exact_below: int):
    """Statistics and exact p-values of whole strata, from rows (keys, _x, _mark) sorted by keys and ``_x``.

    With ``pairs``, ``_mark`` is the level of a row and every pair of levels is a rank-sum test of the stratum.  Without, ``_x``
    is the size of a difference and ``_mark`` whether it is positive.  Rows (keys, _test, n1, n2, statistic, _ties, _exact): n2 is
    the number of non-zero differences in a signed-rank test, and ``_exact`` is null from ``exact_below`` observations on.
    """
    signed = pairs is None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches of whole strata with the first row of each."""
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                change |= _differs(batch.column(batch.schema.get_field_index(k)))
            starts = np.flatnonzero(change) + 1
            if len(starts):
                yield batch.slice(0, int(starts[-1])), np.concatenate([[0], starts[:-1]])
            rest = batch.slice(int(starts[-1])) if len(starts) else batch
        if rest is not None:
            yield rest, np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownTests(signed)
        for batch, starts in whole(batches):
            x, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_x", "_mark"))
            stratum = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
            number, rows = [], []
            for pair, levels in enumerate(pairs or [None]):
                used = x > 0 if signed else (mark == levels[0]) | (mark == levels[1])
                own, value, chosen = stratum[used], x[used], (mark[used] > 0 if signed else mark[used] == levels[0])
                sizes = np.bincount(own, minlength=len(starts))
                ones = np.bincount(own, chosen, len(starts)).astype(np.int64)
                n = len(own)
                run_at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])) if n else np.zeros(0, np.int64)
                ties = np.diff(np.append(run_at, n))
                test, place = own[run_at], run_at - (np.cumsum(sizes) - sizes)[own[run_at]]
                picked = np.add.reduceat(chosen.astype(np.int64), run_at) if n else ties
                # doubled rank sums of whole numbers, exact as doubles
                doubled = np.bincount(test, picked * (2 * place + ties + 1), len(starts)).astype(np.int64)
                tied = np.bincount(test, ties.astype(float) * (ties.astype(float) * ties - 1), len(starts))
                p = np.full(len(starts), np.nan)
                there = np.flatnonzero(sizes)
                first = np.searchsorted(test, there)
                small = (sizes < exact_below if signed else (ones > 0) & (ones < sizes) & (ones < exact_below) & (sizes - ones < exact_below))
                p[there] = known.p(first, ties, place, sizes[there], ones[there], doubled[there], small[there])
                if signed:
                    n1, n2, statistic, kept = np.bincount(stratum, minlength=len(starts)), sizes, doubled / 2, np.arange(len(starts))
                else:
                    n1, n2, statistic = ones, sizes - ones, (doubled - ones * (ones + 1)) / 2
                    kept = np.flatnonzero((n1 > 0) & (n2 > 0))
                number.append(starts[kept])
                rows.append([np.full(len(kept), pair), n1[kept], n2[kept], statistic[kept], tied[kept], p[kept]])
            columns = [np.concatenate(c) for c in zip(*rows)]
            of = batch.select(keys).take(pa.array(np.concatenate(number)))
            arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                      pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*of.columns, *arrays], names=[*keys, "_test", "n1", "n2", "statistic", "_ties", "_exact"])

    return run


def tied_p(tests: DataFrame) -> DataFrame:
    """(tid, p): twice the smaller tail, from rows (tid, ties, size, target).

    ``ties``: observations of each distinct value in order; ``size``: of the first sample, null for signed ranks;
    ``target``: its doubled rank sum.
    """
    work = tests.select("tid", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "ties", "size")
    halves = spread(work, "tid", "half").mapInArrow(half_sums, "tid long, half int, k long, base long, shares array<double>")
    of = lambda h: F.max_by(F.struct("base", "shares"), F.when(F.col("half") == h, 1)).alias(f"of{h}")
    pairs = (halves.groupBy("tid", "k").agg(of(0), of(1), F.countDistinct("half").alias("both")).where("both = 2")
             .join(tests.select("tid", "size", "target", F.aggregate("ties", F.lit(0).cast("long"), lambda a, t: a + t).alias("total")), "tid"))
    tails = pairs.withColumn("t", both_tails(F.col("of0"), F.col("of1"), F.col("target")))
    summed = tails.groupBy("tid").agg(F.sum("t.low").alias("low"), F.sum("t.high").alias("high"), F.first("total").alias("total"), F.first("size").alias("size"))
    return summed.select("tid", F.least(F.lit(1.0), 2 * F.least("low", "high") * samples_in_all("total", "size")).alias("p"))
