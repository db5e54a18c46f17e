"""Distributed ranks and quantiles against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.operators.ranks import CELL, Cells, mid_ranks, prefix_counts, quantiles, row_index, value_counts


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = []
    for g, draw in (("ties", lambda: float(rng.choice([0, 50, 100, 200, 400]))), ("wide", lambda: rng.lognormvariate(0, 4)),
                    ("signed", lambda: rng.gauss(0, 100)), (None, lambda: rng.random() * 1e-3)):
        rows += [(g, draw()) for _ in range(401)]
    rows += [("ties", None), ("wide", float("nan")), ("single", 3.5)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


def group(rows, g):
    return [v for k, v in rows if k == g and v is not None and v == v]


def test_quantiles_interpolate_linearly(values):
    rows, df = values
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"ties", "wide", "signed", "single", None}
    for g, row in got.items():
        data = group(rows, g)
        assert row["n"] == len(data)
        assert [row[k] for k in probs] == pytest.approx(list(np.quantile(data, list(probs.values()))), rel=1e-12)


@pytest.mark.parametrize("method", ["two_pass", "buffer"])
def test_quantile_methods_agree(values, method):
    _, df = values
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.37, "q3": 0.75, "q4": 1.0}
    want = {r["g"]: tuple(r)[1:] for r in quantiles(df, ["g"], "v", probs).collect()}
    got = {r["g"]: tuple(r)[1:] for r in quantiles(df, ["g"], "v", probs, method=method).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12)


def test_known_quartile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    for method in ("two_pass", "cells"):
        row = quantiles(df, [], "v", {"p25": 0.25, "p50": 0.5}, method=method).first()
        assert (row["p25"], row["p50"]) == (1.75, 3.0)


def test_mid_ranks_sum_up(values):
    rows, df = values
    for r in mid_ranks(df, ["g"], "v").groupBy("g").agg(F.sum(F.col("n") * F.col("rank")).alias("s"),
                                                         F.sum("n").alias("n")).collect():
        assert r["s"] == r["n"] * (r["n"] + 1) / 2


def test_ranks_do_not_depend_on_cells_or_partitions(values):
    _, df = values
    counts = value_counts(df, ["g"], "v")
    want = sorted(map(str, prefix_counts(counts, ["g"], "v").collect()))
    assert sorted(map(str, prefix_counts(counts, ["g"], "v", cells=3, crowded=5).collect())) == want
    assert sorted(map(str, prefix_counts(value_counts(df.repartition(3), ["g"], "v"), ["g"], "v").collect())) == want


def test_cells_are_monotone(spark):
    values = sorted([0.0, -1.0, 1e-9, 1e-3, 1.0, 1.0000001, 2.0, -2.0, 1e12, -1e12, 5e-324, 1e300, 1.7e308, float("inf"), float("-inf")])
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for kw in ({}, {"cells": 4, "crowded": 2}):
        cells = [r[CELL] for r in sorted(Cells(frame, [], "v", **kw).add(frame, "v").collect(), key=lambda r: r["v"])]
        assert cells == sorted(cells)


def test_cells_hold_a_bounded_share_of_narrow_and_outlying_values(spark):
    micros = spark.range(200_000).select((F.lit(1.7e15) + F.col("id") * 432_000).alias("v"))
    for frame, kw in ((micros, {}), (micros.unionByName(spark.createDataFrame([(0.0,), (-1e18,)], "v double")), {"crowded": 1000})):
        largest = Cells(frame, [], "v", **kw).add(frame, "v").groupBy(CELL).count().agg(F.max("count")).first()[0]
        assert largest <= 60


def test_one_value_holds_most_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    row = quantiles(df, [], "v", {"p10": 0.1, "p50": 0.5}).first()
    data = [7.0 if i % 3 == 0 else float(i) for i in range(30000)]
    assert [row["p10"], row["p50"]] == pytest.approx(list(np.quantile(data, [0.1, 0.5])))


def test_row_index(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "k long")
    assert sorted((r["k"], r["row_index"]) for r in row_index(df, "k").collect()) == [(10, 0), (20, 1), (30, 2)]
    big = spark.range(2**60, 2**60 + 50).withColumnRenamed("id", "k")
    assert sorted((r["k"] - 2**60, r["row_index"]) for r in row_index(big, "k").collect()) == [(i, i) for i in range(50)]
