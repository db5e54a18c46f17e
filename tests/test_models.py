"""Correlation, regression, resampling and chart frames against numpy."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.operators import chartframes, corr, ranks, regress, resample


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    rows = []
    for g in ("p", "q"):
        for i in range(120):
            x = float(rng.randint(60, 100))
            rows.append((len(rows), g, x, 0.05 * x * (1 if g == "p" else -1) + rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(5).cache()


def xy(rows, g):
    return np.array([r[2] for r in rows if r[1] == g]), np.array([r[3] for r in rows if r[1] == g])


def mid(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_spearman(points):
    rows, df = points
    for r in corr.spearman(df, ["g"], "x", "y").collect():
        x, y = xy(rows, r["g"])
        rho = np.corrcoef(mid(x), mid(y))[0, 1]
        half = 1.959963984540054 * math.sqrt(1.06 / 117)
        assert r["rho"] == pytest.approx(rho)
        assert (r["ci_low"], r["ci_high"]) == pytest.approx((math.tanh(math.atanh(rho) - half), math.tanh(math.atanh(rho) + half)))
        assert r["t"] == pytest.approx(rho * math.sqrt(118 / (1 - rho ** 2)))


def test_spearman_does_not_depend_on_the_side(points):
    _, df = points
    a = {r["g"]: r["rho"] for r in corr.spearman(df, ["g"], "x", "y").collect()}
    assert {r["g"]: pytest.approx(r["rho"]) for r in corr.spearman(df, ["g"], "y", "x").collect()} == a


def test_spearman_degenerate_and_text(spark):
    df = spark.createDataFrame([("one", float(i), float(i)) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(5)],
                               "g string, x double, y double")
    got = {r["g"]: r for r in corr.correlation_text(corr.spearman(df, ["g"], "x", "y")).collect()}
    assert got["one"]["rho"] == 1.0 and got["one"]["p"] == 0.0
    assert got["flat"]["rho"] is None and got["flat"]["text"] == "rho = NA, CI[NA, NA], NA"
    text = corr.correlation_text(spark.createDataFrame([(0.504, -0.001, 0.9, 0.06234)], "rho double, ci_low double, ci_high double, p double"))
    assert text.first()["text"] == "rho = 0.5, CI[0, 0.9], p = 0.0623"


def test_deming_default_is_ratio_of_deviations(points):
    rows, df = points
    for r in regress.deming(df, ["g"], "x", "y").collect():
        x, y = xy(rows, r["g"])
        slope = math.copysign(y.std(ddof=1) / x.std(ddof=1), np.cov(x, y)[0, 1])
        assert r["slope"] == pytest.approx(slope)
        assert r["intercept"] == pytest.approx(y.mean() - slope * x.mean())


def test_deming_zero_covariance_has_no_slope(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (1.0, 1.0), (0.0, 0.0), (0.0, 2.0)], "x double, y double")
    assert regress.deming(df, [], "x", "y").first()["slope"] is None


def test_ols_coefficients(points):
    rows, df = points
    for r in regress.ols(df, ["g"], "x", "y").collect():
        x, y = xy(rows, r["g"])
        design = np.column_stack([np.ones_like(x), x])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        residual = y - design @ beta
        sigma2 = residual @ residual / (len(x) - 2)
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
        assert [r["intercept"], r["slope"]] == pytest.approx(list(beta))
        assert [r["intercept_se"], r["slope_se"]] == pytest.approx(list(se))
        assert r["sigma"] == pytest.approx(math.sqrt(sigma2))
        assert r["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
        assert r["f"] == pytest.approx(r["slope_t"] ** 2)


def test_slope_p_equals_correlation_p(points):
    _, df = points
    ranked = df
    for c in ("x", "y"):
        table = ranks.mid_ranks(df, ["g"], c, rank=f"r{c}").select("g", F.col(c), f"r{c}")
        ranked = ranked.join(table, ["g", c])
    slope = {r["g"]: r["slope_p"] for r in regress.ols(ranked, ["g"], "rx", "ry").collect()}
    for r in corr.spearman(df, ["g"], "x", "y").collect():
        assert r["p"] == pytest.approx(slope[r["g"]], rel=1e-9)


def test_diagnostics(points):
    rows, df = points
    got = sorted(regress.ols_diagnostics(df, ["g"], "x", "y").where("g = 'p'").collect(), key=lambda r: r["id"])
    x, y = xy(rows, "p")
    design = np.column_stack([np.ones_like(x), x])
    hat = design @ np.linalg.inv(design.T @ design) @ design.T
    residual = y - hat @ y
    sigma2 = residual @ residual / 118
    std = residual / np.sqrt(sigma2 * (1 - np.diag(hat)))
    assert [r["leverage"] for r in got] == pytest.approx(list(np.diag(hat)))
    assert [r["std_residual"] for r in got] == pytest.approx(list(std))
    assert [r["cooks_distance"] for r in got] == pytest.approx(list(std ** 2 * np.diag(hat) / (2 * (1 - np.diag(hat)))))
    overall = regress.ols_diagnostics(df, [], "x", "y")
    assert overall.count() == 240 and abs(overall.agg(F.sum("residual")).first()[0]) < 1e-8


def test_global_test(points):
    rows, df = points
    got = {r["check"]: r for r in regress.ols_global_test(df, ["g"], "x", "y", "id").where("g = 'p'").collect()}
    x, y = xy(rows, "p")
    v = np.array([r[0] for r in rows if r[1] == "p"], dtype=float)
    n, slope = len(x), np.polyfit(x, y, 1)[0]
    fitted = y.mean() + slope * (x - x.mean())
    r = (y - fitted) / math.sqrt(((y - fitted) ** 2).mean())
    g = fitted - y.mean()
    s1, s2 = (r ** 3).sum() ** 2 / (6 * n), (r ** 4 - 3).sum() ** 2 / (24 * n)
    gamma = (g ** 2 * (x - x.mean())).mean()
    s3 = (g ** 2 * r).sum() ** 2 / n / ((g ** 4).mean() - (g ** 2).mean() ** 2 - gamma ** 2 / x.var())
    s4 = ((v - v.mean()) * (r ** 2 - 1)).sum() ** 2 / (2 * n * v.var())
    for name, value in (("skewness", s1), ("kurtosis", s2), ("link function", s3), ("heteroscedasticity", s4),
                        ("global", s1 + s2 + s3 + s4)):
        assert got[name]["statistic"] == pytest.approx(value, rel=1e-6), name
    assert got["skewness"]["p"] == pytest.approx(math.erfc(math.sqrt(s1 / 2)), rel=1e-6)


@pytest.mark.parametrize("method", ["exact", "poisson", "compressed"])
def test_bootstrap_is_a_function_of_the_seed(points, method):
    rows, df = points
    run = lambda frame, seed=1: sorted(
        (r["g"], round(r["lower"], 9), round(r["upper"], 9)) for r in
        resample.bootstrap_mean(frame, ["g"], "y", 400, key="id", method=method, seed=seed).collect())
    first = run(df)
    assert run(df.repartition(11)) == first
    assert run(df, seed=2) != first
    for g, low, high in first:
        _, y = xy(rows, g)
        half = 1.96 * y.std() / math.sqrt(len(y))
        assert (low, high) == pytest.approx((y.mean() - half, y.mean() + half), abs=0.35 * half)


def test_bootstrap_method_does_not_change_with_group_size(spark):
    df = spark.range(330).select("id", F.when(F.col("id") < 300, "big").otherwise("small").alias("g"),
                                 (F.col("id") % 17).cast("double").alias("v"))
    exact = resample.replicate_sums(df, ["g"], {"_x": "v"}, 50, method="exact")
    assert {(r["g"], r["weight"]) for r in exact.collect()} == {("big", 300.0), ("small", 30.0)}    # drawn: always n
    drawn = resample.replicate_sums(df, ["g"], {"_x": "v"}, 400)
    for g, n in (("big", 300), ("small", 30)):
        w = [r["weight"] for r in drawn.where(F.col("g") == g).collect()]
        assert len(w) == 400 and abs(np.mean(w) - n) < 4 * math.sqrt(n / 400) and 0.7 * n < np.var(w) < 1.4 * n
    with pytest.raises(ValueError):
        resample.replicate_sums(df, ["g"], {"_x": "v"}, 50, method="poisson")


def test_compressed_draws_do_not_depend_on_how_often_rows_were_split(spark):
    df = spark.range(4000).select((F.col("id") % 3).cast("double").alias("v"))
    a = sorted(tuple(r) for r in resample.replicate_sums(df, [], {"_x": "v"}, 30).collect())
    assert a == sorted(tuple(r) for r in resample.replicate_sums(df.repartition(9), [], {"_x": "v"}, 30).collect())


def test_deming_replicates_far_from_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 1000)
    y = 2 * x + rng.normal(0, 0.3, 1000)
    for shift in (0.0, 1e7):
        df = spark.createDataFrame([(float(a + shift), float(b + shift)) for a, b in zip(x, y)], "x double, y double")
        got = regress.deming_replicates(df, [], "x", "y", 50).collect()
        assert len(got) == 50 and all(abs(r["slope"] - 2.05) < 0.1 for r in got)


def test_weights_are_poisson_whatever_the_keys(spark):
    # each row is its own group: the field sum is its weight
    df = spark.range(-300, 300).select((F.col("id") * 3_000_000_019).alias("id"), F.col("id").alias("g"), F.lit(1.0).alias("v"))
    sums = resample.replicate_sums(df, ["g"], {"_x": "v"}, 100, key="id", method="poisson")
    stats = sums.agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("m"), F.var_samp("weight").alias("v"),
                     F.avg((F.col("weight") == 0).cast("double")).alias("z")).first()
    assert stats["n"] == 60_000
    assert (stats["m"], stats["v"], stats["z"]) == (pytest.approx(1.0, abs=0.02), pytest.approx(1.0, abs=0.04),
                                                    pytest.approx(math.exp(-1), abs=0.01))
    totals = [r["s"] for r in sums.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()]
    assert np.var(totals) == pytest.approx(600, rel=0.5)  # rows are independent within a replicate


def test_geometric_mean_interval_and_constant_group(spark):
    df = spark.createDataFrame([(i, "c", 8.0) for i in range(5)] + [(9, "one", 3.0)], "id long, g string, v double")
    got = {r["g"]: r for r in resample.bootstrap_geometric_mean(df, ["g"], "v", 50).collect()}
    assert [got["c"][k] for k in ("geo_mean", "lower", "upper")] == pytest.approx([8.0] * 3)
    assert got["one"]["n"] == 1 and got["one"]["upper"] == pytest.approx(3.0)


def test_deming_band_surrounds_the_line(points):
    _, df = points
    band = regress.deming_band(df, ["g"], "x", "y", points=9, replicates=60).collect()
    assert len(band) == 18
    inside = sum(r["lower"] <= r["y"] <= r["upper"] for r in band)
    assert inside == 18


def test_axis_median_differs_from_raw_median(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (800.0,), (3200.0,)], "v double")
    row = chartframes.axis_quartiles(df, [], "v").first()
    assert row["p50"] == pytest.approx(203.3406, abs=1e-4)
    assert chartframes.axis_quartiles(df, [], "v", "identity").first()["p50"] == 425.0


def test_density_integrates_to_one_and_matches_kernels(spark):
    rng = random.Random(2)
    data = np.array([rng.gauss(5, 2) for _ in range(500)])
    df = spark.createDataFrame([("g", float(v)) for v in data], "g string, v double")
    curve = sorted(chartframes.density(df, ["g"], "v", points=256).collect(), key=lambda r: r["point"])
    x, y = np.array([r["x"] for r in curve]), np.array([r["density"] for r in curve])
    q1, q3 = np.quantile(data, [0.25, 0.75])
    bw = 0.9 * min(data.std(ddof=1), (q3 - q1) / 1.34) * 500 ** -0.2
    want = np.array([np.exp(-0.5 * ((v - data) / bw) ** 2).sum() for v in x]) / (500 * bw * math.sqrt(2 * math.pi))
    assert y == pytest.approx(want, rel=5e-3, abs=1e-5)
    assert x[0] == pytest.approx(data.min()) and x[-1] == pytest.approx(data.max())
    scaled = chartframes.density(df, ["g"], "v", points=64, scale="width").agg(F.max("density")).first()[0]
    assert scaled == pytest.approx(1.0)


def test_normal_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 9)], "v double")
    got = {r["v"]: r["theoretical"] for r in regress.normal_quantiles(df, [], "v").collect()}
    from statistics import NormalDist
    want = {v: NormalDist().inv_cdf((rank - 0.375) / (5 + 0.25)) for v, rank in ((1.0, 1), (2.0, 2.5), (3.0, 4), (9.0, 5))}
    assert got == pytest.approx(want)


def test_trajectories_need_every_level(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "id long, t string, v double")
    assert sorted(tuple(r) for r in chartframes.trajectories(df, [], "id", "t", "v", ["a", "b"]).collect()) == [
        (1, 1, "a", 1.0), (1, 2, "b", 2.0)]


@pytest.mark.parametrize("block, heavy", [(resample.BLOCK_ROWS, resample.HEAVY_ROW), (1, 2), (1, 10**9)])
def test_split_bootstrap_is_the_bootstrap_of_n_draws(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(resample, "BLOCK_ROWS", block)
    monkeypatch.setattr(resample, "HEAVY_ROW", heavy)
    data = {"p": [1.0, 2.0, 4.0, 4.0], None: [7.0], "q": [float(k % 11) for k in range(400)]}
    df = spark.createDataFrame([(g, v) for g, values in data.items() for v in values] + [("p", None)], "g string, v double")
    sums = resample.replicate_sums(df, ["g"], {"x": "v", "xx": "v * v"}, 8_000, method="split").collect()
    for g, values in data.items():
        got = [r for r in sums if r["g"] == g]
        assert len(got) == 8_000 and {r[resample.WEIGHT] for r in got} == {len(values)}
        mean, var = np.mean([r["x"] for r in got]), np.var([r["x"] for r in got])
        assert mean == pytest.approx(sum(values), abs=5 * math.sqrt(len(values) * np.var(values) / 8_000) + 1e-9)
        assert var == pytest.approx(len(values) * np.var(values), rel=0.08)
        assert np.mean([r["xx"] for r in got]) == pytest.approx(sum(v * v for v in values), rel=0.03)
    # the whole distribution of a small group: every way to draw 4 of its 4 rows
    every = collections.Counter(sum(c) for c in itertools.product(data["p"], repeat=4))
    seen = collections.Counter(r["x"] for r in sums if r["g"] == "p")
    assert set(seen) <= set(every)
    for x, ways in every.items():
        share = ways / 256
        assert seen[x] / 8_000 == pytest.approx(share, abs=5 * math.sqrt(share / 8_000))


def test_split_bootstrap_does_not_depend_on_partitions(points, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 8)
    _, df = points
    run = lambda frame, seed: sorted(map(str, resample.replicate_sums(frame, ["g"], {"y": "round(y, 3)"}, 50, seed, method="split")
                                         .selectExpr("g", "replicate", "round(y, 6) AS y").collect()))
    assert run(df, 4) == run(df.repartition(5), 4) != run(df, 5)


def several_rows():
    rng = random.Random(9)
    rows = []
    for g, n in (("p", 90), (None, 40), ("few", 4), ("bound", 30)):
        for k in range(n):
            a, b = rng.gauss(50, 3), rng.random()
            c = 2 * a - b if g == "bound" else rng.choice([0.0, 1.0])
            rows.append((g, k, a, b, c, 3 + 0.5 * a - 2 * b + c + rng.gauss(0, 0.4)))
    return rows + [("p", 999, None, 1.0, 1.0, 1.0), ("p", 998, 1.0, float("nan"), 1.0, 1.0)]


def test_several_predictors_against_least_squares(spark):
    rows = several_rows()
    df = spark.createDataFrame(rows, "g string, id long, a double, b double, c double, y double").repartition(3)
    table = {(r["g"], r["term"]): r for r in regress.ols_several(df, ["g"], ["a", "b", "c"], "y").collect()}
    assert {g for g, _ in table} == {"p", None} and len(table) == 8      # too few rows, and dependent predictors, have no fit
    for g in ("p", None):
        data = np.array([r[2:] for r in rows if r[0] == g and None not in r[1:] and not any(v != v for v in r[2:])])
        design = np.column_stack([np.ones(len(data)), data[:, :3]])
        beta, *_ = np.linalg.lstsq(design, data[:, 3], rcond=None)
        residual = data[:, 3] - design @ beta
        sigma = math.sqrt(residual @ residual / (len(data) - 4))
        se = sigma * np.sqrt(np.diag(np.linalg.inv(design.T @ design)))
        for k, term in enumerate(("(intercept)", "a", "b", "c")):
            r = table[g, term]
            assert (r["position"], r["n"]) == (k, len(data))
            assert [r["estimate"], r["se"], r["t"], r["sigma"]] == pytest.approx([beta[k], se[k], beta[k] / se[k], sigma], rel=1e-6)


def test_several_diagnostics_and_the_single_predictor(spark):
    df = spark.createDataFrame(several_rows(), "g string, id long, a double, b double, c double, y double").where("g = 'p'")
    got = sorted(regress.ols_several_diagnostics(df, ["g"], ["a", "b", "c"], "y").collect(), key=lambda r: r["id"])
    x = np.array([[1, r["a"], r["b"], r["c"]] for r in got])
    y = np.array([r["y"] for r in got])
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    std = (y - hat @ y) / np.sqrt((y - hat @ y) @ (y - hat @ y) / (len(y) - 4) * (1 - np.diag(hat)))
    assert [r["leverage"] for r in got] == pytest.approx(list(np.diag(hat)), rel=1e-6)
    assert [r["std_residual"] for r in got] == pytest.approx(list(std), rel=1e-6)
    assert [r["cooks_distance"] for r in got] == pytest.approx(list(std ** 2 * np.diag(hat) / (4 * (1 - np.diag(hat)))), rel=1e-6)
    one, plain = regress.ols_several(df, [], ["a"], "y").orderBy("position").collect(), regress.ols(df, [], "a", "y").first()
    assert [one[0]["estimate"], one[1]["se"], one[1]["p"]] == pytest.approx([plain["intercept"], plain["slope_se"], plain["slope_p"]], rel=1e-6)


def test_exact_draws_are_never_the_broadcast_side(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(40)], "g string, v double")
    plan = resample.replicate_sums(df, ["g"], {"_x": "v"}, 20, method="exact")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint=(strategy=broadcast)" not in plan


def test_weights_read_off_their_sequence_equal_expanded_rows(spark):
    df = spark.range(-700, 900).select((F.col("id") * 1_500_000_007).alias("_key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
                                       (F.col("id") % 41 + 0.25).cast("double").alias("x"), F.lit(1e6).alias("y"))
    for by in (["g"], []):
        want, got = ({tuple(r[c] for c in (*by, "replicate")): r for r in f(df, by, ["x", "y"], "_key", 1_000, 5).collect()}
                     for f in (resample._poisson_sums, resample._lagged_sums))
        assert want.keys() == got.keys()
        for k, r in want.items():
            assert r["weight"] == got[k]["weight"] and (got[k]["x"], got[k]["y"]) == pytest.approx((r["x"], r["y"]), rel=1e-12)
    plan = resample.replicate_sums(df, ["g"], {"_x": "x"}, 10_000, key="_key", method="poisson")._jdf.queryExecution().analyzed().toString()
    assert "explode(sequence(" not in plan  # no row for every row and replicate


def test_many_rows_of_a_cell_are_correlated(spark):
    import pyarrow as pa
    replicates, rng = 1_000, np.random.default_rng(3)
    size, span = resample.cell_size(replicates)
    last = (resample.PRIME - 1) // span                    # the last cell reaches beyond the prime
    rows = [(chunk, cell, group, cell * span + int(p), float(v)) for chunk, cell, group, n in
            ((0, 5, 1, 700), (0, 5, 2, 40), (0, last, 1, 700), (0, last, 3, 20), (1, 5, 7, 600), (1, 9, 7, 4))
            for p, v in zip(rng.integers(0, min(span, resample.PRIME - cell * span), n), rng.normal(3, 2, n))]
    assert 600 * replicates > resample.DENSE * size
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.float64()])], ["_chunk", "_cell", "_group", "_at", "x"])
    parts = [batch.slice(i, 500) for i in range(0, len(rows), 500)]
    got = [r for out in resample.lagged(["x"], replicates)(iter(parts)) for r in out.to_pylist()]
    assert [r["_group"] for r in got] == [1, 2, 3, 7]
    bounds = resample.poisson_thresholds()
    for r in got:
        own = [(at, x) for _, _, g, at, x in rows if g == r["_group"]]
        for lag in (1, 2, 517, 1_000):
            w = [sum(pow((at + lag) * resample.REPLICATE_STEP, 5, resample.PRIME) >= b for b in bounds) for at, _ in own]
            assert r["weight"][lag - 1] == sum(w) and r["x"][lag - 1] == pytest.approx(sum(k * x for k, (_, x) in zip(w, own)), rel=1e-12)
