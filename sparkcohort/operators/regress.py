"""Straight-line fits by group from sufficient statistics: errors-in-both-variables and least squares with diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.nulls import sql_name, sql_text
from sparkcohort.functions.tails import chi2_upper, normal_quantile, student_t_two_sided
from sparkcohort.operators.describe import drop_missing
from sparkcohort.operators.ranks import TOTAL, mid_rank, prefix_counts, value_counts
from sparkcohort.operators.resample import WEIGHT, percentile_bounds, replicate_sums
from sparkcohort.session import broadcast_if_small, join_groups


# Relative size below which a difference of sums is taken as zero.
ROUNDING = "1e-12D"


# --- errors in both variables ---------------------------------------------------------------------------------------

def _deming_line(noise_ratio: float | None) -> tuple[str, str]:
    """Slope and intercept as SQL over ``_sxx, _syy, _sxy`` (sample moments) and ``_mx, _my``."""
    delta = "(_syy / _sxx)" if noise_ratio is None else f"{float(noise_ratio) ** 2!r}D"
    gap = f"(_syy - {delta} * _sxx)"
    slope = (f"CASE WHEN _sxy != 0 THEN ({gap} + sqrt({gap} * {gap} + 4D * {delta} * _sxy * _sxy)) / (2D * _sxy) END")
    return slope, "_my - slope * _mx"


def deming(df: DataFrame, by: Sequence[str], x: str, y: str, noise_ratio: float | None = None) -> DataFrame:
    """(group, n, slope, intercept, x_min, x_max).  The default noise ratio is sd(y)/sd(x); no fit for a zero covariance."""
    slope, intercept = _deming_line(noise_ratio)
    keys = [sql_name(b) for b in by]
    return (drop_missing(df, x, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("_sxx"), F.var_samp(y).alias("_syy"),
        F.covar_samp(x, y).alias("_sxy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))
        .withColumn("slope", F.expr(slope)).selectExpr(*keys, "n", "slope", f"{intercept} AS intercept", "x_min", "x_max"))


def deming_replicates(df: DataFrame, by: Sequence[str], x: str, y: str, replicates: int = 100, seed: int = 1,
                      key: str | None = None, noise_ratio: float | None = None, **kw) -> DataFrame:
    """(group, replicate, slope, intercept) of bootstrap resamples; the noise ratio is estimated anew in each.

    Sums of products are taken around the group's means, so data far from zero lose no digits.  A resample of one repeated
    point has no line and no row.
    """
    slope, intercept = _deming_line(noise_ratio)
    rows = drop_missing(df, x, y)
    centres = broadcast_if_small(rows.groupBy(*by).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy")))
    qx, qy = f"({sql_name(x)} - _cx)", f"({sql_name(y)} - _cy)"
    sums = replicate_sums(join_groups(rows, centres, by), by, {
        "_x": qx, "_y": qy, "_xx": f"{qx} * {qx}", "_yy": f"{qy} * {qy}", "_xy": f"{qx} * {qy}"}, replicates, seed, key, **kw)
    sums = join_groups(sums, centres, by)
    keys = [sql_name(b) for b in by]
    w = WEIGHT
    # moments below rounding error of the centred sums count as zero
    moments = sums.where(f"{w} > 1").selectExpr(
        *keys, "replicate", f"_cx + _x / {w} AS _mx", f"_cy + _y / {w} AS _my", f"(_xx - _x * _x / {w}) / ({w} - 1) AS _sxx",
        f"(_yy - _y * _y / {w}) / ({w} - 1) AS _syy", f"(_xy - _x * _y / {w}) / ({w} - 1) AS _sxy",
        f"{ROUNDING} * _xx / {w} AS _ex", f"{ROUNDING} * sqrt(_xx * _yy) / {w} AS _exy")
    return (moments.where("_sxx > _ex AND abs(_sxy) > _exy").withColumn("slope", F.expr(slope))
            .selectExpr(*keys, "replicate", "slope", f"{intercept} AS intercept").where("slope IS NOT NULL"))


def x_grid(limits: DataFrame, by: Sequence[str], points: int = 80) -> DataFrame:
    """(group, point, x): an even grid from ``x_min`` to ``x_max`` of each group."""
    return (limits.select(*by, "x_min", "x_max", F.explode(F.expr(f"sequence(0, {points - 1})")).alias("point"))
            .selectExpr(*[sql_name(b) for b in by], "point", f"x_min + (x_max - x_min) * point / {points - 1}D AS x"))


def deming_band(df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 80, level: float = 0.95,
                replicates: int = 100, seed: int = 1, key: str | None = None, noise_ratio: float | None = None,
                **kw) -> DataFrame:
    """(group, point, x, y, lower, upper): the fitted line and its percentile band over a grid of the group's range.

    The replicate lines meet the grid as (group, replicate) rows that each expand to ``points`` grid values, so the size is
    groups x replicates x points and does not depend on the data.
    """
    fit = deming(df, by, x, y, noise_ratio)
    keys = [sql_name(b) for b in by]
    lines = join_groups(deming_replicates(df, by, x, y, replicates, seed, key, noise_ratio, **kw),
                        fit.select(*by, "x_min", "x_max"), by)
    predicted = (lines.withColumn("point", F.explode(F.expr(f"sequence(0, {points - 1})")))
                 .selectExpr(*keys, "point",
                             f"intercept + slope * (x_min + (x_max - x_min) * point / {points - 1}D) AS _y"))
    line = join_groups(x_grid(fit, by, points), fit.select(*by, "slope", "intercept"), by).selectExpr(
        *keys, "point", "x", "intercept + slope * x AS y")
    return join_groups(line, percentile_bounds(predicted, [*by, "point"], "_y", level), [*by, "point"], "left")


# --- least squares ----------------------------------------------------------------------------------------------------

def ols(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """One row per group with the whole coefficient table of ``y = intercept + slope * x``.

    Columns: n, intercept, slope, their standard errors, t and p, sigma, r2, adj_r2, f, x_mean, sxx, sse.
    """
    sums = drop_missing(df, x, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    keys = [sql_name(b) for b in by]
    fit = (sums.where("n > 2 AND sxx > 0")
           .selectExpr("*", "sxy / sxx AS slope", "greatest(0D, syy - sxy / sxx * sxy) AS sse")
           .selectExpr("*", "y_mean - slope * x_mean AS intercept", "sqrt(sse / (n - 2)) AS sigma")
           .selectExpr("*", "sigma / sqrt(sxx) AS slope_se", "sigma * sqrt(1D / n + x_mean * x_mean / sxx) AS intercept_se",
                       "CASE WHEN syy > 0 THEN 1D - sse / syy END AS r2")
           .selectExpr("*", "CASE WHEN slope_se > 0 THEN slope / slope_se END AS slope_t",
                       "CASE WHEN intercept_se > 0 THEN intercept / intercept_se END AS intercept_t",
                       "1D - (1D - r2) * (n - 1) / (n - 2) AS adj_r2"))
    return (fit.withColumn("slope_p", student_t_two_sided("slope_t", "n - 2"))
            .withColumn("intercept_p", student_t_two_sided("intercept_t", "n - 2"))
            .selectExpr(*keys, "n", "intercept", "intercept_se", "intercept_t", "intercept_p", "slope", "slope_se",
                        "slope_t", "slope_p", "sigma", "r2", "adj_r2", "slope_t * slope_t AS f", "x_mean", "y_mean",
                        "sxx", "sse"))


DEPENDENT = 1e-12        # share of a predictor's variance that the ones before it must leave


def _gram(df: DataFrame, by: Sequence[str], predictors: Sequence[str], y: str) -> DataFrame:
    """One row per group: n, means, centred sums of squares and products of ``y`` (as number p) and the predictors."""
    names = [*predictors, y]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_mean{i}") for i, c in enumerate(names)]]
    aggs += [F.regr_sxy(names[j], names[i]).alias(f"_s{i}_{j}") for j in range(len(names)) for i in range(j + 1)]
    return drop_missing(df, *names).groupBy(*by).agg(*aggs)


def _several_fit(df: DataFrame, by: Sequence[str], predictors: Sequence[str], y: str) -> DataFrame:
    """Coefficients ``_b``, the inverse Cholesky factor ``_v`` of the predictors' correlations, scales ``_d``, sigma, sse per group.

    Every sum comes from one aggregation, in which rows combine before they move; the solution is written out as
    expressions over one row per group.  Groups with too few rows, or with a predictor that the others determine, have none.
    """
    p = len(predictors)
    fit = _gram(df, by, predictors, y).where(f"n > {p + 1}")
    fit = fit.withColumns({f"_d{i}": F.expr(f"CASE WHEN _s{i}_{i} > 0 THEN sqrt(_s{i}_{i}) END") for i in range(p)})
    entry = lambda i, j: f"(_s{min(i, j)}_{max(i, j)} / _d{i} / _d{j})"
    sums = lambda terms: " + ".join(terms) or "0D"
    for j in range(p):
        # column j of the Cholesky factor, then row j of its inverse
        rest = f"(1D - ({sums([f'_l{j}_{k} * _l{j}_{k}' for k in range(j)])}))"
        fit = fit.withColumn(f"_l{j}_{j}", F.expr(f"CASE WHEN {rest} > {DEPENDENT!r}D THEN sqrt({rest}) END"))
        fit = fit.withColumns({f"_l{i}_{j}": F.expr(f"({entry(i, j)} - ({sums([f'_l{i}_{k} * _l{j}_{k}' for k in range(j)])})) / _l{j}_{j}") for i in range(j + 1, p)})
        fit = fit.withColumns({f"_v{j}_{k}": F.expr(f"-({sums([f'_l{j}_{m} * _v{m}_{k}' for m in range(k, j)])}) / _l{j}_{j}") for k in range(j)} | {
            f"_v{j}_{j}": F.expr(f"1D / _l{j}_{j}")})
    fit = fit.withColumns({f"_z{k}": F.expr(sums([f"_v{k}_{i} * _s{i}_{p} / _d{i}" for i in range(k + 1)])) for k in range(p)})
    fit = fit.where(f"_z{p - 1} IS NOT NULL")
    fit = fit.withColumns({f"_b{i}": F.expr(f"({sums([f'_v{k}_{i} * _z{k}' for k in range(i, p)])}) / _d{i}") for i in range(p)} | {
        f"_c{i}": F.expr(f"sqrt({sums([f'_v{k}_{i} * _v{k}_{i}' for k in range(i, p)])}) / _d{i}") for i in range(p)} | {
        "sse": F.expr(f"greatest(0D, _s{p}_{p} - ({sums([f'_z{k} * _z{k}' for k in range(p)])}))")})
    centre = sums([f"pow({sums([f'_v{k}_{i} * _mean{i} / _d{i}' for i in range(k + 1)])}, 2)" for k in range(p)])
    return fit.withColumns({
        "sigma": F.expr(f"sqrt(sse / (n - {p + 1}))"), "_a": F.expr(f"_mean{p} - ({sums([f'_b{i} * _mean{i}' for i in range(p)])})"),
        "_ca": F.expr(f"sqrt(1D / n + {centre})"), "r2": F.expr(f"CASE WHEN _s{p}_{p} > 0 THEN 1D - sse / _s{p}_{p} END")})


def ols_several(df: DataFrame, by: Sequence[str], predictors: Sequence[str], y: str) -> DataFrame:
    """Coefficient table of ``y`` on several predictors: (group, position, term, estimate, se, t, p) with n, sigma, r2, adj_r2, f.

    One row per term of each group, the intercept first.  Rows with a missing value are left out; groups of at most
    p + 1 rows or with linearly dependent predictors have no rows here.
    """
    p, keys = len(predictors), [sql_name(b) for b in by]
    terms = ["named_struct('position', 0, 'term', '(intercept)', 'estimate', _a, 'se', sigma * _ca)"] + [
        f"named_struct('position', {i + 1}, 'term', {sql_text(c)}, 'estimate', _b{i}, 'se', sigma * _c{i})" for i, c in enumerate(predictors)]
    table = _several_fit(df, by, predictors, y).selectExpr(
        *keys, "n", "sigma", "r2", f"1D - (1D - r2) * (n - 1) / (n - {p + 1}) AS adj_r2",
        f"CASE WHEN r2 < 1 THEN r2 / {p} / ((1D - r2) / (n - {p + 1})) END AS f", f"inline(array({', '.join(terms)}))")
    return (table.withColumn("t", F.expr("CASE WHEN se > 0 THEN estimate / se END"))
            .withColumn("p", student_t_two_sided("t", f"n - {p + 1}"))
            .selectExpr(*keys, "position", "term", "estimate", "se", "t", "p", "n", "sigma", "r2", "adj_r2", "f"))


def ols_several_diagnostics(df: DataFrame, by: Sequence[str], predictors: Sequence[str], y: str) -> DataFrame:
    """The input rows with ``fitted, residual, leverage, std_residual, cooks_distance`` of their group's fit."""
    p = len(predictors)
    names = [sql_name(c) for c in predictors]
    wanted = [f"_{c}{i}" for i in range(p) for c in ("b", "d", "mean")] + [f"_v{k}_{i}" for k in range(p) for i in range(k + 1)]
    fit = _several_fit(df, by, predictors, y).selectExpr(*[sql_name(b) for b in by], "n AS _n", "sigma AS _sigma", "_a", *wanted)
    rows = join_groups(drop_missing(df, *predictors, y), broadcast_if_small(fit), by)
    far = " + ".join(f"pow({' + '.join(f'_v{k}_{i} * ({names[i]} - _mean{i}) / _d{i}' for i in range(k + 1))}, 2)" for k in range(p))
    return (rows.selectExpr("*", f"_a + {' + '.join(f'_b{i} * {c}' for i, c in enumerate(names))} AS fitted", f"1D / _n + {far} AS leverage")
            .selectExpr("*", f"{sql_name(y)} - fitted AS residual")
            .selectExpr("*", "CASE WHEN _sigma > 0 AND leverage < 1 THEN residual / (_sigma * sqrt(1D - leverage)) END AS std_residual")
            .selectExpr(*[f"`{c}`" for c in df.columns], "fitted", "residual", "leverage", "std_residual",
                        f"std_residual * std_residual * leverage / ({p + 1}D * (1D - leverage)) AS cooks_distance"))


_FIT_COLUMNS = ("n", "intercept", "slope", "sigma", "x_mean", "y_mean", "sxx", "sse")


def _with_fit(df: DataFrame, by: Sequence[str], x: str, y: str, fit: DataFrame | None) -> DataFrame:
    """Rows with the fit of their group beside them.  The fit is settled once; it is broadcast when its rows are few."""
    line = (fit if fit is not None else ols(df, by, x, y)).selectExpr(
        *[sql_name(b) for b in by], *[f"{c} AS _{c}" for c in _FIT_COLUMNS])
    return join_groups(drop_missing(df, x, y), broadcast_if_small(line), by)


def ols_diagnostics(df: DataFrame, by: Sequence[str], x: str, y: str, fit: DataFrame | None = None) -> DataFrame:
    """The input rows with ``fitted, residual, leverage, std_residual, cooks_distance``."""
    qx, qy = sql_name(x), sql_name(y)
    rows = _with_fit(df, by, x, y, fit)
    return (rows.selectExpr("*", f"_intercept + _slope * {qx} AS fitted",
                            f"1D / _n + ({qx} - _x_mean) * ({qx} - _x_mean) / _sxx AS leverage")
            .selectExpr("*", f"{qy} - fitted AS residual")
            .selectExpr("*", "CASE WHEN _sigma > 0 AND leverage < 1 THEN residual / (_sigma * sqrt(1D - leverage)) END "
                             "AS std_residual")
            .selectExpr(*[f"`{c}`" for c in df.columns], "fitted", "residual", "leverage", "std_residual",
                        "std_residual * std_residual * leverage / (2D * (1D - leverage)) AS cooks_distance"))


def normal_quantiles(df: DataFrame, by: Sequence[str], value: str, name: str = "theoretical") -> DataFrame:
    """(group, value, n, theoretical): normal quantile of every distinct value at its average rank."""
    ranked = prefix_counts(value_counts(df, by, value), by, value, source=df)
    offset = f"(CASE WHEN {TOTAL} <= 10 THEN 0.375D ELSE 0.5D END)"
    return (ranked.withColumn("_rank", mid_rank())
            .withColumn("_p", F.expr(f"(_rank - {offset}) / ({TOTAL} + 1D - 2D * {offset})"))
            .select(*by, value, F.col("_count").alias("n"), normal_quantile("_p").alias(name)))


def ols_global_test(df: DataFrame, by: Sequence[str], x: str, y: str, order: str,
                    fit: DataFrame | None = None) -> DataFrame:
    """Joint check of the linear model assumptions: skewness, kurtosis, link function, heteroscedasticity and their sum.

    Output rows ``(group, check, statistic, df, p)``.  ``order`` is the numeric column along which the variance may drift
    (only its order of magnitude matters: the statistic does not change under a linear map).
    """
    qx, qy, keys = sql_name(x), sql_name(y), [sql_name(b) for b in by]
    # r: standardised residual, g: fitted value about its mean, h: x about its mean, v: drift variable
    rows = _with_fit(df, by, x, y, fit).selectExpr(
        *keys, "_n", f"({qy} - _intercept - _slope * {qx}) / sqrt(_sse / _n) AS _r", f"_slope * ({qx} - _x_mean) AS _g",
        f"{qx} - _x_mean AS _h", f"CAST({sql_name(order)} AS DOUBLE) AS _v").where("_r IS NOT NULL")
    sums = rows.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        *[F.expr(f"sum({e}) AS {name}") for name, e in (
            ("_r3", "_r * _r * _r"), ("_r4", "_r * _r * _r * _r - 3D"), ("_gr", "_g * _g * _r"),
            ("_g4", "_g * _g * _g * _g"), ("_g2", "_g * _g"), ("_gh", "_g * _g * _h"), ("_hh", "_h * _h"),
            ("_vr", "_v * (_r * _r - 1D)"), ("_r2", "_r * _r - 1D"), ("_v1", "_v"))],
        F.var_pop("_v").alias("_vv"))
    checks = sums.selectExpr(
        *keys, "_r3 * _r3 / (6D * _n) AS s1", "_r4 * _r4 / (24D * _n) AS s2",
        "(_gr * _gr / _n) / (_g4 / _n - (_g2 / _n) * (_g2 / _n) - (_gh / _n) * (_gh / _n) / (_hh / _n)) AS s3",
        "pow(_vr - _v1 / _n * _r2, 2) / (2D * _n * _vv) AS s4")
    out = checks.selectExpr(*keys, """inline(array(
        named_struct('check', 'global', 'statistic', s1 + s2 + s3 + s4, 'df', 4L),
        named_struct('check', 'skewness', 'statistic', s1, 'df', 1L),
        named_struct('check', 'kurtosis', 'statistic', s2, 'df', 1L),
        named_struct('check', 'link function', 'statistic', s3, 'df', 1L),
        named_struct('check', 'heteroscedasticity', 'statistic', s4, 'df', 1L)))""")
    return out.withColumn("p", chi2_upper("statistic", "df"))
