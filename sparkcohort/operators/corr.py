"""Rank correlation by group, with interval, p-value and display text."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.exact import SPEARMAN_MOST, spearman_exact_p
from sparkcohort.functions.nulls import fixed_text, paste, sql_name
from sparkcohort.functions.tails import student_t_two_sided
from sparkcohort.operators.describe import drop_missing
from sparkcohort.operators.ranks import CELL, COUNT, Cells, mid_rank, prefix_counts
from sparkcohort.session import join_groups


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, level: float = 0.95, standard_error: str = "fieller",
             exact_below: int = 0) -> DataFrame:
    """(group, n, rho, ci_low, ci_high, t, p): Pearson correlation of average ranks.

    Rows are first collapsed to distinct (x, y) pairs.  The ranks of x, one row per distinct value, meet the pairs in an
    equi-join; a value that many pairs share makes a large join partition, which the adaptive skew join splits.  The ranks of
    y need no join: the x ranks are summed up per value of y, and the sums are carried through the cells in which y is
    ranked.  The variable with fewer distinct values is the better ``x``.

    Groups of two to ``exact_below`` - 1 rows (``exact_below`` 15 at most) without ties in either variable get the p-value of all
    permutations: twice the smaller tail of the sum of squared rank differences.  Ties and larger groups keep the t distribution.
    """
    if exact_below > SPEARMAN_MOST:
        raise ValueError(f"the exact distribution is for fewer than {SPEARMAN_MOST} rows")
    pairs = (drop_missing(df, x, y).groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
             .agg(F.count(F.lit(1)).alias(COUNT)))
    x_counts = pairs.groupBy(*by, "_x").agg(F.sum(COUNT).alias(COUNT))
    plain = drop_missing(df, x, y).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    x_ranks = prefix_counts(x_counts, by, "_x", source=plain).select(*by, "_x", mid_rank().alias("_rx"))
    per_y = (join_groups(pairs, x_ranks, [*by, "_x"]).groupBy(*by, "_y")
             .agg(F.sum(COUNT).alias("_n"), F.expr(f"sum({COUNT} * _rx) AS _s"), F.expr(f"sum({COUNT} * _rx * _rx) AS _q")))
    in_cell = Window.partitionBy(*by, CELL).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    # _l: rank of the value within its cell
    local = (Cells(plain, by, "_y").add(per_y, "_y")
             .withColumn("_l", F.coalesce(F.sum("_n").over(in_cell), F.lit(0)) + (F.col("_n") + 1) / 2.0))
    cells = local.groupBy(*by, CELL).agg(*[F.expr(f"sum({e}) AS {name}") for name, e in (
        ("_N", "_n"), ("_S", "_s"), ("_Q", "_q"), ("_SL", "_s * _l"), ("_L", "_n * _l"), ("_LL", "_n * _l * _l"))])
    below = Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    sums = (cells.withColumn("_o", F.coalesce(F.sum("_N").over(below), F.lit(0)).cast("double"))
            .groupBy(*by).agg(*[F.expr(f"sum({e}) AS {name}") for name, e in (
                ("n", "_N"), ("_sx", "_S"), ("_sxx", "_Q"), ("_sxy", "_SL + _o * _S"),
                ("_syy", "_LL + 2D * _o * _L + _o * _o * _N"))]))
    # both rank columns have the same sum, n(n+1)/2
    covariance = "(_sxy - _sx * _sx / n)"
    spread = "((_sxx - _sx * _sx / n) * (_syy - _sx * _sx / n))"
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    se2 = {"fieller": "1.06D / (n - 3)", "bonett-wright": "(1D + rho * rho / 2D) / (n - 3)"}[standard_error]
    half = f"{z!r}D * sqrt({se2})"
    squares = ["CAST(_sxx + _syy - 2D * _sxy AS DOUBLE) AS _d"] if exact_below else []
    untied = [f"n BETWEEN 2 AND {exact_below - 1} AND _sxx = n * (n + 1) * (2 * n + 1) / 6D AND _syy = _sxx AS _exact"] if exact_below else []
    out = (sums.selectExpr(*[sql_name(b) for b in by], "n",
                           f"CASE WHEN {spread} > 0 THEN greatest(-1D, least(1D, {covariance} / sqrt({spread}))) END AS rho", *squares, *untied)
           .withColumns({
               "ci_low": F.expr(f"CASE WHEN n > 3 THEN tanh(atanh(rho) - {half}) END"),
               "ci_high": F.expr(f"CASE WHEN n > 3 THEN tanh(atanh(rho) + {half}) END"),
               "t": F.expr("CASE WHEN n > 2 AND abs(rho) < 1 THEN rho * sqrt((n - 2) / (1D - rho * rho)) END")})
           .withColumn("p", F.when((F.abs("rho") == 1) & (F.col("n") > 2), F.lit(0.0))
                       .otherwise(student_t_two_sided("t", "n - 2"))))
    if exact_below:
        out = out.withColumn("p", F.coalesce(spearman_exact_p("_d", "n", "_exact"), "p")).drop("_d", "_exact")
    return out


def correlation_text(result: DataFrame, name: str = "text", digits: int = 2, p_digits: int = 4,
                     alpha: float = 0.05) -> DataFrame:
    """``rho = 0.42, CI[0.31, 0.52], p < 0.05`` (the p-value itself when it is not below ``alpha``)."""
    p = F.when(F.col("p") < alpha, F.lit(f"p < {alpha}")).when(
        F.col("p") >= alpha, F.concat(F.lit("p = "), plain_number("p", p_digits)))
    return result.withColumn(name, paste("rho = ", plain_number("rho", digits), ", CI[", plain_number("ci_low", digits),
                                         ", ", plain_number("ci_high", digits), "], ", p))


def plain_number(column: str, digits: int):
    """A rounded number as text without trailing zeros or an exponent (0.5, 1, -0.07)."""
    fixed = fixed_text(F.col(column) + 0.0, digits)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")

