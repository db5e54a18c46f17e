"""Grouped summaries, frequency tables and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.nulls import fixed_text, measured, paste, present, present_in, sql_name, sql_text
from sparkcohort.operators.levels import level_table
from sparkcohort.operators.ranks import quantiles
from sparkcohort.operators.reshape import numeric_columns
from sparkcohort.session import join_groups


def group_counts(df: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Rows per group; a missing key is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def count_present(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-missing values of several columns, next to the number of rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               *[F.count(measured(df, c)).alias(f"n_{c}") for c in columns])


def range_and_mean(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """min, max and mean of every listed column by group, missing values skipped."""
    aggs = [f(measured(df, c)).alias(f"{name}_{c}") for c in values
            for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(*by).agg(*aggs)


def moments(df: DataFrame, by: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """Sample variance and standard deviation, and the sample covariance with a second column."""
    a = measured(df, x)
    aggs = [F.var_samp(a).alias(f"var_{x}"), F.stddev_samp(a).alias(f"sd_{x}")]
    if y is not None:
        b = measured(df, y)
        aggs += [F.var_samp(b).alias(f"var_{y}"), F.stddev_samp(b).alias(f"sd_{y}"), F.covar_samp(a, b).alias("cov")]
    return df.groupBy(*by).agg(*aggs)


def log_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of log10 and plain mean."""
    return df.groupBy(*by).agg(F.avg(F.log10(measured(df, value))).alias("mean_log10"), F.avg(measured(df, value)).alias("mean"))


def geometric_mean(df: DataFrame, by: Sequence[str], value: str, name: str = "geo_mean", n: str = "n") -> DataFrame:
    """exp(mean(ln x)) of positive values; floor zeros first."""
    return (df.where(present_in(df, value)).groupBy(*by)
            .agg(F.count(F.lit(1)).alias(n), F.exp(F.avg(F.ln(value))).alias(name)))


def percent_text(share: Column, digits: int = 1) -> Column:
    """``12.3%`` of a share between 0 and 1, rounded half to even."""
    return fixed_text(share * 100.0, digits, "%%")


def oneway_frequency(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """n, share of all rows and share of non-missing rows per value; missing is shown as its own row."""
    counts = group_counts(df, [column])
    totals = counts.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col(column).isNotNull(), F.col("n"))).alias("_valid"))
    return (join_groups(counts, totals, []).select(
        column, "n", (F.col("n") / F.col("_all")).alias("percent"),
        F.when(F.col(column).isNotNull(), F.col("n") / F.col("_valid")).alias("valid_percent"))
        .withColumn("percent_text", percent_text(F.col("percent"), digits)))


def crosstab(df: DataFrame, row: str, column: str, digits: int = 1) -> DataFrame:
    """Long two-way table with column shares: (row, column, n, percent, "p% (n)") of the non-empty cells."""
    return (group_counts(df, [row, column])
            .withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy(column)))
            .withColumn("text", paste(percent_text(F.col("percent"), digits), " (", F.col("n"), ")")))


def crosstab_wide(df: DataFrame, row: str, column: str, levels: Sequence[str], digits: int = 1) -> DataFrame:
    """Two-way table with one ``p% (n)`` column per listed level, empty cells shown as zero."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(column) == l).alias(f"_c{i}") for i, l in enumerate(levels)])
    totals = counts.agg(*[F.sum(f"_c{i}").alias(f"_t{i}") for i in range(len(levels))])
    cells = []
    for i, level in enumerate(levels):
        share = F.when(F.col(f"_t{i}") > 0, F.col(f"_c{i}") / F.col(f"_t{i}"))
        cells.append(paste(percent_text(share, digits), " (", F.col(f"_c{i}"), ")").alias(level))
    return join_groups(counts, totals, []).select(row, *cells)


def count_labels(df: DataFrame, level: str, template: str = "{label} (n = {n})", by: Sequence[str] = (),
                 labels: Mapping[str, str] | None = None, levels: Sequence[str] | None = None) -> DataFrame:
    """Display label with group size, keyed by level.  ``levels`` keeps empty levels (n = 0, only without ``by``)."""
    counts = group_counts(df.where(F.col(level).isNotNull()), [*by, level])
    if levels is not None:
        if by:
            raise ValueError("empty levels can be kept only for an ungrouped label table")
        counts = (level_table(df.sparkSession, levels, level, "ord").join(counts, level, "left")
                  .withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    shown = F.col(level)
    for value, text in (labels or {}).items():
        shown = F.when(F.col(level) == value, F.lit(text)).otherwise(shown)
    before, rest = template.split("{label}")
    middle, after = rest.split("{n}")
    return counts.withColumn("label", F.concat(F.lit(before), shown, F.lit(middle), F.col("n").cast("string"),
                                               F.lit(after)))


def missing_pareto(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, most frequent first, with the cumulative share of all missing values.

    One pass over the table counts every column; the rest works on one row per column.
    """
    columns = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(~present_in(df, c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    rows = ", ".join(f"named_struct('variable', {sql_text(c)}, 'n_missing', _m{i})" for i, c in enumerate(columns))
    order = Window.orderBy(F.col("n_missing").desc(), "variable")
    everything = Window.partitionBy()
    return counted.selectExpr("_rows", f"inline(array({rows}))").select(
        "variable", "n_missing",
        F.when(F.col("_rows") > 0, F.col("n_missing") / F.col("_rows")).alias("ratio"),
        F.row_number().over(order).alias("position"),
        F.when(F.sum("n_missing").over(everything) > 0,
               F.sum("n_missing").over(order.rowsBetween(Window.unboundedPreceding, 0))
               / F.sum("n_missing").over(everything)).alias("cumulative"))


def stack_columns(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "variable",
                  value: str = "value", type_: str = "double") -> DataFrame:
    """Long form of several columns cast to one type, without a self-join."""
    rows = ", ".join(f"named_struct('{name}', {sql_text(c)}, '{value}', CAST({sql_name(c)} AS {type_}))"
                     for c in columns)
    return df.selectExpr(*[sql_name(k) for k in keep], f"inline(array({rows}))")


PROFILE_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                    method: str = "two_pass") -> DataFrame:
    """Per numeric column: missing, complete rate, mean, sd, minimum, quartiles, maximum.

    Means and extremes of all columns are one aggregation of the wide table; the quartiles come from the stacked columns by
    the two-pass method, which shuffles cell counts and the few values around the quartiles.
    """
    columns = list(columns or [c for c in numeric_columns(df) if c not in by])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        v = f"nanvl(CAST({sql_name(c)} AS DOUBLE), NULL)"
        aggs += [F.expr(f"count({v}) AS _n{i}"), F.expr(f"avg({v}) AS _a{i}"), F.expr(f"stddev_samp({v}) AS _s{i}"),
                 F.expr(f"min({v}) AS _l{i}"), F.expr(f"max({v}) AS _h{i}")]
    rows = ", ".join(f"named_struct('variable', {sql_text(c)}, 'n_missing', _rows - _n{i}, "
                     f"'complete_rate', _n{i} / _rows, 'mean', _a{i}, 'sd', _s{i}, 'p0', _l{i}, 'p100', _h{i})"
                     for i, c in enumerate(columns))
    flat = df.groupBy(*by).agg(*aggs).selectExpr(*[sql_name(b) for b in by], f"inline(array({rows}))")
    points = quantiles(stack_columns(df, by, columns), [*by, "variable"], "value", PROFILE_PROBS, n=None, method=method)
    return join_groups(flat, points, [*by, "variable"], "left").select(
        *by, "variable", "n_missing", "complete_rate", "mean", "sd", "p0", "p25", "p50", "p75", "p100")


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with all listed measurements present (neither NULL nor NaN)."""
    for c in columns:
        df = df.where(present(F.col(c)))
    return df
