"""Baseline characteristics by group, as one tidy frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.nulls import fixed_text, paste, present
from sparkcohort.operators.contingency import SIMULATIONS, independence_test
from sparkcohort.operators.describe import percent_text, stack_columns
from sparkcohort.operators.ranks import quantiles
from sparkcohort.operators.ranktests import k_sample
from sparkcohort.session import join_groups, settle


OVERALL = "overall"


def categorical_counts(df: DataFrame, by: str, columns: Sequence[str], overall: bool = False) -> DataFrame:
    """(variable, level, by, n) of several text columns in one pass; rows with a missing group are dropped.

    ``overall`` adds the counts over all groups, under a NULL group, as a second grouping set of the same pass.
    """
    rows = stack_columns(df.where(F.col(by).isNotNull()), [by], columns, "variable", "level", "string")
    keys = [F.col(c) for c in ("variable", "level", by)]
    grouped = rows.groupingSets([keys, keys[:2]], *keys) if overall else rows.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*keys, "n")


def baseline_table(df: DataFrame, by: str, categorical: Sequence[str] = (), continuous: Sequence[str] = (),
                   missing: bool = True, percent_digits: int = 0, number_digits: int = 0,
                   counts: DataFrame | None = None, overall: bool = False, overall_label: str = OVERALL) -> DataFrame:
    """Rows ``(variable, level, <by>, kind, n, percent, p25, median, p75, n_present, text)``.

    Categorical variables give n and the share of the non-missing values of their group, continuous ones the median and
    quartiles.  ``n_present`` is the number of non-missing values of the variable over all groups.  ``missing`` keeps a
    row (level NULL, kind ``unknown``) with the number of missing values where there are any.  ``counts`` takes
    ``categorical_counts`` made before, with the same ``overall``.

    ``overall`` adds the rows of all groups together, of the rows that have a group, from the same expanded scan; the group column
    becomes text and reads ``overall_label`` there, which is no group's own name.
    """
    parts = []
    # while it is worked out, the overall column is the NULL group: rows without a group are out
    grouped = F.col(by).isNotNull()
    if categorical:
        counts = counts if counts is not None else categorical_counts(df, by, categorical, overall)
        known = F.col("level").isNotNull()
        shown = counts.withColumns({
            "percent": F.when(known, F.col("n") / F.sum(F.when(known, F.col("n"))).over(
                Window.partitionBy("variable", by))),
            "n_present": F.coalesce(F.sum(F.when(known & grouped, F.col("n"))).over(Window.partitionBy("variable")),
                                    F.lit(0).cast("long"))})
        text = paste(F.col("n"), " (", percent_text(F.col("percent"), percent_digits), ")")
        parts.append(shown.select(
            "variable", "level", by, F.when(known, "categorical").otherwise("unknown").alias("kind"), "n", "percent",
            *[F.lit(None).cast("double").alias(c) for c in ("p25", "median", "p75")], "n_present",
            F.when(known, text).otherwise(F.col("n").cast("string")).alias("text")))
    if continuous:
        long = stack_columns(df.where(F.col(by).isNotNull()), [by], continuous)
        if overall:
            long = long.select("variable", F.explode(F.array(F.col(by), F.lit(None))).alias(by), "value")
        points = quantiles(long, ["variable", by], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
        median, low, high = (fixed_text(F.col(c), number_digits) for c in ("median", "p25", "p75"))
        text = paste(median, " (", low, ", ", high, ")")
        parts.append(points.select(
            "variable", F.lit(None).cast("string").alias("level"), by, F.lit("continuous").alias("kind"), "n",
            F.lit(None).cast("double").alias("percent"), "p25", "median", "p75",
            F.sum(F.when(grouped, F.col("n"))).over(Window.partitionBy("variable")).alias("n_present"), text.alias("text")))
        if missing:
            gaps = (long.groupBy("variable", by).agg(
                F.count_if(~present(F.col("value"))).alias("n"), F.count_if(present(F.col("value"))).alias("_present"))
                .withColumn("n_present", F.sum(F.when(grouped, F.col("_present"))).over(Window.partitionBy("variable"))).where("n > 0"))
            parts.append(gaps.select(
                "variable", F.lit(None).cast("string").alias("level"), by, F.lit("unknown").alias("kind"), "n",
                *[F.lit(None).cast("double").alias(c) for c in ("percent", "p25", "median", "p75")], "n_present",
                F.col("n").cast("string").alias("text")))
    if not parts:
        raise ValueError("no variables given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if overall:
        out = out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(overall_label)))
    return out if missing else out.where("kind != 'unknown'")


def baseline_tests(df: DataFrame, by: str, categorical: Sequence[str], method: str = "exact",
                   simulations: int = SIMULATIONS, seed: int = 1, counts: DataFrame | None = None,
                   continuous: Sequence[str] = ()) -> DataFrame:
    """(variable, test, statistic, p, min_expected) of each variable against the groups.

    Categorical variables get the usual choice of ``independence_test``, continuous ones the k-sample rank test.
    """
    parts = []
    if categorical:
        counts = counts if counts is not None else categorical_counts(df, by, categorical)
        parts.append(independence_test(counts.where("level IS NOT NULL"), ["variable"], "level", by, method=method,
                                       simulations=simulations, seed=seed))
    if continuous:
        ranked = k_sample(stack_columns(df, [by], continuous), ["variable"], by, "value")
        parts.append(ranked.select("variable", F.when(F.col("statistic").isNotNull(), "k-sample rank").alias("test"), "statistic", "p",
                                   F.lit(None).cast("double").alias("min_expected")))
    if not parts:
        raise ValueError("no variables given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def baseline_table_with_tests(df: DataFrame, by: str, categorical: Sequence[str], continuous: Sequence[str] = (),
                              method: str = "exact", test_continuous: bool = False, overall: bool = False, **kw) -> DataFrame:
    """``baseline_table`` with the test of its variable on every row; the counts are taken once for both.

    ``test_continuous`` adds the k-sample rank test to the rows of continuous variables.
    """
    counts = settle(categorical_counts(df, by, categorical, overall))
    table = baseline_table(df, by, categorical, continuous, counts=counts, overall=overall, **kw)
    tests = baseline_tests(df, by, categorical, method, counts=counts.where(F.col(by).isNotNull()), continuous=continuous if test_continuous else ()).select("variable", "test", "p")
    return join_groups(table, tests, ["variable"], "left")
