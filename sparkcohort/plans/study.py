"""The analyses of a repeated-measures vaccine-response cohort, end to end, on top of the operators.

``raw`` frames follow ``sources.tables.COHORT_SCHEMA`` (or a part of it).  Group levels are arguments everywhere, so another
study brings its own.  Strata are columns: all panels of one figure are one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.derive import (age_at, age_band, exposed_either, exposed_serological, floor_below_one, floor_zero_to_one, fractional_days,
                                          parse_titre, qualitative, recode, sentence_case, site_from_id, trunc_number,
                                          whole_days)
from sparkcohort.functions.nulls import if_else_null, present
from sparkcohort.operators import describe, ranktests, regress, resample, tableone
from sparkcohort.operators.corr import correlation_text, spearman
from sparkcohort.operators.levels import apply_levels, in_levels, level_ord
from sparkcohort.operators.ranks import COUNT, prefix_counts, quantiles, quantiles_of_counts
from sparkcohort.operators.reshape import complete_cases, join_assay, to_long
from sparkcohort.session import join_groups

# Spellings and display names of the cohort.
# Time points: titre text column -> name, in time order.
MOMENTS = {"titre_0": "baseline", "titre_21": "after_dose1", "titre_42": "after_dose2", "titre_120": "after_120",
           "titre_180": "after_180"}
ASSAY_MOMENTS = {"neu_post_d1": "after_dose1", "neu_post_d2": "after_dose2", "neu_post_120": "after_120",
                 "neu_post_180": "after_180"}
VACCINES = ("Sputnik-V", "Sinopharm", "Oxford-Astra Zeneca")
VACCINE_SPELLING = {"Sputnik V": "Sputnik-V"}
VACCINE_LABELS = {"Sputnik-V": "Sputnik V", "Sinopharm": "COVID-19 BIBP", "Oxford-Astra Zeneca": "AZD1222"}
COMORBIDITY_LABELS = {"diabetes": "Mellitus diabetes", "copd": "COPD", "severe_obesity": "Severe obesity",
                      "heart_failure": "Heart failure", "hypertension": "HTN", "kidney": "Chronic kidney disease",
                      "immunodef": "Immunodeficiency"}


def derive(raw: DataFrame, first_site: str = "MDP", other_site: str = "LA PLATA/LANUS") -> DataFrame:
    """Site, age, age group, numeric titres, sampling delays and normalised text, for the columns that are there."""
    have = set(raw.columns)
    new = {name: parse_titre(F.col(text)) for text, name in MOMENTS.items() if text in have}
    new["site"] = site_from_id(F.col("id"), "^A", first_site, other_site)
    for name, start, end in (("delay1", "sample_0_date", "sample_21_date"), ("delay2", "sample_21_date", "sample_42_date")):
        if {start, end} <= have:
            new[name] = whole_days(F.col(start), F.col(end))
    if "prior_covid" in have:
        new["prior_covid"] = F.upper("prior_covid")
    if "vaccine" in have:
        new["vaccine"] = recode(F.col("vaccine"), VACCINE_SPELLING, keep_other=True)
    out = raw.withColumns(new)
    if {"birth_date", "sample_0_date", "age"} <= have:
        out = out.withColumn("age", age_at(F.col("birth_date"), F.col("sample_0_date"), F.col("age"),
                                           F.col("site") == first_site))
    return out.withColumn("age_group", age_band(F.col("age"))) if "age" in have else out


def moments_of(df: DataFrame) -> list[str]:
    return [m for m in MOMENTS.values() if m in df.columns]


def complete_cohort(cohort: DataFrame, vaccines: Sequence[str] = VACCINES) -> DataFrame:
    """Participants measured at every time point, with serological exposure and the vaccine restricted to its levels."""
    return complete_cases(cohort, moments_of(cohort)).withColumns({
        "exposed": exposed_serological(F.col("baseline")), "vaccine": in_levels(F.col("vaccine"), vaccines)})


def available_cohort(cohort: DataFrame, vaccines: Sequence[str] = VACCINES, min_age: float = 60.0) -> DataFrame:
    """Participants from ``min_age`` on, complete or not: every single measurement counts."""
    return cohort.where(F.col("age") >= min_age).withColumns({
        "exposed": exposed_serological(F.col("baseline")), "vaccine": in_levels(F.col("vaccine"), vaccines)})


def titre_long(cohort: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, moment, titre, titre_qual, ord): one row per participant and time point, missing cells kept."""
    moments = moments_of(cohort)
    return to_long(cohort, ids, moments, "moment", "titre").withColumns({
        "titre_qual": qualitative(F.col("titre")), "ord": level_ord(F.col("moment"), moments)})


def assay_long(assay: DataFrame, value: str = "titre2") -> DataFrame:
    """Second assay in long form with the time points named as in the first one."""
    columns = [c for c in ASSAY_MOMENTS if c in assay.columns]
    long = to_long(assay, ["id"], columns, "moment", value)
    return long.withColumn("moment", recode(F.col("moment"), ASSAY_MOMENTS))


def two_assays(titres: DataFrame, assay: DataFrame) -> DataFrame:
    """Both assays side by side per (participant, time point)."""
    return join_assay(titres, assay, ["id", "moment"])


def is_naive() -> Column:
    """No exposure by either definition."""
    return (F.col("exposed") == "NO") & (F.col("prior_covid") == "NO")


def is_not_naive() -> Column:
    """Exposure not excluded: either definition differs from NO (NO beside a missing answer is unknown)."""
    return (F.col("exposed") != "NO") | (F.col("prior_covid") != "NO")


def is_exposed() -> Column:
    """Exposure shown by either definition (a missing answer does not matter beside SI)."""
    return (F.col("exposed") == "SI") | (F.col("prior_covid") == "SI")


def naive(df: DataFrame) -> DataFrame:
    return df.where(is_naive())


def not_naive(df: DataFrame) -> DataFrame:
    return df.where(is_not_naive())


def exposed(df: DataFrame) -> DataFrame:
    return df.where(is_exposed())


# --- panels ---------------------------------------------------------------------------------------------------------

def within_group_over_time(long: DataFrame, group: Sequence[str], moments: Sequence[str], **kw) -> DataFrame:
    """Paired pairwise comparison of all time points within each group."""
    return ranktests.pairwise_signed_rank(long, group, "id", "moment", "titre", moments, **kw)


def displayed_comparisons(tests: DataFrame, group: Sequence[str],
                          pairs: Sequence[tuple[int, int]] = ranktests.CONSECUTIVE_AND_FIRST_THIRD) -> DataFrame:
    """The comparisons a panel shows, numbered in display order, chosen after adjustment."""
    return ranktests.number_rows(ranktests.display_pairs(tests, pairs), [*group, "position"])


def between_groups_by_moment(long: DataFrame, strata: Sequence[str], group: str, levels: Sequence[str],
                             value: str = "titre", flat_moment: str | None = None, **kw) -> DataFrame:
    """Unpaired comparison of groups at each time point.

    ``flat_moment`` names a time point that is zero for everybody: it is not tested and gets fixed ``ns`` rows.
    """
    rows = long if flat_moment is None else long.where(F.col("moment") != flat_moment)
    tests = ranktests.pairwise_rank_sum(rows, [*strata, "moment"], group, value, levels, **kw)
    if flat_moment is None:
        return tests
    if strata:
        raise ValueError("fixed rows are only defined for a single panel")
    fixed = [{"moment": flat_moment, "group1": a, "group2": b, "ord1": i + 1, "ord2": j + 1, "p_signif": "ns",
              "p_adj_signif": "ns"}
             for i, a in enumerate(levels) for j, b in enumerate(levels) if i < j]
    return ranktests.with_placeholder(tests, fixed)


def medians_by_moment(long: DataFrame, group: Sequence[str]) -> DataFrame:
    return quantiles(long, [*group, "moment"], "titre", {"median": 0.5})


def geometric_mean_table(long: DataFrame, group: Sequence[str], value: str = "titre", key: str | None = None,
                         replicates: int = 10_000, below_one: bool = False, **kw) -> DataFrame:
    """(moment, group, n, geo_mean, lower, upper) of measured values, floored for the logarithm."""
    x = F.col(value)
    floored = floor_below_one(x) if below_one else floor_zero_to_one(x)
    return resample.bootstrap_geometric_mean(long.where(x.isNotNull()).withColumn(value, floored), ["moment", *group],
                                             value, replicates, key=key, **kw)


# --- two assays and age -----------------------------------------------------------------------------------------------

def assay_agreement(both: DataFrame, by: Sequence[str] = ("moment",)) -> DataFrame:
    """Rank correlation of the two assays per time point with its text; zero titres count as one."""
    rows = both.where(F.col("titre2").isNotNull()).withColumn(
        "titre", floor_zero_to_one(F.col("titre")))
    return correlation_text(spearman(rows, list(by), "titre", "titre2"))


def age_correlation(both: DataFrame, value: str, by: Sequence[str] = ("vaccine",), moment: str = "after_dose2") -> DataFrame:
    """Rank correlation of whole years of age with a measurement at one time point."""
    rows = both.where(F.col("moment") == moment).withColumn("age", trunc_number(F.col("age")))
    return correlation_text(spearman(rows, list(by), "age", value))


def age_regression_rows(both: DataFrame, moment: str = "after_dose2") -> DataFrame:
    """Rows of the log-linear age model: unexposed participants at one time point, zero titres as one."""
    rows = naive(both.where(F.col("moment") == moment))
    floored = floor_zero_to_one(F.col("titre"))
    return rows.withColumn("age", trunc_number(F.col("age"))).withColumn("log_titre", F.ln(floored))


def age_regression(both: DataFrame, moment: str = "after_dose2") -> DataFrame:
    return regress.ols(age_regression_rows(both, moment), [], "age", "log_titre")


# --- tables -----------------------------------------------------------------------------------------------------------

def characteristics(cohort: DataFrame, vaccine_labels: Mapping[str, str] = VACCINE_LABELS, unknown: str | None = "No data",
                    comorbidities: Mapping[str, str] = COMORBIDITY_LABELS, missing: bool = False) -> DataFrame:
    """Baseline characteristics by vaccine with tests: sex, age group, exposure and comorbidities.

    ``unknown`` is the level given to missing comorbidities; ``None`` leaves them out of the table.  ``missing`` adds a row
    with the number of missing values of a variable where there are any.
    """
    present = {c: label for c, label in comorbidities.items() if c in cohort.columns}

    def answer(column: str):
        text = sentence_case(F.col(column))
        yes = if_else_null(text == "Si", "Yes", text)
        return F.coalesce(yes, F.lit(unknown)) if unknown is not None else yes

    rows = cohort.select(
        recode(F.col("vaccine"), vaccine_labels).alias("vaccine"),
        if_else_null(F.col("sex") == "Femenino", "Female", "Male").alias("Gender"),
        sentence_case(F.col("age_group")).alias("Age"),
        exposed_either(F.col("prior_covid"), F.col("exposed")).alias("Previous exposure"),
        *[answer(c).alias(label) for c, label in present.items()])
    return tableone.baseline_table_with_tests(rows, "vaccine", [c for c in rows.columns if c != "vaccine"], missing=missing)


def interval_summary(cohort: DataFrame, by: str, start: str, end: str, name: str) -> DataFrame:
    """min, max, mean and quartiles of the days between two dates by group; a missing group is a group.

    Everything comes from the counts of distinct intervals, so the rows behind them are read once.
    """
    days = cohort.select(by, fractional_days(F.col(start), F.col(end)).alias(name))
    counts = days.groupBy(by, name).agg(F.count(F.lit(1)).alias(COUNT))
    ranked = prefix_counts(counts.where(present(F.col(name))), [by], name, source=days)
    weighted = F.sum(F.col(name) * F.col(COUNT)) / F.sum(COUNT)
    points = quantiles_of_counts(ranked, [by], name, {f"p25_{name}": 0.25, f"median_{name}": 0.5, f"p75_{name}": 0.75}, [
        F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"), weighted.alias(f"mean_{name}")])
    every = join_groups(counts.select(by).distinct(), points, [by], "left")
    return every.select(by, *[f"{s}_{name}" for s in ("min", "max", "mean", "p25", "median", "p75")],
                         (F.col(f"p75_{name}") - F.col(f"p25_{name}")).alias(f"iqr_{name}"))


def vaccine_levels(df: DataFrame, vaccines: Sequence[str] = VACCINES) -> DataFrame:
    """Rows of a known vaccine with its display order."""
    return apply_levels(df, "vaccine", vaccines, "vaccine_ord", drop_other=True)
