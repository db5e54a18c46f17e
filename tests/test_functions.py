"""Scalar rules, above all what happens to missing values."""

import math
from datetime import datetime
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from sparkcohort.functions import derive
from sparkcohort.functions.draws import PRIME, poisson_thresholds
from sparkcohort.functions.nulls import if_else_null, paste
from sparkcohort.functions.tails import chi2_upper, erfc, normal_quantile, normal_two_sided, student_t_two_sided


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_titre_parse_takes_text_after_first_slash(spark):
    texts = ["NR", "1/400", "1/50", "1/4/5", "abc", "", None, "400", "1/", "1/x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(df, derive.parse_titre(F.col("t"))) == [0.0, 400.0, 50.0, None, None, None, None, None, None, None]


def test_two_way_choice_keeps_unknown(spark):
    df = spark.createDataFrame([(79.0,), (80.0,), (None,)], "age double")
    assert column(df, derive.age_band(F.col("age"))) == ["< 80 years", ">= 80 years", None]
    assert column(df, if_else_null(F.col("age") < 80, "a", "b")) == ["a", "b", None]


def test_exposure_rules_and_kleene_logic(spark):
    rows = [("NO", 0.0), ("NO", 50.0), ("SI", 0.0), (None, 50.0), (None, 0.0), ("NO", None), ("SI", None)]
    df = spark.createDataFrame(rows, "declared string, baseline double")
    serological = derive.exposed_serological(F.col("baseline"))
    assert column(df, serological) == ["NO", "SI", "NO", "SI", "NO", None, None]
    assert column(df, derive.exposed_declared_or_baseline(F.col("declared"), F.col("baseline"))) == [
        "NO", "SI", "SI", None, None, None, "SI"]
    assert column(df, derive.exposed_either(F.col("declared"), serological)) == [
        "No", "Yes", "Yes", "Yes", None, None, "Yes"]


def test_floors_and_qualitative(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (50.0,), (None,)], "x double")
    assert column(df, derive.floor_zero_to_one(F.col("x"))) == [1.0, 0.4, 50.0, None]
    assert column(df, derive.floor_below_one(F.col("x"))) == [1.0, 1.0, 50.0, None]
    assert column(df, derive.qualitative(F.col("x"))) == ["NR", "R", "R", None]


def test_sentence_case_and_paste(spark):
    df = spark.createDataFrame([("ÓBITO fuera DE hora",), ("x",), ("",), (None,)], "t string")
    assert column(df, derive.sentence_case(F.col("t"))) == ["Óbito fuera de hora", "X", "", None]
    assert column(df, paste("n = ", F.col("t"))) == ["n = ÓBITO fuera DE hora", "n = x", "n = ", "n = NA"]


def test_dates(spark):
    rows = [(datetime(1940, 3, 1), datetime(2021, 3, 1)), (datetime(2021, 3, 1, 12), datetime(2021, 2, 27)),
            (None, datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    a, b = F.col("a"), F.col("b")
    # 81 calendar years are 29,585 days: one 365.25-day year short of 81 by a quarter of a day
    assert column(df, derive.whole_years(a, b)) == [math.floor(29585 / 365.25), -1, None]
    assert column(df, derive.fractional_days(a, b)) == [29585.0, -2.5, None]
    assert column(df, derive.whole_days(a, b)) == [29585, -3, None]


def test_rounding_and_truncation(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-2.7,)], "x double")
    assert column(df, derive.round_half_even(F.col("x"), 2)) == [0.12, 0.38, 2.5, -2.7]
    assert column(df, derive.trunc_number(F.col("x"))) == [0.0, 0.0, 2.0, -2.0]


def test_pseudo_log_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (-35.0,), (50.0,), (819200.0,)], "x double")
    back = column(df, derive.pseudo_log_inverse(derive.pseudo_log(F.col("x"))))
    assert back == pytest.approx([0.0, -35.0, 50.0, 819200.0])
    assert column(df, derive.pseudo_log(F.col("x")))[2] == pytest.approx(math.asinh(2.5) / math.log(2))


def test_bands_recode_and_stars(spark):
    df = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (9.0, "c"), (None, None)], "x double, t string")
    assert column(df, derive.bucketize(F.col("x"), [5, 9], ["lo", "mid", "hi"])) == ["lo", "mid", "hi", None]
    assert column(df, derive.recode(F.col("t"), {"a": "A"})) == ["A", None, None, None]
    assert column(df, derive.recode(F.col("t"), {"a": "A"}, keep_other=True)) == ["A", "b", "c", None]
    p = spark.createDataFrame([(1e-5,), (1e-3,), (0.01,), (0.05,), (0.06,), (None,)], "p double")
    assert column(p, derive.significance_code(F.col("p"))) == ["****", "***", "**", "*", "ns", None]


def student_tail(t, df, steps=4000):
    """Two-sided tail by Simpson's rule over the angle atan(t / sqrt(df))."""
    start, h = math.atan(t / math.sqrt(df)), (math.pi / 2 - math.atan(t / math.sqrt(df))) / steps
    weights = [1 if i in (0, steps) else 4 if i % 2 else 2 for i in range(steps + 1)]
    area = h / 3 * sum(w * abs(math.cos(start + i * h)) ** (df - 1) for i, w in enumerate(weights))
    return 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_tails_against_known_values(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -0.2, 0.0, 0.4, 1.5, 5.0, 20.0)], "x double")
    assert column(df, erfc("x")) == pytest.approx([math.erfc(x) for x in (-3.0, -0.2, 0.0, 0.4, 1.5, 5.0, 20.0)], rel=1e-12)
    assert column(df, normal_two_sided("x"))[0] == pytest.approx(0.0026997960632601866, rel=1e-12)
    probs = [1e-12, 0.025, 0.5, 0.9, 1 - 1e-9]
    p = spark.createDataFrame([(x,) for x in probs], "p double")
    assert column(p, normal_quantile("p")) == pytest.approx([NormalDist().inv_cdf(x) for x in probs], rel=1e-12)
    cases = [(2.0, 5), (12.706204736, 1), (1.96, 1000), (2.5, 41), (2.5, 40), (0.0, 3), (0.7, 2)]
    t = spark.createDataFrame(cases, "t double, df long")
    assert column(t, student_t_two_sided("t", "df")) == pytest.approx([student_tail(*c) for c in cases], rel=1e-7)
    assert student_tail(12.706204736, 1) == pytest.approx(0.05, rel=1e-8)  # the 97.5% point of one degree of freedom
    c = spark.createDataFrame([(16.204683, 2), (3.841458821, 1), (9.487729037, 4), (7.814727903, 3), (0.0, 2)],
                              "x double, df long")
    assert column(c, chi2_upper("x", "df")) == pytest.approx([3.0283e-4, 0.05, 0.05, 0.05, 1.0], rel=1e-4)


def test_poisson_thresholds():
    bounds = poisson_thresholds()
    assert bounds[0] / PRIME == pytest.approx(math.exp(-1), abs=1e-8)
    assert all(a < b for a, b in zip(bounds[:9], bounds[1:10]))
