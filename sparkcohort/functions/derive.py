"""Column expressions that turn a participant record into analysis variables.

Everything here is a ``Column -> Column`` function built from Spark SQL functions, so it fuses into the scan stage.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcohort.functions.nulls import if_else_null

NON_REACTIVE = "NR"
DAY_MICROS = 86_400_000_000
YEAR_DAYS = 365.25


# --- titres ---------------------------------------------------------------------------------------------------------

def parse_titre(text: Column) -> Column:
    """``"NR"`` -> 0, ``"1/400"`` -> 400 (the number after the first slash), anything else -> NULL."""
    after_slash = F.substring(text, F.instr(text, "/") + 1, F.length(text))
    return F.when(text == NON_REACTIVE, F.lit(0.0)).when(text.contains("/"), after_slash.try_cast("double"))


def qualitative(titre: Column) -> Column:
    """``NR`` for a zero titre, ``R`` for any other, NULL for a missing one."""
    return if_else_null(titre == 0, NON_REACTIVE, "R")


def floor_zero_to_one(value: Column) -> Column:
    """Zero becomes one so that a logarithm exists."""
    return if_else_null(value == 0, F.lit(1.0), value)


def floor_below_one(value: Column) -> Column:
    """Anything below one becomes one."""
    return if_else_null(value < 1, F.lit(1.0), value)


def pseudo_log(value: Column, base: float = 2.0, sigma: float = 10.0) -> Column:
    """Signed log axis that is linear around zero: ``asinh(x / (2 sigma)) / ln(base)``."""
    half = F.abs(value) / (2.0 * sigma)
    # ln(h + sqrt(h^2 + 1)) on |x| keeps precision for negative x
    magnitude = F.ln(half + F.sqrt(half * half + 1.0)) / math.log(base)
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def pseudo_log_inverse(axis: Column, base: float = 2.0, sigma: float = 10.0) -> Column:
    return F.sinh(axis * math.log(base)) * (2.0 * sigma)


# --- text -----------------------------------------------------------------------------------------------------------

def sentence_case(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def site_from_id(id_: Column, pattern: str, matched: str, other: str) -> Column:
    return if_else_null(id_.rlike(pattern), matched, other)


def recode(value: Column, mapping: Mapping[str, object], keep_other: bool = False) -> Column:
    """Map listed values; others become NULL, or stay as they are with ``keep_other``."""
    out = None
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)) if out is None else out.when(value == old, F.lit(new))
    if out is None:
        return value if keep_other else F.lit(None)
    return out.otherwise(value) if keep_other else out


# --- dates ----------------------------------------------------------------------------------------------------------

def fractional_days(start: Column, end: Column) -> Column:
    """Signed length of ``start .. end`` in days of 86,400 seconds."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / float(DAY_MICROS)


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(fractional_days(start, end))


def whole_years(start: Column, end: Column) -> Column:
    """Completed years of 365.25 days, which is not the calendar age."""
    return F.floor(fractional_days(start, end) / YEAR_DAYS)


def age_at(birth: Column, reference: Column, declared: Column, use_dates: Column) -> Column:
    """Age from dates where ``use_dates`` holds, the declared age elsewhere, NULL where the rule itself is unknown."""
    return if_else_null(use_dates, whole_years(birth, reference).cast("double"), declared.cast("double"))


# --- groups ---------------------------------------------------------------------------------------------------------

def age_band(age: Column, cut: int = 80, unit: str = "years") -> Column:
    return if_else_null(age < cut, f"< {cut} {unit}", f">= {cut} {unit}")


def bucketize(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: ``labels[0]`` below ``edges[0]``, ``labels[-1]`` from ``edges[-1]`` on."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    out = F.when(value < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        out = out.when(value < edge, F.lit(label))
    return out.when(value >= edges[-1], F.lit(labels[-1]))


def trunc_number(value: Column) -> Column:
    """Drop the fraction, towards zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


# --- prior exposure: three definitions -------------------------------------------------------------------------------

def exposed_declared_or_baseline(declared: Column, baseline: Column) -> Column:
    """Declared history, corrected to ``SI`` when it says ``NO`` but the baseline sample is reactive."""
    return if_else_null((declared == "NO") & (baseline > 0), "SI", declared)


def exposed_serological(baseline: Column) -> Column:
    """``NO`` for a non-reactive baseline, ``SI`` otherwise, NULL without a baseline."""
    return if_else_null(baseline == 0, "NO", "SI")


def exposed_either(declared: Column, serological: Column, yes: str = "Yes", no: str = "No") -> Column:
    """Either source says ``SI`` (Kleene logic, so one NULL next to a ``NO`` stays NULL)."""
    return if_else_null((declared == "SI") | (serological == "SI"), yes, no)


# --- result text ----------------------------------------------------------------------------------------------------

SIGNIFICANCE_CUTS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*"))


def significance_code(p: Column, cuts: Sequence[tuple[float, str]] = SIGNIFICANCE_CUTS, other: str = "ns") -> Column:
    """Star code of a p-value; ``cuts`` are (upper bound inclusive, code) in increasing order."""
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for bound, code in cuts:
        out = out.when(p <= bound, F.lit(code))
    return out.otherwise(F.lit(other))
