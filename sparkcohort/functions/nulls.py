"""Conditionals and text building with explicit missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def if_else_null(condition: Column, yes, no) -> Column:
    """Two-way choice that stays NULL when the condition is NULL (``when/otherwise`` would take the second value)."""
    return F.when(condition, yes).when(~condition, no)


def paste(*parts, missing: str = "NA") -> Column:
    """Concatenate values as text, printing ``missing`` for NULL."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit(missing)) for c in cols])


def fixed_text(value: Column, digits: int, suffix: str = "") -> Column:
    """A number rounded half to even with a fixed number of digits as text; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f{suffix}", F.bround(value, digits) + 0.0))


def present(value: Column) -> Column:
    """True when a measurement is neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def present_in(df: DataFrame, column: str) -> Column:
    """``present`` of a column of any type: only floating-point columns can hold NaN."""
    c = F.col(sql_name(column))
    return c.isNotNull() & ~F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNotNull()


def measured(df: DataFrame, column: str) -> Column:
    """The column with NaN as NULL."""
    return F.when(present_in(df, column), F.col(sql_name(column)))


def sql_text(value: str) -> str:
    """A string literal for use inside an SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column name for use inside an SQL expression."""
    return "`" + name.replace("`", "``") + "`"
