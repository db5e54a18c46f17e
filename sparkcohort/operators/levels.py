"""Ordered categorical columns: a fixed list of levels gives the domain, the order and the display order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LEVELS = 64


def in_levels(value: Column, levels: Sequence[str]) -> Column:
    """Keep values that are levels, NULL otherwise."""
    return F.when(value.isin(list(levels)), value)


def level_ord(value: Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in ``levels`` (NULL when it is not a level)."""
    out = F.when(value == levels[0], F.lit(1))
    for i, level in enumerate(levels[1:], start=2):
        out = out.when(value == level, F.lit(i))
    return out


def apply_levels(df: DataFrame, column: str, levels: Sequence[str], ord_column: str | None = None,
                 drop_other: bool = False) -> DataFrame:
    """Restrict ``column`` to ``levels``; optionally add its order and drop rows outside the domain."""
    out = df.where(F.col(column).isin(list(levels))) if drop_other else df
    out = out.withColumn(column, in_levels(F.col(column), levels))
    return out if ord_column is None else out.withColumn(ord_column, level_ord(F.col(column), levels))


def level_table(spark: SparkSession, levels: Sequence[str], column: str = "level", ord_column: str = "ord") -> DataFrame:
    """The levels as a table, for joins that must keep empty levels."""
    rows = [(level, i) for i, level in enumerate(levels, start=1)]
    return spark.createDataFrame(rows, f"`{column}` string, `{ord_column}` int")


def known_levels(df: DataFrame, column: str, levels: Sequence[str] | None, limit: int = MAX_LEVELS) -> list[str]:
    """``levels`` as given, or the distinct values in alphabetical order when the column has few of them."""
    if levels is not None:
        return list(levels)
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; pass its levels")
    return [r[0] for r in rows]


def level_pairs(levels: Sequence[str]) -> list[tuple[int, int]]:
    """All 0-based index pairs (i, j) with i < j, in display order."""
    return [(i, j) for i in range(len(levels)) for j in range(i + 1, len(levels))]
