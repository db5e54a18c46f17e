"""Column selection, wide/long reshaping, completeness and joins of assay tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.functions.nulls import present


# --- columns --------------------------------------------------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_at(df: DataFrame, first: int, last: int) -> list[str]:
    """Column names by 1-based position, both ends included."""
    return df.columns[first - 1:last]


def across(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to several columns."""
    return df.withColumns({c: change(F.col(c)) for c in columns})


def single_value(value: Column) -> Column:
    """Aggregate: the only present value of a group, NULL without one; more than one is an error."""
    return F.when(F.count(value) > 1, F.raise_error(F.lit("several values for one id and level"))).otherwise(F.max(value))


# --- wide and long --------------------------------------------------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "moment",
            value: str = "value") -> DataFrame:
    """One row per (row, measured column); missing cells are kept."""
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], level: str, value: str, levels: Mapping[str, str]) -> DataFrame:
    """One column per level (level -> column name).  The levels are given, so one aggregation is enough.

    ``(ids, level)`` has to be unique among the present values; a second one stops the job.
    """
    return df.groupBy(*ids).agg(*[single_value(F.when(F.col(level) == l, F.col(value))).alias(c) for l, c in levels.items()])


def counts_wide(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Cross-tabulated counts with one column per listed level, empty cells as zero."""
    return df.groupBy(row).pivot(column, list(levels)).count().na.fill(0, list(levels))


# --- completeness ---------------------------------------------------------------------------------------------------

def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a wide table with every listed measurement present (a filter: nothing is shuffled)."""
    return df.na.drop(how="any", subset=list(columns))


def incomplete_ids(df: DataFrame, id_: str, value: str) -> DataFrame:
    """Distinct ids of a long table with at least one missing measurement."""
    return df.where(~present(F.col(value)) | F.col(value).isNull()).select(id_).distinct()


def complete_cases_long(df: DataFrame, id_: str, value: str) -> DataFrame:
    """Rows of a long table whose participant has no missing measurement."""
    return df.join(incomplete_ids(df, id_, value), id_, "left_anti")


# --- joins ----------------------------------------------------------------------------------------------------------

def join_assay(df: DataFrame, assay: DataFrame, on: Sequence[str] | Mapping[str, str], how: str = "left") -> DataFrame:
    """Equi-join a second table; ``on`` is a list of shared names or a left -> right mapping of key names."""
    if isinstance(on, Mapping):
        assay = assay.withColumnsRenamed({right: left for left, right in on.items()})
        on = list(on)
    return df.join(assay, list(on), how)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_positions(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Drop rows by 1-based position in the order of a unique key.

    Only the rows up to the last position are ranked (a distributed top-k), the rest of the table is not sorted.  A missing
    key comes first and is a key like any other.
    """
    if not positions:
        return df
    head = (df.select(*order).orderBy(*order).limit(max(positions))
            .withColumn("_position", F.row_number().over(Window.orderBy(*order)))
            .where(F.col("_position").isin(list(positions))).drop("_position"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(f"_row.{c}").eqNullSafe(F.col(f"_drop.{c}"))
    # at most len(positions) rows are broadcast
    return df.alias("_row").join(F.broadcast(head).alias("_drop"), same, "left_anti")


def level_pairs_frame(df: DataFrame, ids: Sequence[str], level: str, value: str, pairs: Sequence[tuple[str, str]],
                      names: tuple[str, str] = ("value1", "value2")) -> DataFrame:
    """A participant's value at level i beside the value at level j, for the listed pairs; both must be present."""
    levels = list(dict.fromkeys(l for pair in pairs for l in pair))
    wide = to_wide(df, ids, level, value, {l: f"_v{i}" for i, l in enumerate(levels)})
    at = {l: f"_v{i}" for i, l in enumerate(levels)}
    return (wide.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2"), F.col(at[a]).alias(names[0]),
                 F.col(at[b]).alias(names[1])) for a, b in pairs])).alias("_p"))
        .select(*ids, "_p.*").where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()))
