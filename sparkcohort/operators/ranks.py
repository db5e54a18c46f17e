"""Ranking and exact quantiles without putting a whole stratum into one task.

A window ordered by value over raw rows would sort one stratum in one task.  The operators here work in three steps:

1. *value counts*: ``groupBy(stratum, value).count()``; the map-side combine collapses repeated values, so a value that
   holds a third of the table is one row afterwards.
2. *cells*: every value falls into a cell, a non-decreasing number of the value made of the digits of the double itself: its
   sign and power of two with the first ``CELLS`` parts of the power (first digit), then 16 bits of the mantissa at a time.  A
   cell has one digit, and one more where it is crowded.  Sums per cell give the number of observations below each cell (one
   short window per stratum, whose rows are cells).
3. a window *inside* a cell adds the position within the cell.

Only step 3 sorts, over the distinct values of one cell, so a stratum is spread over as many tasks as it has cells.  Digits need
no range of the values, and a pass that counts cells shows which are crowded: one scan for a digit, usually one in all.
Nothing is sampled, hence the same answer when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.nulls import present, sql_name
from sparkcohort.session import broadcast_if_small, join_groups

CELLS = 1_024            # parts of a power of two
CROWDED = 100_000        # rows of a cell that gets one more digit
DIGIT = 65_536
DIGITS = 3               # the last leaves cells of at most a thousand different doubles

CELL = "_cell"
COUNT = "_count"
BEFORE = "_before"
TOTAL = "_total"


def _digits(df: DataFrame, value: str, cells: int) -> DataFrame:
    """``df`` with the first digit of each value in the cell column, and the sign and fraction that further digits come from."""
    size = F.least(F.abs(F.col(value).cast("double")), F.lit(1.7976931348623157e308))
    part = F.greatest(F.lit(0.0), F.least(F.expr("_size / pow(2D, _power) - 1D"), F.lit(1 - 2.0 ** -53))) * cells
    return (df.withColumn("_size", size).withColumn("_power", F.floor(F.log2(F.when(F.col("_size") > 0, F.col("_size")))))
            .withColumn("_part", part).withColumn("_sign", F.when(F.col(value) < 0, -1.0).when(F.col("_size") > 0, 1.0).otherwise(0.0))
            .withColumn(CELL, F.coalesce(F.col("_sign") * ((F.col("_power") + 1075) * cells + F.floor("_part") + 1).cast("double"), F.lit(0.0)))
            .withColumn("_part", F.coalesce(F.col("_part") - F.floor("_part"), F.lit(0.0))).drop("_size", "_power"))


def _next_digit(depth: int) -> Column:
    """The cell with digit number ``depth`` (from 1), each a 65,536th of the one before."""
    fraction = f"(_part * {float(DIGIT ** (depth - 1))}D - floor(_part * {float(DIGIT ** (depth - 1))}D))"
    return F.expr(f"{CELL} + _sign * floor({fraction} * {float(DIGIT)}D) / {float(DIGIT ** depth)}D")


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT), F.min("_part").alias("_low"), F.max("_part").alias("_high"))


def _crowded(crowded: int) -> str:
    """More rows than one task should sort, and more than one value (a value in most rows is one row by then)."""
    return f"{COUNT} > {crowded} AND _low < _high"


class Cells:
    """The cells of one measurement by stratum; crowded ones are found by counting cells of ``source``, one digit a scan.

    The crowded cells are a small frame: its size is checked before it is broadcast.
    """

    def __init__(self, source: DataFrame, by: Sequence[str], value: str, cells: int = CELLS, crowded: int = CROWDED):
        self.by, self.cells, self.full = list(by), cells, []
        rows = _digits(source.select(*by, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)"), "_x", cells)
        while len(self.full) < DIGITS - 1:
            full = _counted(self._placed(rows), [*by, CELL]).where(_crowded(crowded)).select(*by, CELL, F.lit(True).alias("_deeper"))
            if not full.take(1):
                break
            self.full.append(broadcast_if_small(full))

    def _placed(self, rows: DataFrame) -> DataFrame:
        for depth, full in enumerate(self.full, start=1):
            rows = join_groups(rows, full, [*self.by, CELL], "left").withColumn(
                CELL, F.when(F.col("_deeper"), _next_digit(depth)).otherwise(F.col(CELL))).drop("_deeper")
        return rows

    def add(self, df: DataFrame, value: str) -> DataFrame:
        """``df`` with the cell of each value as a double."""
        return self._placed(_digits(df, value, self.cells)).drop("_part", "_sign")


def clean_values(df: DataFrame, value: str) -> DataFrame:
    """Drop missing measurements and make ``value`` a double."""
    if dict(df.dtypes)[value] == "double":
        return df.where(present(F.col(value)))
    return df.withColumn(value, F.col(value).cast("double")).where(present(F.col(value)))


def value_counts(df: DataFrame, by: Sequence[str], value: str,
                 counts: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (stratum, distinct value) with the number of rows, or with the given 0/1 columns summed up."""
    counts = counts or {COUNT: F.lit(1)}
    return (clean_values(df, value).groupBy(*by, value)
            .agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()]))


def prefix_counts(counts: DataFrame, by: Sequence[str], value: str, count: str = COUNT, source: DataFrame | None = None,
                  **kw) -> DataFrame:
    """Add ``_before`` (observations below the value) and ``_total`` (stratum size) to a value-count frame.

    ``source`` has the values before they were counted; cells are found on it, which saves counting twice.

    The offset of each cell travels as one extra row of that cell, placed before its values, so that one window adds the
    offset and the position within the cell and no join back is needed (NULL strata are kept as a stratum).
    """
    cells = Cells(counts if source is None else source, by, value, **kw)
    placed = cells.add(counts.select(*by, value, F.col(count).cast("long").alias(count)), value)
    kind = counts.schema[value].dataType
    per_stratum = Window.partitionBy(*by)
    offsets = (placed.groupBy(*by, CELL).agg(F.sum(count).alias("_c"))
               .select(*by, CELL,
                       F.coalesce(F.sum("_c").over(
                           per_stratum.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(count),
                       F.sum("_c").over(per_stratum).alias(TOTAL))
               .select(*by, F.lit(None).cast(kind).alias(value), count, CELL, TOTAL))
    in_cell = Window.partitionBy(*by, CELL)
    return (placed.select(*by, value, count, CELL, F.lit(None).cast("long").alias(TOTAL)).unionAll(offsets)
            .withColumn(BEFORE, F.sum(count).over(
                in_cell.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn(TOTAL, F.max(TOTAL).over(in_cell))
            .where(F.col(value).isNotNull())
            .drop(CELL))


def mid_rank() -> Column:
    """Average rank of the tied observations of one row of ``prefix_counts``."""
    return F.col(BEFORE) + (F.col(COUNT) + 1) / 2.0


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """(stratum, value, n, rank): the average rank of every distinct value within its stratum."""
    return (prefix_counts(value_counts(df, by, value), by, value, source=df)
            .select(*by, value, F.col(COUNT).alias(n), mid_rank().alias(rank)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], n: str | None = "n",
              method: str = "cells") -> DataFrame:
    """Exact linear-interpolation quantiles (position ``(n-1)p``) by group, missing values skipped.

    ``probs`` maps output column names to probabilities.  The methods differ in cost only:

    * ``cells``: one pass; distinct values are shuffled.  For any number and size of groups and for derived frames.
    * ``two_pass``: for few large groups of a stored table.  A first pass counts cells (nothing else is shuffled) and finds
      the ones that hold a wanted position, a second pass looks at their values only.
    * ``buffer``: the ``percentile`` aggregate, which keeps the distinct values of a group in one task's memory; for groups
      known to be small.
    """
    if method == "buffer":
        size = [F.count(F.lit(1)).alias(n)] if n else []
        data = clean_values(df, value)
        return data.groupBy(*by).agg(*size, *[F.percentile(value, float(p)).alias(name) for name, p in probs.items()])
    if method == "cells":
        ranked = prefix_counts(value_counts(df, by, value), by, value, source=df)
    elif method == "two_pass":
        ranked = _ranked_targets(df, by, value, list(probs.values()))
    else:
        raise ValueError(f"unknown method {method!r}")
    return quantiles_of_counts(ranked, by, value, probs, n=n)


def quantiles_of_counts(ranked: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                        others: Sequence[Column] = (), n: str | None = None) -> DataFrame:
    """Quantiles from the rows of ``prefix_counts``, with further aggregates of the same rows beside them."""
    aggs, outputs = [F.max(TOTAL).alias("_n"), *others], []
    extra = [c for c in ranked.groupBy(*by).agg(*others).columns if c not in by] if others else []
    for i, (name, p) in enumerate(probs.items()):
        for suffix, index in zip(("lo", "hi"), _neighbours(float(p))):
            aggs.append(F.expr(f"max(CASE WHEN {_holds(index)} THEN {sql_name(value)} END) AS _{suffix}{i}"))
        at = f"((_n - 1) * {float(p)!r}D)"
        outputs.append(F.expr(f"_lo{i} + ({at} - floor({at})) * (_hi{i} - _lo{i})").alias(name))
    sizes = [F.col("_n").alias(n)] if n else []
    return ranked.groupBy(*by).agg(*aggs).select(*by, *sizes, *extra, *outputs)


def _neighbours(p: float) -> tuple[str, str]:
    """0-based positions of the two order statistics a quantile lies between."""
    low = f"floor(({TOTAL} - 1) * {p!r}D)"
    return low, f"least({low} + 1, {TOTAL} - 1)"


def _holds(index: str) -> str:
    """The row's observations occupy positions ``_before .. _before + _count - 1``."""
    return f"({BEFORE} <= {index} AND {index} < {BEFORE} + {COUNT})"


def _ranked_targets(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], cells: int = CELLS,
                    crowded: int = CROWDED) -> DataFrame:
    """Ranked distinct values of the cells in which the positions of ``probs`` fall.

    The first scan counts cells of one digit; the wanted ones get another digit, in one more scan that looks at their rows only,
    as long as one of them is crowded; the last scan counts the values of the wanted cells.
    """
    rows = _digits(clean_values(df, value).select(*by, value), value, cells)
    wanted = " OR ".join(_holds(index) for p in probs for index in _neighbours(float(p)))
    per_group = Window.partitionBy(*by)
    before = F.coalesce(F.sum(COUNT).over(per_group.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = _counted(rows, [*by, CELL]).withColumns({BEFORE: before, TOTAL: F.sum(COUNT).over(per_group)})
    for depth in range(1, DIGITS + 1):
        targets = broadcast_if_small(counted.where(wanted).select(
            *by, CELL, F.col(BEFORE).alias("_offset"), F.col(TOTAL), F.expr(_crowded(crowded)).alias("_full")))
        rows = join_groups(rows, targets, [*by, CELL])
        if depth == DIGITS or not targets.where("_full").take(1):
            break
        rows = rows.withColumn(CELL, _next_digit(depth)).drop("_full")
        inner = Window.partitionBy(*by, "_offset").orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        counted = _counted(rows, [*by, "_offset", TOTAL, CELL]).withColumn(BEFORE, F.col("_offset") + F.coalesce(F.sum(COUNT).over(inner), F.lit(0)))
        rows = rows.drop("_offset", TOTAL)
    values = rows.groupBy(*by, CELL, "_offset", TOTAL, value).agg(F.count(F.lit(1)).alias(COUNT))
    in_cell = Window.partitionBy(*by, CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn(BEFORE, F.col("_offset") + F.coalesce(F.sum(COUNT).over(in_cell), F.lit(0)))


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median", **kw) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}, **kw)


def quartiles(df: DataFrame, by: Sequence[str], value: str, iqr: str | None = None, **kw) -> DataFrame:
    out = quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, **kw)
    return out if iqr is None else out.withColumn(iqr, F.col("p75") - F.col("p25"))


def row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """0-based position of every row in the order of a unique, non-missing numeric column, ranked in its own type."""
    counts = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count(F.lit(1)).alias(COUNT))
    positions = prefix_counts(counts, [], order, source=df).select(F.col(order).alias("_at"), F.coalesce(BEFORE, F.lit(0)).alias(name))
    return df.join(positions, df[order] == F.col("_at")).drop("_at")
