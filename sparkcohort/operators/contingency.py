"""Tests on contingency tables kept in long form: one row per (table, row level, column level) with a count."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.tails import chi2_upper
from sparkcohort.operators.describe import group_counts
from sparkcohort.session import join_groups, settle, spread

NODES_PER_CHUNK = 2_048   # divisions of the rows over the first half of the columns
NODE_CELLS = 1 << 20
TABLES_PER_CHUNK = 4_096
SIMULATIONS = 2_000
SIMULATIONS_PER_CHUNK = 250

# Executors need no copy of the package: the simulation travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cell_counts(df: DataFrame, by: Sequence[str], row: str, column: str, n: str = "n") -> DataFrame:
    """Counts of the non-empty cells; rows with a missing level belong to no cell."""
    return group_counts(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()), [*by, row, column], n)


def chi_square_counts(counts: DataFrame, by: Sequence[str], row: str, column: str, n: str = "n",
                      yates: bool = True) -> DataFrame:
    """Pearson chi-square of independence: ``n_total, df, statistic, p, min_expected`` per table.

    Levels with a zero margin do not count.  Empty cells need no row: together they contribute N minus the expected counts
    of the others.  ``yates`` applies the continuity correction to 2x2 tables only.
    """
    cells = counts.where(F.col(n) > 0).select(*by, F.col(row).alias("_row"), F.col(column).alias("_col"),
                                              F.col(n).cast("double").alias("_o"))
    of_row, of_col = Window.partitionBy(*by, "_row"), Window.partitionBy(*by, "_col")
    cells = cells.withColumns({"_r": F.sum("_o").over(of_row), "_rk": F.count(F.lit(1)).over(of_row),
                               "_c": F.sum("_o").over(of_col), "_ck": F.count(F.lit(1)).over(of_col)})
    # every row level appears _rk times, so 1/_rk sums up to the number of row levels
    table = cells.groupBy(*by).agg(
        F.sum("_o").alias("_n"),
        F.round(F.sum(1.0 / F.col("_rk"))).cast("long").alias("rows"),
        F.round(F.sum(1.0 / F.col("_ck"))).cast("long").alias("columns"),
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_s"),
        F.sum(F.col("_r") * F.col("_c")).alias("_e"),
        F.sum(1.0 / F.col("_r") / F.col("_rk")).alias("_ir"), F.sum(1.0 / F.col("_c") / F.col("_ck")).alias("_ic"),
        F.min("_r").alias("_minr"), F.min("_c").alias("_minc"))
    total = F.col("_n")
    plain = F.greatest(F.lit(0.0), total * (F.col("_s") - 1.0))
    out = table.select(
        *by, total.cast("long").alias("n_total"), "rows", "columns",
        ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("df"), plain.alias("_plain"),
        # sum of 1/E over the four cells of a 2x2 table; all |O - E| are equal there
        (total * F.col("_ir") * F.col("_ic")).alias("_inv"),
        (F.col("_minr") * F.col("_minc") / total).alias("min_expected"))
    statistic = F.col("_plain")
    if yates:
        gap = F.sqrt(F.col("_plain") / F.col("_inv"))
        shrunk = gap - F.least(F.lit(0.5), gap)
        statistic = F.when((F.col("rows") == 2) & (F.col("columns") == 2),
                           shrunk * shrunk * F.col("_inv")).otherwise(statistic)
    return (out.withColumn("statistic", F.when(F.col("df") > 0, statistic))
            .withColumn("p", chi2_upper("statistic", "df"))
            .select(*by, "n_total", "rows", "columns", "df", "statistic", "p", "min_expected"))


def chi_square(df: DataFrame, by: Sequence[str], row: str, column: str, yates: bool = True) -> DataFrame:
    return chi_square_counts(cell_counts(df, by, row, column), by, row, column, yates=yates)


def _log_factorial(k: str) -> str:
    """ln k!: exact below 20, Stirling's series above (relative error below 1e-15)."""
    m = f"({k} + 1D)"
    return (f"CASE WHEN {k} < 20 THEN ln(CAST(factorial(CAST({k} AS INT)) AS DOUBLE)) ELSE ({m} - 0.5D) * ln({m}) - {m} "
            f"+ {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {m}) - 1D / (360D * pow({m}, 3)) "
            f"+ 1D / (1260D * pow({m}, 5)) END")


def _tables(counts: DataFrame, by: Sequence[str], row: str, column: str, n: str) -> DataFrame:
    """One row per table with its margins and its cells as (row position, column position, count)."""
    cells = counts.where(F.col(n) > 0).select(*by, F.col(row).alias("_row"), F.col(column).alias("_col"),
                                              F.col(n).cast("long").alias("_o"))
    per_table = Window.partitionBy(*by)
    cells = cells.withColumns({"_i": F.dense_rank().over(per_table.orderBy("_row")),
                               "_j": F.dense_rank().over(per_table.orderBy("_col"))})
    rows = cells.groupBy(*by, "_i").agg(F.sum("_o").alias("_r")).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_r"))).alias("_rows"))
    cols = cells.groupBy(*by, "_j").agg(F.sum("_o").alias("_c")).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_j", "_c"))).alias("_cols"))
    grid = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_j", "_o"))).alias("_cells"))
    return join_groups(join_groups(grid, rows, by), cols, by).select(
        *by, "_cells", F.transform("_rows", lambda r: r["_r"]).alias("_r"),
        F.transform("_cols", lambda c: c["_c"]).alias("_c"))


def fisher_exact_counts(counts: DataFrame, by: Sequence[str], row: str, column: str, n: str = "n", method: str = "exact",
                        simulations: int = SIMULATIONS, seed: int = 1) -> DataFrame:
    """P-value of independence given the margins, per table: ``p`` and ``method``.

    The caller chooses the method; it does not change with a table's size.  ``exact`` sums the probabilities of all tables
    that are not likelier than the observed one.  Tables with two rows (or two columns) are numbered and the numbers spread over
    tasks; for wider ones the ways in which the rows divide over the first half of the columns are spread, and a task fills both
    halves on their own and counts which of them meet in a table that is not likelier.  So the work grows with the number of
    halves that such tables have, not of tables; for large tables with many rows and columns ``simulated`` is the way:
    ``simulations`` random tables with the same margins.
    """
    if method not in ("exact", "simulated"):
        raise ValueError(f"unknown method {method!r}")
    tables = settle(_tables(counts, by, row, column, n))
    # the shorter side becomes the rows
    flip = F.size("_c") < F.size("_r")
    tables = tables.where((F.size("_r") > 1) & (F.size("_c") > 1)).select(
        *by, F.when(flip, F.col("_c")).otherwise(F.col("_r")).alias("_r"),
        F.when(flip, F.col("_r")).otherwise(F.col("_c")).alias("_c"),
        F.when(flip, F.transform("_cells", lambda x: F.struct(x["_j"].alias("_i"), x["_i"].alias("_j"), x["_o"])))
        .otherwise(F.col("_cells")).alias("_cells"))
    if method == "simulated":
        return _simulated(tables, by, simulations, seed)
    # arrangements of the first row over all columns but the last, each 0 .. min(column, first row)
    radix = "transform(slice(_c, 1, size(_c) - 1), c -> least(c, _r[0]) + 1)"
    two = tables.where(F.size("_r") == 2).withColumn("_radix", F.expr(radix)).withColumn(
        "_space", F.expr("aggregate(_radix, 1D, (p, m) -> p * m)"))
    return _enumerated(two, by).unionByName(_completed(tables.where(F.size("_r") > 2), by))


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def likeliest(state: np.ndarray, cols: np.ndarray, factorial: np.ndarray) -> np.ndarray:
    """For each row of ``state``, a bound of -sum(log factorials of the cells) over the tables with these row and column margins.

    With multipliers that make independence the best real-valued table, every cell is at most its own Poisson mode.
    """
    state, cols = state.astype(float), np.asarray(cols, float)
    xlog = lambda x: x * np.log(np.maximum(x, 1e-300))
    total = cols.sum()
    even = state[:, :, None] * cols / max(total, 1.0)
    mode = np.floor(even)
    cells = mode * np.log(np.maximum(even, 1e-300)) - factorial[mode.astype(np.int64)]
    return cells.sum((1, 2)) - xlog(state).sum(1) - xlog(cols).sum() + xlog(total)


def log_total(state: np.ndarray, cols: np.ndarray, factorial: np.ndarray) -> np.ndarray:
    """For each row of ``state``, the logarithm of the sum of exp(-sum of log factorials) over all tables with these margins."""
    return factorial[int(cols.sum())] - factorial[state].sum(1) - factorial[cols].sum()


def fillings(state: np.ndarray, cols: np.ndarray, allow: np.ndarray, factorial: np.ndarray):
    """The tables with the row margins of each row of ``state`` (a node): those whose -sum(log factorials of the cells) is above
    ``allow`` as arrays (node, that sum, number of such tables), and the share of each node's weight that all others have.

    Columns are filled one after the other.  Partial tables that can no longer get above ``allow`` are closed at once, by the
    closed form of all their completions; equal ones are merged.
    """
    total, closed = log_total(state, cols, factorial), np.zeros(len(state))
    node, w, t, last = np.arange(len(state)), np.zeros(len(state)), np.ones(len(state)), state.shape[1] - 1

    def close(low: np.ndarray, mass: np.ndarray) -> np.ndarray:
        np.add.at(closed, node[low], t[low] * np.exp(mass[low] - total[node[low]]))
        return ~low

    for j, column in enumerate(cols[:-1]):
        left = cols[j + 1:]
        rest = np.full(len(node), column)
        behind = state[:, ::-1].cumsum(1)[:, ::-1]          # open margins from each row on
        for i in range(last):                               # spread the column over the rows, one row at a time
            after = behind[:, i + 1]
            least = np.maximum(0, rest - after)
            count = np.minimum(state[:, i], rest) - least + 1
            at = np.repeat(np.arange(len(node)), count)
            x = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + least[at]
            state, behind, node, t = state[at], behind[at], node[at], t[at]
            state[:, i] -= x
            rest, w = rest[at] - x, w[at] - factorial[x]
            if len(left) > 1 or i == last - 1:
                continue
            # one more column: the rows done are settled, each of the others is split in two
            after, rows = behind[:, i + 1], state[:, i + 1:]
            share = rest / np.maximum(after, 1)
            mode = np.minimum(np.floor((rows + 1) * share[:, None]).astype(np.int64), rows)
            odds = np.log(np.maximum(rest, 1e-300)) - np.log(np.maximum(after - rest, 1e-300))
            inner = (rest > 0) & (rest < after)
            mode = np.where(inner[:, None], mode, np.where(rest[:, None] > 0, rows, 0))
            done = w - factorial[state[:, :i + 1]].sum(1)
            best = done - factorial[mode].sum(1) - factorial[rows - mode].sum(1) + np.where(inner, odds * (mode.sum(1) - rest), 0.0)
            mass = done - factorial[rows].sum(1) + factorial[after] - factorial[rest] - factorial[after - rest]
            keep = close(best <= allow[node], mass)
            state, behind, node, t, rest, w = state[keep], behind[keep], node[keep], t[keep], rest[keep], w[keep]
        state[:, last] -= rest
        w = w - factorial[rest]
        if len(left) > 1:
            keep = close(w + likeliest(state, left, factorial) <= allow[node], w + log_total(state, left, factorial))
            state, node, t, w = state[keep], node[keep], t[keep], w[keep]
            if len(w):
                order = np.lexsort((np.round(w, 9), *state.T, node))
                state, node, t, w = state[order], node[order], t[order], w[order]
                head = np.concatenate([[True], (state[1:] != state[:-1]).any(1) | (node[1:] != node[:-1]) | (np.round(w[1:], 9) != np.round(w[:-1], 9))])
                t = np.add.reduceat(t, np.flatnonzero(head))
                state, node, w = state[head], node[head], w[head]
    w = w - factorial[state].sum(1)
    keep = close(w <= allow[node], w)
    return node[keep], w[keep], t[keep], closed


def low_mass(nodes: np.ndarray, rows: np.ndarray, first: np.ndarray, second: np.ndarray, limit: float, factorial: np.ndarray) -> float:
    """Share, among all tables, of those whose row sums over the ``first`` columns are one of ``nodes`` and whose -sum(log
    factorials of the cells) is at most ``limit``; the ``second`` columns are the others.

    The two halves of a table are independent given a node: each table of the first half meets those of the second half that
    are low enough beside it, which are a prefix of the sorted ones.
    """
    other = rows - nodes
    every = factorial[int(rows.sum())] - factorial[rows].sum() - factorial[first].sum() - factorial[second].sum()
    share = np.exp(log_total(nodes, first, factorial) + log_total(other, second, factorial) - every)
    best = likeliest(other, second, factorial)
    sure = likeliest(nodes, first, factorial) + best <= limit
    low = float(share[sure].sum())
    nodes, other, share, best = nodes[~sure], other[~sure], share[~sure], best[~sure]
    totals = log_total(nodes, first, factorial), log_total(other, second, factorial)
    # so many nodes at once that their first columns have about NODE_CELLS fillings
    size = sum(np.prod(np.minimum(m[:, :-1], c[0]) + 1.0, axis=1) for m, c in ((nodes, first), (other, second)))
    turn = np.floor(np.cumsum(size) / NODE_CELLS)
    for k in np.unique(turn):
        at = np.flatnonzero(turn == k)
        n1, w1, t1, closed1 = fillings(nodes[at], first, limit - best[at], factorial)
        top = np.full(len(at), -np.inf)
        np.maximum.at(top, n1, w1)
        open_, = np.nonzero(np.isfinite(top))
        low += float((share[at] * closed1).sum())
        if not len(open_):
            continue
        n2, w2, t2, closed2 = fillings(other[at][open_], second, limit - top[open_], factorial)
        order = np.lexsort((w2, n2))
        n2, w2, t2 = n2[order], w2[order], t2[order]
        p1, p2 = t1 * np.exp(w1 - totals[0][at][n1]), t2 * np.exp(w2 - totals[1][at][open_][n2])
        n1_order = np.argsort(n1, kind="stable")
        begin1, begin2 = (np.searchsorted(n, m) for n, m in ((n1[n1_order], np.append(open_, len(at))), (n2, np.arange(len(open_) + 1))))
        for m, here in enumerate(open_):
            mine = n1_order[begin1[m]:begin1[m + 1]]
            below = np.concatenate([[0.0], np.cumsum(p2[begin2[m]:begin2[m + 1]])])
            met = np.searchsorted(w2[begin2[m]:begin2[m + 1]], limit + 1e-7 - w1[mine], "right")
            low += float(share[at[here]] * (p1[mine] @ (closed2[m] + below[met])))
    return low


def _completed(tables: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact p-values of tables with more than two rows: a node is how the rows divide over the first half of the columns."""
    half = "CAST(floor(size(_c) / 2) AS INT)"
    sorted_ = tables.select(*by, F.sort_array("_r").alias("_r"), F.sort_array("_c").alias("_c"), "_cells")
    radix = f"transform(slice(_r, 1, size(_r) - 1), r -> least(r, aggregate(slice(_c, 1, {half}), 0L, (s, c) -> s + c)) + 1)"
    chunks = sorted_.withColumn("_radix", F.expr(radix)).withColumn("_chunks", F.expr(
        f"CAST(ceil(aggregate(_radix, 1D, (p, m) -> p * m) / {NODES_PER_CHUNK}) AS BIGINT)")).withColumn(
        "_chunk", F.explode(F.expr("sequence(0L, _chunks - 1)")))

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = []
            for r, c, cells, radix, chunk, step in zip(pdf["_r"], pdf["_c"], pdf["_cells"], pdf["_radix"], pdf["_chunk"], pdf["_chunks"]):
                rows, cols = np.asarray(r, np.int64), np.asarray(c, np.int64)
                first, second = cols[:len(cols) // 2], cols[len(cols) // 2:]
                factorial = _log_factorials(int(rows.sum()))
                limit = -sum(factorial[cell["_o"]] for cell in cells)
                # likely nodes lie side by side: a chunk takes every ``step``-th
                number = np.arange(chunk, int(np.prod(np.asarray(radix, float))), step, dtype=np.int64)
                nodes = np.empty((len(number), len(rows)), np.int64)
                for i, m in enumerate(radix):
                    number, nodes[:, i] = np.divmod(number, m)
                nodes[:, -1] = first.sum() - nodes[:, :-1].sum(1)
                low.append(low_mass(nodes[(nodes[:, -1] >= 0) & (nodes[:, -1] <= rows[-1])], rows, first, second, limit, factorial))
            yield pdf[list(by)].assign(_low=low)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in tables.select(*by).schema], "_low double"])
    return (spread(chunks, *by, "_chunk").mapInPandas(complete, schema).groupBy(*by)
            .agg(F.least(F.lit(1.0), F.sum("_low")).alias("p")).withColumn("method", F.lit("exact")))


def _enumerated(tables: DataFrame, by: Sequence[str]) -> DataFrame:
    choose = lambda a, b: (f"({_log_factorial(a)}) - ({_log_factorial(b)}) - ({_log_factorial(f'({a} - {b})')})")
    first_row = ("transform(sequence(1, size(_c)), j -> aggregate(filter(_cells, x -> x._i = 1 AND x._j = j), 0L, "
                 "(s, x) -> s + x._o))")
    weight = f"aggregate(arrays_zip(_c, _x), 0D, (s, z) -> s + {choose('z._c', 'z._x')})"
    chunks = spread(tables.withColumn("_x", F.expr(first_row))
                    .withColumn("_observed", F.expr(weight)).drop("_x", "_cells")
                    .withColumn("_chunk", F.explode(F.expr(
                        f"sequence(0L, CAST(ceil(_space / {TABLES_PER_CHUNK}) AS BIGINT) - 1)"))), *by, "_chunk")
    decode = ("aggregate(_radix, named_struct('rest', _number, 'x', CAST(array() AS ARRAY<BIGINT>)), "
              "(s, m) -> named_struct('rest', s.rest DIV m, 'x', concat(s.x, array(s.rest % m))), s -> s.x)")
    rows = (chunks.withColumn("_number", F.explode(F.expr(
        f"sequence(_chunk * {TABLES_PER_CHUNK}, least((_chunk + 1) * {TABLES_PER_CHUNK}, CAST(_space AS BIGINT)) - 1)")))
        .withColumn("_x", F.expr(decode))
        .withColumn("_x", F.expr("concat(_x, array(_r[0] - aggregate(_x, 0L, (s, v) -> s + v)))"))
        .where(F.expr("_x[size(_x) - 1] BETWEEN 0 AND _c[size(_c) - 1]"))
        .withColumn("_w", F.expr(weight)))
    scaled = F.exp(F.col("_w") - F.col("_observed"))
    return (rows.groupBy(*by).agg(F.sum(F.when(scaled <= 1.0 + 1e-7, scaled)).alias("_low"), F.sum(scaled).alias("_all"))
            .select(*by, F.least(F.lit(1.0), F.col("_low") / F.col("_all")).alias("p"), F.lit("exact").alias("method")))


def _random_tables(rows: np.ndarray, cols: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` random tables with the given margins: every cell is one hypergeometric draw for all tables at once."""
    out = np.empty((size, len(rows), len(cols)), dtype=np.int64)
    left = np.tile(rows, (size, 1))
    for j, total in enumerate(cols[:-1]):
        need, rest = np.full(size, total), left.sum(1)
        for i in range(len(rows)):
            rest = rest - left[:, i]
            out[:, i, j] = rng.hypergeometric(left[:, i], rest, need)
            need = need - out[:, i, j]
        left = left - out[:, :, j]
    out[:, :, -1] = left
    return out


def _simulated(tables: DataFrame, by: Sequence[str], simulations: int, seed: int) -> DataFrame:
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = []
            for r, c, cells, chunk, table in zip(pdf["_r"], pdf["_c"], pdf["_cells"], pdf["_chunk"], pdf["_table"]):
                rows, cols = np.asarray(r, dtype=np.int64), np.asarray(c, dtype=np.int64)
                factorial = _log_factorials(int(rows.sum()))
                limit = -sum(factorial[cell["_o"]] for cell in cells)
                size = min(SIMULATIONS_PER_CHUNK, simulations - chunk * SIMULATIONS_PER_CHUNK)
                # every table has a stream of its own
                rng = np.random.Generator(np.random.Philox(key=[seed, (int(table) ^ chunk) % 2**64]))
                score = -factorial[_random_tables(rows, cols, size, rng)].sum(axis=(1, 2))
                low.append(int((score <= limit + 1e-7 * abs(limit)).sum()))
            yield pdf[list(by)].assign(_low=low)

    chunks = spread(tables.select(*by, "_r", "_c", "_cells", F.xxhash64(F.lit(0), *by).alias("_table"), F.explode(F.expr(
        f"sequence(0, {max(0, math.ceil(simulations / SIMULATIONS_PER_CHUNK) - 1)})")).alias("_chunk")), *by, "_chunk")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in tables.select(*by).schema], "_low long"])
    return (chunks.mapInPandas(draw, schema).groupBy(*by).agg(F.sum("_low").alias("_low"))
            .select(*by, ((F.col("_low") + 1.0) / (simulations + 1.0)).alias("p"), F.lit("simulated").alias("method")))


def independence_test(counts: DataFrame, by: Sequence[str], row: str, column: str, n: str = "n",
                      min_expected: float = 5.0, method: str = "exact", simulations: int = SIMULATIONS,
                      seed: int = 1) -> DataFrame:
    """The usual choice per table: chi-square without correction when all expected counts reach ``min_expected``,
    Fisher's exact test (by ``method``) otherwise.  A table with a single row or column has no test."""
    counts = settle(counts)
    tested = settle(chi_square_counts(counts, by, row, column, n, yates=False))
    chi = tested.select(*by, F.when(F.col("df") > 0, "chi-square").alias("test"), "statistic", "p", "min_expected")
    small = tested.where((F.col("min_expected") < min_expected) & (F.col("df") > 0)).select(*by, "min_expected")
    if not small.take(1):
        return chi
    sparse = join_groups(counts, small, by).drop("min_expected")
    fisher = fisher_exact_counts(sparse, by, row, column, n, method, simulations, seed)
    exact = join_groups(small, fisher, by).select(
        *by, F.concat(F.lit("fisher "), "method").alias("test"), F.lit(None).cast("double").alias("statistic"), "p",
        "min_expected")
    large = (F.col("min_expected") >= min_expected) | F.col("test").isNull()
    return chi.where(large).unionByName(exact)
