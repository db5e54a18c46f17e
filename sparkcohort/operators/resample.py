"""Grouped bootstrap on sufficient statistics.

A statistic that is a function of sums (a mean, a slope) needs only those sums per (group, replicate).  The caller chooses how
to get them; a method never changes with the size of a group:

* *compressed* (the default): equal rows of a group are counted first, and the weight of a distinct row in a replicate is one
  Poisson draw with that count as its mean, which is the sum of the unit draws of its rows.  A task draws for all replicates
  at once and sums up what it holds, so measurements with few distinct values, such as dilutions, cost that many draws.
* *poisson*: every row carries a Poisson(1) weight per replicate from the generator of ``functions.draws``, which any SQL
  engine can repeat.  For fewer than ``LAGGED`` replicates rows are spread evenly and expanded to one per replicate.  For more,
  the same weights are read off one line: the draw of a row in replicate r is the value of a fixed sequence r places behind the
  row's own place, so rows are dealt to cells of neighbouring places, a cell's piece of the sequence is computed once for all of
  its rows, and the sums over many rows are a correlation.  The sequence has as many places as the generator has states, which
  bounds the work however many rows there are.
* *split*: exactly n draws per replicate from a group of any size.  Distinct rows fall into blocks by their hash, the blocks are
  the leaves of a binary tree, and the draws of a replicate go down the tree: what a node got is split binomially between its
  two halves, in proportion to their rows.  A node's splits follow from its number and the seed alone, so every block works
  out its own share without hearing from the others, and blocks draw in parallel.
* *exact*: draw n row positions with replacement per replicate, with a generator that SQL can repeat.  Meant for small groups:
  the numbered rows are a table that is joined with the draws.

A seed fixes the result for any partitioning.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.draws import (PRIME, REPLICATE_STEP, draw_input, key_input, key_second_input, poisson_thresholds,
                                         poisson_weight, round_text)
from sparkcohort.functions.nulls import sql_name
from sparkcohort.operators.describe import drop_missing
from sparkcohort.session import broadcast_if_small, join_groups, settle, spread

REPLICATE = "replicate"
WEIGHT = "weight"
BLOCK_ROWS = 4_096       # of a leaf of the splitting tree, on average
HEAVY_ROW = 32           # a distinct row of so many equal rows gets one binomial draw of its own in its block
PICKS_AT_ONCE = 1 << 20
LAGGED = 1_000           # replicates from which Poisson weights are read off their sequence
CELL_PLACES = 1 << 15    # of a cell's piece of the sequence, at least
DENSE = 15               # weights of a group in a cell, in pieces, beyond which a correlation is cheaper than adding them up
GROUPS_AT_ONCE = 16      # groups whose sums a task holds, on average
WEIGHTS_AT_ONCE = 8_192  # these fit into a core's cache
BOUNDS = tuple(poisson_thresholds())

# Executors need no copy of the package: the draws travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _with_key_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    return (df.withColumn("_a", F.expr(key_input(key, seed)))
            .withColumn("_a", F.expr(round_text("_a")))
            .withColumn("_a", F.expr(key_second_input("_a", key)))
            .withColumn("_hash", F.expr(round_text("_a"))).drop("_a"))


def _with_draw(df: DataFrame, replicates: int) -> DataFrame:
    """Every row once per replicate, with its draw."""
    return (df.withColumn(REPLICATE, F.explode(F.expr(f"sequence(1L, {replicates}L)")))
            .withColumn("_a", F.expr(draw_input("_hash", REPLICATE)))
            .withColumn("_draw", F.expr(round_text("_a"))).drop("_a"))


def _exact_sums(rows: DataFrame, by: Sequence[str], fields: Sequence[str], replicates: int, seed: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(*fields)
    numbered = settle(rows.select(*by, *fields, F.row_number().over(order).cast("long").alias("_at")))
    # sizes come from the frame without a hint: a hint goes through aggregates and generators, and the draws would be broadcast
    slots = spread(group_sizes(numbered, by).withColumn("_slot", F.explode(F.expr("sequence(1L, _n)"))), *by, "_slot")
    picked = _with_draw(_with_key_hash(slots, "_slot", seed), replicates).select(
        *by, REPLICATE, (F.col("_draw") % F.col("_n") + 1).alias("_at"))
    return (join_groups(picked, broadcast_if_small(numbered), [*by, "_at"]).groupBy(*by, REPLICATE)
            .agg(F.count(F.lit(1)).cast("double").alias(WEIGHT), *[F.sum(f).alias(f) for f in fields]))


def _poisson_sums(rows: DataFrame, by: Sequence[str], fields: Sequence[str], key: str, replicates: int,
                  seed: int) -> DataFrame:
    # a row becomes ``replicates`` rows, so the rows are spread evenly first, however the files were laid out;
    # no filter on the weight: it would be pushed below and evaluate the draw once more
    weighted = (_with_draw(_with_key_hash(spread(rows, key), key, seed).drop(key), replicates)
                .withColumn("_w", F.expr(poisson_weight("_draw"))))
    return (weighted.groupBy(*by, REPLICATE)
            .agg(F.sum("_w").cast("double").alias(WEIGHT),
                 *[F.sum(F.col("_w") * F.col(f)).alias(f) for f in fields]))


def sequence_weights(places: np.ndarray) -> np.ndarray:
    """``poisson_weight`` at places of the sequence: place v has the draw of ``v * REPLICATE_STEP`` modulo the prime."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    bounds = [np.uint32(b) for b in BOUNDS]

    def reduced(x: np.ndarray) -> np.ndarray:             # below 2^31 + 4 for any x, as 2^31 is one modulo the prime
        x = (x & prime) + (x >> bits)
        return (x & prime) + (x >> bits)

    flat = places.reshape(-1)
    out = np.empty(len(flat))
    for first in range(0, len(flat), WEIGHTS_AT_ONCE):
        v = reduced(flat[first:first + WEIGHTS_AT_ONCE].astype(np.uint64) * np.uint64(REPLICATE_STEP))
        x = reduced(v * v)
        x = reduced(reduced(x * x) * v)
        draw = np.where(x >= prime, x - prime, x).astype(np.uint32)
        weight = np.zeros(len(draw), np.uint8)
        for bound in bounds:
            weight += draw >= bound
        out[first:first + len(draw)] = weight
    return out.reshape(places.shape)


def cell_size(replicates: int) -> tuple[int, int]:
    """Places in a cell's piece of the sequence, and places of rows in a cell."""
    size = max(CELL_PLACES, 1 << (4 * replicates).bit_length())
    return size, size - replicates + 1


class LaggedSums:
    """Weighted sums of one group over the cells of a task; what was correlated stays transformed until the end."""

    def __init__(self, fields: int, replicates: int):
        self.plain, self.rows, self.spectrum = np.zeros((fields, replicates)), np.zeros(fields), None

    def correlate(self, place: np.ndarray, x: np.ndarray, spectrum: np.ndarray, size: int) -> None:
        """Add rows at places of a cell; ``spectrum`` is that of the cell's weights less one, their mean."""
        spread_out = np.array([np.bincount(place, column, size) for column in x])
        self.rows += x.sum(1)
        self.spectrum = (0 if self.spectrum is None else self.spectrum) + np.fft.rfft(spread_out).conj() * spectrum

    def result(self, size: int) -> np.ndarray:
        if self.spectrum is None:
            return self.plain
        sums = self.plain + self.rows[:, None] + np.fft.irfft(self.spectrum, size)[:, :self.plain.shape[1]]
        sums[0] = np.rint(sums[0])
        return sums


def _sorted_cells(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """The columns of one (chunk, cell) after the other, from batches in their order."""
    rest: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        columns = [np.concatenate(both) for both in zip(rest, columns)] if rest else columns
        chunk, cell = columns[:2]
        bounds = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (cell[1:] != cell[:-1])) + 1)]
        for first, last in itertools.pairwise(bounds):
            yield [c[first:last] for c in columns]
        rest = [c[bounds[-1]:] for c in columns]
    if rest:
        yield rest


def lagged(fields: Sequence[str], replicates: int):
    """Rows (_group, arrays of ``replicates`` weighted sums) from rows (_chunk, _cell, _group, _at, fields) sorted by chunk, cell, group."""
    size, span = cell_size(replicates)
    lags = np.arange(1, replicates + 1)

    def batch_of(held: dict[int, LaggedSums]) -> pa.RecordBatch:
        sums = [h.result(size) for h in held.values()]
        arrays = [pa.array([s[f] for s in sums], pa.list_(pa.float64())) for f in range(len(fields) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *arrays], names=["_group", WEIGHT, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None
        for chunk, cell, group, at, *values in _sorted_cells(batches, ["_chunk", "_cell", "_group", "_at", *fields]):
            if now != chunk[0]:
                if held:
                    yield batch_of(held)
                held, now = {}, chunk[0]
            start = int(cell[0]) * span
            few = len(at) * replicates < size
            piece = None if few else sequence_weights(np.arange(start + 1, start + size + 1))
            slices = None if few else np.lib.stride_tricks.sliding_window_view(piece, replicates)
            spectrum = None
            x = np.array([np.ones(len(at)), *values])
            place = at - start
            for first, last in itertools.pairwise([0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]):
                sums = held.setdefault(int(group[first]), LaggedSums(len(x), replicates))
                if (last - first) * replicates > DENSE * size:
                    spectrum = np.fft.rfft(piece - 1.0) if spectrum is None else spectrum
                    sums.correlate(place[first:last], x[:, first:last], spectrum, size)
                    continue
                for i in range(first, last, 64):
                    some = slice(i, min(i + 64, last))
                    sums.plain += x[:, some] @ (sequence_weights(at[some, None] + lags) if few else slices[place[some]])
        if held:
            yield batch_of(held)

    return run


def _lagged_sums(rows: DataFrame, by: Sequence[str], fields: Sequence[str], key: str, replicates: int, seed: int) -> DataFrame:
    """The sums of ``_poisson_sums``: a row's place is its key hash over the replicate step, modulo the prime."""
    names = [WEIGHT, *fields]
    group = F.xxhash64(F.lit(0), *by).alias("_group")
    groups = settle(rows.select(*by).distinct().select(*by, group))
    chunks = math.ceil(groups.count() / GROUPS_AT_ONCE) or 1
    inverse, span = pow(REPLICATE_STEP, -1, PRIME), cell_size(replicates)[1]
    placed = (_with_key_hash(rows, key, seed).select(group, *fields, F.expr(f"_hash * {inverse}L % {PRIME}L").alias("_at"))
              .withColumns({"_chunk": F.expr(f"pmod(_group, {chunks}L)"), "_cell": F.expr(f"_at DIV {span}L")}))
    schema = ", ".join(["_group long", *[f"`{c}` array<double>" for c in names]])
    sums = spread(placed, "_chunk", "_cell").sortWithinPartitions("_chunk", "_cell", "_group").mapInArrow(lagged(fields, replicates), schema)
    each = sums.select("_group", F.posexplode(F.arrays_zip(*names)).alias("_at", "_s"))
    total = (each.groupBy("_group", (F.col("_at") + 1).cast("long").alias(REPLICATE))
             .agg(*[F.sum(f"_s.{c}").alias(c) for c in names]))
    return join_groups(total, broadcast_if_small(groups), ["_group"]).select(*by, REPLICATE, *names)


def _drawn(fields: Sequence[str], replicates: int):
    """Weighted sums of a batch per group and for all replicates: arrays of ``replicates`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            group, seeds, count = column("_group"), column("_seed"), column("_n")
            x = np.column_stack([np.ones(len(count)), *[column(f) for f in fields]])
            number, first, slot = np.unique(group, return_index=True, return_inverse=True)
            sums = np.zeros((len(number), x.shape[1], replicates))
            for k in range(len(count)):
                weight = np.random.Generator(np.random.Philox(key=int(seeds[k]) % 2**64)).poisson(count[k], replicates)
                sums[slot[k]] += x[k][:, None] * weight
            keys = batch.select([c for c in batch.schema.names if c not in ("_group", "_seed", "_n", *fields)]).take(pa.array(first))
            arrays = [pa.array(list(sums[:, f]), pa.list_(pa.float64())) for f in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([*keys.columns, *arrays], names=[*keys.schema.names, WEIGHT, *fields])

    return run


def _compressed_sums(rows: DataFrame, by: Sequence[str], fields: Sequence[str], replicates: int, seed: int) -> DataFrame:
    counts = rows.groupBy(*by, *fields).agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_group": F.xxhash64(F.lit(0), *by), "_seed": F.xxhash64(F.lit(seed), *by, *fields)})
    keys = [f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in rows.select(*by).schema]
    schema = ", ".join([*keys, *[f"`{c}` array<double>" for c in (WEIGHT, *fields)]])
    # few rows that expand to much work are spread over all tasks
    sums = spread(counts, "_seed").mapInArrow(_drawn(fields, replicates), schema)
    each = sums.select(*by, F.posexplode(F.arrays_zip(WEIGHT, *fields)).alias("_at", "_s"))
    return (each.groupBy(*by, (F.col("_at") + 1).cast("long").alias(REPLICATE))
            .agg(*[F.sum(f"_s.{c}").alias(c) for c in (WEIGHT, *fields)]))


def _paths(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group, block, path): the rows of every node from the root of the group's tree down to the block."""
    leaves = counts.groupBy(*by, "_block", "_depth").agg(F.sum("_n").alias("_rows"))
    steps = leaves.withColumn("_level", F.explode(F.expr("sequence(0, _depth)"))).withColumn("_node", F.expr("shiftright(_block, _depth - _level)"))
    nodes = steps.groupBy(*by, "_level", "_node").agg(F.sum("_rows").alias("_all"), F.collect_list("_block").alias("_blocks"))
    # the blocks below a node are as many as its share of the tree: they travel with it instead of a join back
    return nodes.withColumn("_block", F.explode("_blocks")).groupBy(*by, "_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_level", "_all"))), lambda x: x["_all"]).alias("_path"))


def _stream(first: int, second: int) -> np.random.Generator:
    """A generator of its own for every pair of 64-bit numbers (an array of that type: a list of large ones would be rounded)."""
    return np.random.Generator(np.random.Philox(key=np.array([first % 2**64, second % 2**64], np.uint64)))


def block_draws(path: Sequence[int], block: int, stream: int, replicates: int) -> np.ndarray:
    """Number of draws of each replicate that reach a block, by binomial splits from the root on."""
    draws, depth = np.full(replicates, path[0], np.int64), len(path) - 1
    for level in range(1, depth + 1):
        before, own = path[level - 1], path[level]
        if own == before:
            continue
        parent, right = block >> (depth - level + 1), (block >> (depth - level)) & 1
        rng = _stream(stream, (1 << level) + parent)
        left = rng.binomial(draws, (before - own if right else own) / before)
        draws = draws - left if right else left
    return draws


def block_sums(x: np.ndarray, count: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of the columns of ``x`` over each replicate's draws; row i stands for count[i] equal rows."""
    sums, rest, left = np.zeros((x.shape[1], len(draws))), int(count.sum()), draws.copy()
    heavy = count >= HEAVY_ROW
    for i in np.flatnonzero(heavy):
        got = rng.binomial(left, min(1.0, count[i] / rest))
        sums += x[i][:, None] * got
        left, rest = left - got, rest - int(count[i])
    light = [np.repeat(column, count[~heavy]) for column in x[~heavy].T]
    size = int(count[~heavy].sum())
    ends = np.cumsum(left)
    first = 0
    while first < len(draws) and size:
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + PICKS_AT_ONCE, "right")))
        pick = rng.integers(0, size, int(ends[last - 1] - begin), np.uint32)
        some = first + np.flatnonzero(left[first:last])
        if len(some):
            starts = ends[some] - left[some] - begin
            for row, column in zip(sums, light):
                row[some] += np.add.reduceat(column[pick], starts)
        first = last
    return sums


def _split_sums(rows: DataFrame, by: Sequence[str], fields: Sequence[str], replicates: int, seed: int) -> DataFrame:
    counts = settle(rows.groupBy(*by, *fields).agg(F.count(F.lit(1)).alias("_n")))
    work = counts.groupBy(*by).agg(F.sum(F.least("_n", F.lit(HEAVY_ROW))).alias("_work"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_work") / BLOCK_ROWS))).cast("int")
    leaf = F.expr("CASE WHEN _depth = 0 THEN 0L ELSE shiftrightunsigned(_hash, 64 - _depth) END")
    dealt = (join_groups(counts, broadcast_if_small(work.select(*by, depth.alias("_depth"))), by)
             .withColumn("_hash", F.xxhash64(F.lit(0), *fields)).withColumn("_block", leaf).drop("_hash"))
    placed = (join_groups(dealt, broadcast_if_small(_paths(dealt, by)), [*by, "_block"]).drop("_depth")
              .withColumn("_stream", F.xxhash64(F.lit(seed), *by)))
    names = [WEIGHT, *fields]

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by([(f, "ascending") for f in fields])
        one = lambda c: table.column(c)[0].as_py()
        stream, block = one("_stream"), one("_block")
        draws = block_draws(one("_path"), block, stream, replicates)
        x = np.column_stack([table.column(f).to_numpy() for f in fields])
        sums = block_sums(x, table.column("_n").to_numpy(), draws, _stream(stream, (1 << 63) + block))
        return pa.Table.from_arrays([*table.select(list(by)).slice(0, 1).columns, *[pa.array([list(v)], pa.list_(pa.float64())) for v in (draws.astype(float), *sums)]],
                                    names=[*by, *names])

    keys = [f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in rows.select(*by).schema]
    schema = ", ".join([*keys, *[f"`{c}` array<double>" for c in names]])
    sums = spread(placed, *by, "_block").groupBy(*by, "_block").applyInArrow(draw, schema)
    each = sums.select(*by, F.posexplode(F.arrays_zip(*names)).alias("_at", "_s"))
    return (each.groupBy(*by, (F.col("_at") + 1).cast("long").alias(REPLICATE))
            .agg(*[F.sum(f"_s.{c}").alias(c) for c in names]))


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def replicate_sums(df: DataFrame, by: Sequence[str], fields: Mapping[str, str], replicates: int, seed: int = 1,
                   key: str | None = None, method: str = "compressed") -> DataFrame:
    """(group, replicate, weight, sum of every field): ``fields`` maps output names to SQL expressions of a row.

    Rows with a missing field are left out.  ``key`` is a unique integer column of the rows, needed by ``method="poisson"``.
    """
    rows = df.select(*by, *([F.col(key).cast("long").alias("_key")] if key and method == "poisson" else []),
                     *[F.expr(e).cast("double").alias(f) for f, e in fields.items()])
    rows = rows.where(" AND ".join(f"{f} IS NOT NULL AND NOT isnan({f})" for f in fields))
    names = list(fields)
    if method == "compressed":
        return _compressed_sums(rows, by, names, replicates, seed)
    if method == "split":
        return _split_sums(rows, by, names, replicates, seed)
    if method == "exact":
        return _exact_sums(rows, by, names, replicates, seed)
    if method == "poisson":
        if key is None:
            raise ValueError("the Poisson bootstrap of single rows needs a unique key column")
        return (_lagged_sums if replicates >= LAGGED else _poisson_sums)(rows, by, names, "_key", replicates, seed)
    raise ValueError(f"unknown method {method!r}")


def percentile_bounds(replicates: DataFrame, by: Sequence[str], value: str, level: float = 0.95,
                      names: tuple[str, str] = ("lower", "upper")) -> DataFrame:
    """Percentile interval over the replicates of each group (their number is the group size here)."""
    tail = (1.0 - level) / 2.0
    return replicates.groupBy(*by).agg(F.percentile(value, tail).alias(names[0]),
                                       F.percentile(value, 1.0 - tail).alias(names[1]))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, replicates: int = 10_000, level: float = 0.95,
                   seed: int = 1, key: str | None = None, **kw) -> DataFrame:
    """(group, n, mean, lower, upper): both bounds come from one resampling; replicates without any row are left out."""
    sums = replicate_sums(df, by, {"_x": sql_name(value)}, replicates, seed, key, **kw)
    bounds = percentile_bounds(sums.withColumn("_m", F.try_divide("_x", WEIGHT)), by, "_m", level)
    point = drop_missing(df, value).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return join_groups(point, bounds, by, "left")


def bootstrap_geometric_mean(df: DataFrame, by: Sequence[str], value: str, replicates: int = 10_000,
                             level: float = 0.95, seed: int = 1, key: str | None = None, **kw) -> DataFrame:
    """(group, n, geo_mean, lower, upper) of positive values: the bootstrap of the mean of ln x, mapped back."""
    out = bootstrap_mean(df.withColumn("_ln", F.ln(value)), by, "_ln", replicates, level, seed, key, **kw)
    return out.select(*by, "n", F.exp("mean").alias("geo_mean"), F.exp("lower").alias("lower"),
                      F.exp("upper").alias("upper"))
