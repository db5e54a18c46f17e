"""The numbers behind figures: transformed-axis summaries, densities, bands and labels.  Nothing is drawn here."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions.derive import floor_zero_to_one, pseudo_log, pseudo_log_inverse
from sparkcohort.functions.nulls import sql_name
from sparkcohort.operators.corr import correlation_text, spearman
from sparkcohort.operators.ranks import quantiles
from sparkcohort.operators.regress import deming_band
from sparkcohort.operators.resample import bootstrap_geometric_mean
from sparkcohort.operators.reshape import to_wide
from sparkcohort.session import broadcast_if_small, join_groups, spread

AXES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "pseudo_log": (pseudo_log, pseudo_log_inverse),
    "log10": (lambda x: F.log10(x), lambda a: F.pow(F.lit(10.0), a)),
    "identity": (lambda x: x, lambda a: a),
}


def axis_quartiles(df: DataFrame, by: Sequence[str], value: str, axis: str = "pseudo_log", **kw) -> DataFrame:
    """Median and quartiles taken on the axis scale and mapped back (not the raw ones when n is even)."""
    forward, inverse = AXES[axis]
    points = quantiles(df.select(*by, forward(F.col(value)).alias("_axis")), by, "_axis",
                       {"p25": 0.25, "p50": 0.5, "p75": 0.75}, **kw)
    return points.select(*by, "n", *[inverse(F.col(p)).alias(p) for p in ("p25", "p50", "p75")])


def error_bars(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    """Mean and bootstrap bounds on a log axis, which is the geometric mean with its interval."""
    return bootstrap_geometric_mean(df, by, value, **kw)


def density(df: DataFrame, by: Sequence[str], value: str, axis: str = "identity", points: int = 512,
            scale: str = "area") -> DataFrame:
    """Gaussian kernel density per group on an even grid over the group's range: (group, point, x, n, density).

    Bandwidth 0.9 min(sd, IQR/1.34) n^(-1/5).  Values are spread linearly over the two nearest cells of a fixed grid of
    ``points`` cells reaching four bandwidths past the data, and the kernel is summed over cells.  A group is thus at most
    ``points`` + 1 weights, whatever its size.  ``scale="width"`` divides by the group's maximum.
    """
    forward, inverse = AXES[axis]
    data = df.select(*by, forward(F.col(value).cast("double")).alias("_a")).where("_a IS NOT NULL AND NOT isnan(_a)")
    extent = data.groupBy(*by).agg(F.stddev_samp("_a").alias("_sd"), F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    ranges = quantiles(data, by, "_a", {"_q1": 0.25, "_q3": 0.75}, n="_n", method="two_pass")
    keys = [sql_name(b) for b in by]
    # a zero spread falls back to sd, then to the size of the value, then to one
    lower = "least(_sd, (_q3 - _q1) / 1.34D)"
    width = (f"CASE WHEN {lower} > 0 THEN {lower} WHEN _sd > 0 THEN _sd WHEN _lo != 0 THEN abs(_lo) ELSE 1D END")
    groups = broadcast_if_small(join_groups(extent, ranges, by).where("_n > 1").selectExpr(
        *keys, "_n", "_lo", "_hi", f"0.9D * ({width}) * pow(CAST(_n AS DOUBLE), -0.2D) AS _bw"))
    step = f"((_hi - _lo + 8D * _bw) / {points - 1})"
    placed = (join_groups(data, groups, by)
              .selectExpr(*keys, f"(_a - _lo + 4D * _bw) / {step} AS _pos")
              .selectExpr(*keys, "CAST(floor(_pos) AS INT) AS _cell", "_pos - floor(_pos) AS _frac"))
    # the two shares of a value go to two columns of the same cell, so each row is aggregated once
    cells = (placed.groupBy(*by, "_cell").agg(F.sum(1.0 - F.col("_frac")).alias("_left"), F.sum("_frac").alias("_right"))
             .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_cell", "_left", "_right"))).alias("_cells")))
    kernel = (f"aggregate(_cells, 0D, (s, c) -> s + c._left * exp(-0.5D * pow((_g - c._cell * {step}) / _bw, 2)) "
              f"+ c._right * exp(-0.5D * pow((_g - (c._cell + 1) * {step}) / _bw, 2)))")
    grid = join_groups(groups, cells, by).withColumn("point", F.explode(F.expr(f"sequence(0, {points - 1})")))
    curve = (spread(grid, *by, "point")
             .withColumn("_at", F.expr(f"_lo + (_hi - _lo) * point / {points - 1}D"))
             .withColumn("_g", F.expr("_at - _lo + 4D * _bw"))
             .selectExpr(*keys, "point", "_at", "_n AS n", f"{kernel} / (_n * _bw * {math.sqrt(2 * math.pi)!r}D) AS density")
             .select(*by, "point", inverse(F.col("_at")).alias("x"), "n", "density"))
    if scale == "width":
        peak = curve.groupBy(*by).agg(F.max("density").alias("_peak"))
        curve = join_groups(curve, peak, by).withColumn("density", F.col("density") / F.col("_peak")).drop("_peak")
    elif scale != "area":
        raise ValueError(f"unknown scale {scale!r}")
    return curve


def trajectories(df: DataFrame, by: Sequence[str], id_: str, level: str, value: str,
                 levels: Sequence[str]) -> DataFrame:
    """(group, id, ord, level, value) of participants measured at every listed level: one line per participant."""
    wide = to_wide(df, [*by, id_], level, value, {l: f"_v{i}" for i, l in enumerate(levels)}).na.drop(
        subset=[f"_v{i}" for i in range(len(levels))])
    points = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(l).alias(level), F.col(f"_v{i}").alias(value))
                       for i, l in enumerate(levels)])
    return wide.select(*by, id_, F.explode(points).alias("_p")).select(*by, id_, "_p.*")


def scatter_labels(df: DataFrame, by: Sequence[str], x: str, y: str, **kw) -> DataFrame:
    """One display text per facet of a scatter chart."""
    return correlation_text(spearman(df, by, x, y, **kw))


def scatter_band(df: DataFrame, by: Sequence[str], x: str, y: str, **kw) -> DataFrame:
    """Errors-in-both line with its band per facet on log10 axes: fitted on the logs, mapped back for display.

    Zeros count as one; negative values have no logarithm and are missing.
    """
    logs = df.withColumns({"_lx": F.log10(floor_zero_to_one(F.col(x))), "_ly": F.log10(floor_zero_to_one(F.col(y)))})
    band = deming_band(logs, by, "_lx", "_ly", **kw)
    return band.select(*by, "point", *[F.pow(F.lit(10.0), F.col(c)).alias(c) for c in ("x", "y", "lower", "upper")])
