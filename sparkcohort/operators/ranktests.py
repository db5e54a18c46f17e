"""Group-wise rank tests: rank-sum (two samples), signed-rank (pairs), Holm adjustment, display selection.

Input is a long frame; the stratum is a set of columns, so every panel of a figure is one job.  Output has one row per
(stratum, pair of levels): ``group1, group2, ord1, ord2, n1, n2, statistic, z, p`` and, for pairwise tests, ``p_adj``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.derive import SIGNIFICANCE_CUTS, significance_code
from sparkcohort.functions.exact import EXACT_BELOW, rank_sum_exact_p, signed_rank_exact_p
from sparkcohort.functions.nulls import present, sql_name, sql_text
from sparkcohort.functions.shift import stratum_tests, tied_p
from sparkcohort.functions.tails import chi2_upper, normal_two_sided
from sparkcohort.operators.levels import known_levels, level_pairs
from sparkcohort.operators.reshape import single_value
from sparkcohort.operators.ranks import CELL, Cells, clean_values, value_counts
from sparkcohort.session import broadcast_if_small, join_groups, settle, spread

SMALL_STRATUM = 256      # rows of a stratum whose tied tests are made in one task


def _pick_pairs(levels: Sequence[str], pairs: Sequence[tuple[str, str]] | None) -> list[tuple[int, int]]:
    if pairs is None:
        return level_pairs(levels)
    return [(levels.index(a), levels.index(b)) for a, b in pairs]


def _ties(t: str) -> Column:
    return F.expr(f"CAST({t} AS DOUBLE) * (CAST({t} AS DOUBLE) * CAST({t} AS DOUBLE) - 1D)")


def _normal_test(tests: DataFrame, centred: str, variance: str, correct: bool) -> DataFrame:
    """z with continuity correction and its two-sided p; both NULL when the variance is zero."""
    shift = f"0.5D * signum({centred})" if correct else "0D"
    return (tests.withColumn("z", F.expr(f"CASE WHEN {variance} > 0 THEN ({centred} - {shift}) / sqrt({variance}) END"))
            .withColumn("p", normal_two_sided("z")))


def _with_tied_p(tests: DataFrame, by: Sequence[str], small: Column, ties: DataFrame, size: Column, target: Column) -> DataFrame:
    """``tests`` with exact p-values where ``small`` holds.

    ``ties``: one row per (stratum, ord1, ord2, value) with the number of observations ``t``.  Only rows of small tests are
    gathered, so an array has at most as many entries as a small test has observations.
    """
    key = [*by, "ord1", "ord2"]
    wanted = settle(tests.where(small).select(*key, size.alias("size"), target.cast("long").alias("target"), F.monotonically_increasing_id().alias("tid")))
    of_test = join_groups(ties, broadcast_if_small(wanted.select(*key, "tid")), key)
    sorted_ties = of_test.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("value", "t"))).alias("_v"))
    found = tied_p(wanted.join(sorted_ties, "tid").select("tid", F.col("_v.t").alias("ties"), "size", "target"))
    exact_p = wanted.join(found, "tid").select(*key, F.col("p").alias("_exact"))
    return join_groups(tests, exact_p, key, "left").withColumn("p", F.coalesce("_exact", "p")).drop("_exact")


def _by_size(rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of small strata and those of all others (None when there are none)."""
    large = settle(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SMALL_STRATUM)
                   .select(*key, F.lit(True).alias("_large")))
    if not large.take(1):
        return rows, None
    marked = join_groups(rows, broadcast_if_small(large), key, "left")
    return marked.where("_large IS NULL").drop("_large"), marked.where("_large").drop("_large")


def _stratum_tests(rows: DataFrame, key: Sequence[str], pairs: Sequence[tuple[int, int]] | None, exact_below: int) -> DataFrame:
    """Tied tests of small strata from rows (key, _x, _mark): one shuffle by stratum, and everything else where its rows are."""
    fields = [f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in rows.select(*key).schema]
    schema = ", ".join([*fields, "_test int, n1 long, n2 long, statistic double, _ties double, _exact double"])
    dealt = spread(rows, *key) if key else rows.repartition(1)
    return dealt.sortWithinPartitions(*key, "_x").mapInArrow(stratum_tests(list(key), pairs, exact_below), schema)


def _rank_sum_normal(tests: DataFrame, correct: bool) -> DataFrame:
    mean, total = "(CAST(n1 AS DOUBLE) * n2)", "(CAST(n1 AS DOUBLE) + n2)"
    variance = f"({mean} / 12D * ({total} + 1D - _ties / ({total} * ({total} - 1D))))"
    return _normal_test(tests, f"(statistic - {mean} / 2D)", variance, correct)


def _signed_rank_normal(tests: DataFrame, correct: bool) -> DataFrame:
    n = "CAST(_n AS DOUBLE)"
    variance = f"({n} * ({n} + 1D) * (2D * {n} + 1D) / 24D - _ties / 48D)"
    return _normal_test(tests, f"(statistic - {n} * ({n} + 1D) / 4D)", variance, correct)


def rank_sum(df: DataFrame, by: Sequence[str], level: str, value: str, levels: Sequence[str] | None = None,
             pairs: Sequence[tuple[str, str]] | None = None, correct: bool = True, exact: bool | str | None = None,
             exact_below: int = EXACT_BELOW) -> DataFrame:
    """Two-sided rank-sum test for every pair of levels within every stratum.

    The statistic of group 1 is the number of pairs in which its value is the larger one, ties counting one half.  It is
    summed up from value counts: per cell from the position inside the cell, then across cells from the cell totals, so no
    frame of ranks is ever built or joined.  ``exact=None`` uses the exact distribution below ``exact_below`` observations per
    group (50, the usual convention of this test) without ties; ``exact=False`` never does (and needs no Python worker).
    ``exact="tied"`` is exact below ``exact_below`` with ties and without, on the permutations of the mid-ranks; titres are
    dilutions, so most of their samples are tied.  ``exact_below`` may be any number: see ``functions.shift`` for the memory.
    Its strata of at most ``SMALL_STRATUM`` rows are sorted and tested where one shuffle brings them; the rows are the same.
    """
    levels = known_levels(df, level, levels)
    chosen = _pick_pairs(levels, pairs)
    used = sorted({i for pair in chosen for i in pair})
    members = df.where(F.col(level).isin([levels[i] for i in used]))
    if exact == "tied":
        small, large = _by_size(clean_values(members, value).select(*by, level, value), by)
        marked = small.select(*by, F.col(value).alias("_x"), F.coalesce(*[F.when(F.col(level) == levels[i], F.lit(i)) for i in used]).alias("_mark"))
        names = ", ".join(f"named_struct('group1', {sql_text(levels[i])}, 'group2', {sql_text(levels[j])}, 'ord1', {i + 1}, 'ord2', {j + 1})" for i, j in chosen)
        tests = _rank_sum_normal(_stratum_tests(marked, by, chosen, exact_below), correct).select(
            *by, F.expr(f"get(array({names}), _test)").alias("_g"), "n1", "n2", "statistic", "z", F.coalesce("_exact", "p").alias("p")).select(
            *by, "_g.*", "n1", "n2", "statistic", "z", "p")
        return tests if large is None else tests.unionByName(_rank_sum_by_cells(large, by, level, value, levels, chosen, correct, exact, exact_below))
    return _rank_sum_by_cells(members, by, level, value, levels, chosen, correct, exact, exact_below)


def _rank_sum_by_cells(members: DataFrame, by: Sequence[str], level: str, value: str, levels: Sequence[str], chosen: Sequence[tuple[int, int]],
                       correct: bool, exact: bool | str | None, exact_below: int) -> DataFrame:
    used = sorted({i for pair in chosen for i in pair})
    counts = value_counts(members, by, value, {f"_n{i}": F.col(level) == levels[i] for i in used})

    in_cell = (Window.partitionBy(*by, CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = Cells(members, by, value).add(counts, value).select(
        *by, CELL, *[F.col(f"_n{i}") for i in used],
        *[F.coalesce(F.sum(f"_n{i}").over(in_cell), F.lit(0)).alias(f"_b{i}") for i in used])
    aggs = [F.sum(f"_n{i}").alias(f"_N{i}") for i in used]
    for i, j in chosen:
        aggs.append(F.expr(f"sum(CAST(_n{i} AS DOUBLE) * (_b{j} + _n{j} / 2D)) AS _w{i}_{j}"))
        aggs.append(F.sum(_ties(f"(_n{i} + _n{j})")).alias(f"_t{i}_{j}"))
    cells = ranked.groupBy(*by, CELL).agg(*aggs)

    below = Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offset = cells.withColumns({f"_o{j}": F.coalesce(F.sum(f"_N{j}").over(below), F.lit(0)) for j in used})
    totals = [F.sum(f"_N{i}").alias(f"n{i}") for i in used]
    for i, j in chosen:
        totals.append(F.expr(f"sum(_w{i}_{j} + CAST(_N{i} AS DOUBLE) * _o{j}) AS w{i}_{j}"))
        totals.append(F.sum(f"_t{i}_{j}").alias(f"t{i}_{j}"))
    per_stratum = offset.groupBy(*by).agg(*totals)

    rows = ", ".join(
        f"named_struct('group1', {sql_text(levels[i])}, 'group2', {sql_text(levels[j])}, 'ord1', {i + 1}, 'ord2', {j + 1}, "
        f"'n1', n{i}, 'n2', n{j}, 'statistic', w{i}_{j}, '_ties', t{i}_{j})" for i, j in chosen)
    tests = (per_stratum.select(*by, F.expr(f"inline(array({rows}))")).where("n1 > 0 AND n2 > 0"))

    out = _rank_sum_normal(tests, correct)
    if exact == "tied":
        each = ", ".join(f"named_struct('ord1', {i + 1}, 'ord2', {j + 1}, 't', _n{i} + _n{j})" for i, j in chosen)
        ties = counts.select(*by, F.col(value).alias("value"), F.expr(f"inline(array({each}))")).where("t > 0")
        out = _with_tied_p(out, by, (F.col("n1") < exact_below) & (F.col("n2") < exact_below), ties, F.col("n1"),
                           F.round(2 * F.col("statistic")) + F.col("n1") * (F.col("n1") + 1))
    elif exact is not False:
        small = (F.col("n1") < exact_below) & (F.col("n2") < exact_below) if exact is None else F.lit(True)
        out = out.withColumn("_x", small & (F.col("_ties") == 0)).withColumn(
            "p", F.coalesce(rank_sum_exact_p("statistic", "n1", "n2", "_x"), F.col("p"))).drop("_x")
    return out.drop("_ties")


def k_sample(df: DataFrame, by: Sequence[str], level: str, value: str) -> DataFrame:
    """Rank test of all levels at once, by stratum: (stratum, n, groups, statistic, df, p), chi-square on ``groups`` - 1.

    The rank sum of every level comes from the cells of ``rank_sum`` in the same two shuffles: positions inside a cell, then
    cell totals; the levels need not be known.  Rows without a level or a value are left out.  A stratum of one level, or
    with a single distinct value, has no statistic.
    """
    rows = clean_values(df.where(F.col(level).isNotNull()), value).select(*by, F.col(level).alias("_level"), F.col(value).alias("_x"))
    counts = rows.groupBy(*by, "_level", "_x").agg(F.count(F.lit(1)).alias("_n"))
    inside, same = Window.partitionBy(*by, CELL).orderBy("_x"), Window.partitionBy(*by, CELL, "_x")
    upto = Window.unboundedPreceding, Window.currentRow
    # _t: observations of the value, over all levels; _r: their mid-rank within the cell
    placed = (Cells(rows, by, "_x").add(counts, "_x").withColumn("_upto", F.sum("_n").over(inside.rangeBetween(*upto)))
              .withColumn("_t", F.sum("_n").over(same)).withColumn("_r", F.col("_upto") - (F.col("_t") - 1) / 2.0))
    cells = placed.groupBy(*by, CELL, "_level").agg(F.sum("_n").alias("_N"), F.sum(F.col("_n") * F.col("_r")).alias("_s"),
                                                    F.expr("sum(_n * (CAST(_t AS DOUBLE) * _t - 1D)) AS _ties"))
    below = Window.partitionBy(*by).orderBy(CELL)
    offset = F.sum("_N").over(below.rangeBetween(*upto)) - F.sum("_N").over(Window.partitionBy(*by, CELL))
    levels = (cells.withColumn("_o", offset.cast("double")).groupBy(*by, "_level").agg(
        F.sum("_N").cast("double").alias("_n"), F.sum(F.col("_s") + F.col("_o") * F.col("_N")).alias("_sum"), F.sum("_ties").alias("_ties")))
    total = levels.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("groups"), F.expr("sum(_sum * _sum / _n) AS _q"),
                                    F.sum("_ties").alias("_ties"))
    spread = "(1D - _ties / (_all * (_all * _all - 1D)))"
    statistic = F.expr(f"CASE WHEN groups > 1 AND {spread} > 1e-14 THEN (12D / (_all * (_all + 1D)) * _q - 3D * (_all + 1D)) / {spread} END")
    return (total.withColumn("statistic", statistic).withColumn("df", F.col("groups") - 1)
            .withColumn("p", F.when(F.col("statistic").isNotNull(), chi2_upper("statistic", "df")))
            .select(*by, F.col("_all").cast("long").alias("n"), "groups", "statistic", "df", "p"))


def paired_wide(df: DataFrame, by: Sequence[str], id_: str, level: str, value: str,
                levels: Sequence[str]) -> DataFrame:
    """One row per (stratum, participant) with the value at each level in columns ``_v0, _v1, ...``."""
    return (clean_values(df.where(F.col(level).isin(list(levels))), value).groupBy(*by, id_)
            .agg(*[single_value(F.when(F.col(level) == l, F.col(value))).alias(f"_v{i}") for i, l in enumerate(levels)]))


def signed_rank(df: DataFrame, by: Sequence[str], id_: str, level: str, value: str,
                levels: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None,
                correct: bool = True, exact: bool | str | None = None, exact_below: int = EXACT_BELOW) -> DataFrame:
    """Two-sided signed-rank test of level i against level j on participants measured at both, by stratum.

    ``(stratum, id_, level)`` has to be unique.  Zero differences are dropped from the statistic and the exact
    distribution (fewer than 50 non-zero pairs, no ties, no zeros) follows the rules of ``rank_sum``.  With ``exact="tied"``
    ties and zeros are allowed: all signs of the non-zero differences' mid-ranks; a test without a non-zero one has p = 1.
    """
    levels = known_levels(df, level, levels)
    wide = paired_wide(df, by, id_, level, value, levels)
    return signed_rank_wide(wide, by, {l: f"_v{i}" for i, l in enumerate(levels)}, pairs, correct, exact, exact_below)


def signed_rank_wide(wide: DataFrame, by: Sequence[str], columns: Mapping[str, str],
                     pairs: Sequence[tuple[str, str]] | None = None, correct: bool = True, exact: bool | str | None = None,
                     exact_below: int = EXACT_BELOW) -> DataFrame:
    """``signed_rank`` on one row per participant; ``columns`` maps level -> column name in level order."""
    levels = list(columns)
    chosen = _pick_pairs(levels, pairs)
    col = [F.col(c).cast("double") for c in columns.values()]
    diffs = wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("_pair"), (col[i] - col[j]).alias("_d")) for k, (i, j) in enumerate(chosen)
    ])).alias("_e")).select(*by, "_e._pair", "_e._d").where(present(F.col("_d")))

    key = [*by, "_pair"]
    names = ", ".join(f"named_struct('group1', {sql_text(levels[i])}, 'group2', {sql_text(levels[j])}, "
                      f"'ord1', {i + 1}, 'ord2', {j + 1})" for i, j in chosen)
    if exact == "tied":
        small, large = _by_size(diffs, key)
        marked = small.select(*key, F.abs("_d").alias("_x"), F.when(F.col("_d") > 0, 1).otherwise(0).alias("_mark"))
        # n2 of these is the number of non-zero differences
        tests = _stratum_tests(marked, key, None, exact_below).select(
            *by, F.expr(f"get(array({names}), _pair)").alias("_g"), "n1", F.col("n2").alias("_n"), "statistic", "_ties", "_exact")
        p = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.coalesce("_exact", "p"))
        tests = _signed_rank_normal(tests, correct).select(*by, "_g.*", "n1", F.col("n1").alias("n2"), "statistic", "z", p.alias("p"))
        return tests if large is None else tests.unionByName(_signed_rank_by_cells(large, by, names, correct, exact, exact_below))
    return _signed_rank_by_cells(diffs, by, names, correct, exact, exact_below)


def _signed_rank_by_cells(diffs: DataFrame, by: Sequence[str], names: str, correct: bool, exact: bool | str | None, exact_below: int) -> DataFrame:
    key = [*by, "_pair"]
    counts = (diffs.withColumn("_abs", F.abs("_d")).groupBy(*key, "_abs")
              .agg(F.count_if(F.col("_d") > 0).alias("_pos"), F.count(F.lit(1)).alias("_all")))
    zero = F.col("_abs") == 0
    marked = Cells(diffs.withColumn("_abs", F.abs("_d")), key, "_abs").add(counts, "_abs").select(
        *key, "_abs", CELL, "_pos", "_all", F.when(zero, F.lit(0)).otherwise(F.col("_all")).alias("_t"))
    in_cell = Window.partitionBy(*key, CELL).orderBy("_abs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = marked.withColumn("_b", F.coalesce(F.sum("_t").over(in_cell), F.lit(0)))
    cells = ranked.groupBy(*key, CELL).agg(
        F.sum("_all").alias("_N"), F.sum("_t").alias("_T"), F.sum("_pos").alias("_P"),
        F.expr("sum(CAST(_pos AS DOUBLE) * (_b + (_t + 1) / 2D)) AS _v"),
        F.sum(_ties("_t")).alias("_ties"))
    below = Window.partitionBy(*key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    tests = (cells.withColumn("_o", F.coalesce(F.sum("_T").over(below), F.lit(0)))
             .groupBy(*key).agg(
                 F.sum("_N").alias("n1"), F.sum("_T").alias("_n"),
                 F.expr("sum(_v + CAST(_P AS DOUBLE) * _o) AS statistic"),
                 F.sum("_ties").alias("_ties")))

    tests = tests.withColumn("_g", F.expr(f"get(array({names}), _pair)")).select(
        *by, "_g.*", "n1", F.col("n1").alias("n2"), "_n", "statistic", "_ties")
    out = _signed_rank_normal(tests, correct)
    if exact == "tied":
        ties = counts.where(~zero).select(*by, F.expr(f"get(array({names}), _pair)").alias("_g"), F.col("_abs").alias("value"), F.col("_all").alias("t"))
        ties = ties.select(*by, "_g.ord1", "_g.ord2", "value", "t")
        out = out.withColumn("p", F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col("p")))
        out = _with_tied_p(out, by, (F.col("_n") > 0) & (F.col("_n") < exact_below), ties, F.lit(None).cast("long"), F.round(2 * F.col("statistic")))
    elif exact is not False:
        small = F.col("_n") < exact_below if exact is None else F.lit(True)
        usable = small & (F.col("_ties") == 0) & (F.col("_n") == F.col("n1")) & (F.col("_n") > 0)
        out = out.withColumn("_x", usable).withColumn(
            "p", F.coalesce(signed_rank_exact_p("statistic", "_n", "_x"), F.col("p"))).drop("_x")
    return out.drop("_n", "_ties")


def holm(tests: DataFrame, by: Sequence[str], p: str = "p", adjusted: str = "p_adj",
         ties: Sequence[str] = ("ord1", "ord2")) -> DataFrame:
    """Holm-adjusted p within each stratum of a result frame (a stratum has one row per pair of levels).

    Tests without a p-value are not counted and get no adjusted p.
    """
    stratum = Window.partitionBy(*by, F.col(p).isNull())
    ordered = stratum.orderBy(p, *ties)
    step = F.when(F.col(p).isNotNull(), F.least(
        F.lit(1.0), (F.count(p).over(stratum) - F.row_number().over(ordered) + 1) * F.col(p)))
    return (tests.withColumn("_step", step)
            .withColumn(adjusted, F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_step"))


def add_significance(tests: DataFrame, p: str = "p_adj", name: str | None = None, cuts=SIGNIFICANCE_CUTS) -> DataFrame:
    return tests.withColumn(name or f"{p}_signif", significance_code(F.col(p), cuts))


def pairwise_rank_sum(df: DataFrame, by: Sequence[str], level: str, value: str, levels: Sequence[str] | None = None,
                      **kw) -> DataFrame:
    """All-pairs rank-sum test with Holm adjustment and significance codes of both p-values."""
    tests = holm(rank_sum(df, by, level, value, levels, **kw), by)
    return add_significance(add_significance(tests, "p"), "p_adj")


def pairwise_signed_rank(df: DataFrame, by: Sequence[str], id_: str, level: str, value: str,
                         levels: Sequence[str] | None = None, **kw) -> DataFrame:
    """All-pairs signed-rank test with Holm adjustment and significance codes of both p-values."""
    tests = holm(signed_rank(df, by, id_, level, value, levels, **kw), by)
    return add_significance(add_significance(tests, "p"), "p_adj")


def display_pairs(tests: DataFrame, pairs: Sequence[tuple[int, int]], name: str = "position") -> DataFrame:
    """Keep the given (ord1, ord2) comparisons of an already adjusted frame and number them in the given order."""
    position = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(pairs, start=1))):
        position = F.when((F.col("ord1") == a) & (F.col("ord2") == b), F.lit(k)).otherwise(position)
    return tests.withColumn(name, position).where(F.col(name).isNotNull())


# Consecutive time points from the second on, then first against third: what a five-point figure shows.
CONSECUTIVE_AND_FIRST_THIRD = ((2, 3), (3, 4), (4, 5), (1, 3))


def number_rows(tests: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Running number of a result frame (one row per test, so its size is strata times pairs)."""
    return tests.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def with_placeholder(tests: DataFrame, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Prepend fixed rows (e.g. ``ns`` for a stratum whose values are all zero) to a result frame by column name."""
    kept = {name for row in rows for name in row}
    schema = [f for f in tests.schema.fields if f.name in kept]
    data = [tuple(row.get(f.name) for f in schema) for row in rows]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    fixed = tests.sparkSession.createDataFrame(data, ddl)
    return fixed.unionByName(tests, allowMissingColumns=True).select(*tests.columns)
