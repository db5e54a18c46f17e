"""The catalog queries as plain SQL for another engine, written the direct way (ranks over raw rows, Simpson integrals for the
tails), so that an agreement says something about the distributed versions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from sparkcohort.functions.draws import draw_input, key_input, key_second_input, poisson_weight, round_text

SEGMENTS = ("BUILDING", "AUTOMOBILE", "FURNITURE")
MOMENTS = ("baseline", "after_dose1", "after_dose2", "after_120", "after_180")
EVENT_OF = {"baseline": "signup", "after_dose1": "view", "after_dose2": "click", "after_120": "purchase",
            "after_180": "error"}


# --- building blocks ------------------------------------------------------------------------------------------------------

def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def simpson(integrand: str, upper: str, steps: int = 2000) -> str:
    """Integral of ``integrand`` (a text in x) from 0 to ``upper``."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    body = integrand.replace("x", f"(({upper}) * i / {steps}.0)")
    return f"(({upper}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({body}))))"


def normal_p(z: str) -> str:
    """Two-sided normal p-value."""
    phi = f"{1 / math.sqrt(2 * math.pi)!r} * exp(-0.5 * x * x)".replace("exp", "EXP")
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 12 THEN 0.0 "
            f"ELSE least(1.0, greatest(0.0, 1.0 - 2.0 * {simpson(phi, f'abs({z})')})) END")


def student_p(t: str, df: str) -> str:
    """Two-sided Student p-value: integral over the angle atan(t / sqrt(df))."""
    scale = f"EXP(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) * {2 / math.sqrt(math.pi)!r}"
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"greatest(0.0, 1.0 - {scale} * {simpson(f'pow(cos(x), {df} - 1)', angle)})"


def chi2_p(value: str, df: str) -> str:
    """Upper chi-square tail: integral over the square root of the statistic."""
    density = f"pow(x, {df} - 1) * EXP(-0.5 * x * x)"
    scale = f"pow(2.0, 1 - {df} / 2.0) / EXP(lgamma({df} / 2.0))"
    return f"greatest(0.0, 1.0 - {scale} * {simpson(density, f'sqrt({value})')})"


def k_sample(source: str, by: str, level: str, value: str) -> list[str]:
    """CTEs ending in ``ks``: the k-sample rank test from average ranks over all rows of a stratum."""
    return [f"kr AS (SELECT {by} AS s, {level} AS l, rank() OVER w + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 AS r, "
            f"count(*) OVER (PARTITION BY {by}, {value}) AS t FROM {source} WHERE {level} IS NOT NULL AND {value} IS NOT NULL "
            f"WINDOW w AS (PARTITION BY {by} ORDER BY {value}))",
            "kl AS (SELECT s, l, count(*) AS n, sum(r) AS sr, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM kr GROUP BY 1, 2)",
            "kt AS (SELECT s, CAST(sum(n) AS DOUBLE) AS n, count(*) AS groups, sum(sr * sr / n) AS q, sum(ties) AS ties FROM kl GROUP BY 1)",
            "kh AS (SELECT *, groups - 1 AS df, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * (n * n - 1))) AS statistic FROM kt)",
            f"ks AS (SELECT *, {chi2_p('statistic', 'df')} AS p FROM kh)"]


def levels_case(column: str, levels: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{l}' THEN {i}" for i, l in enumerate(levels, 1)) + " END"


def stars(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0.0001 THEN '****' WHEN {p} <= 0.001 THEN '***' "
            f"WHEN {p} <= 0.01 THEN '**' WHEN {p} <= 0.05 THEN '*' ELSE 'ns' END")


def plain(expr: str, digits: int) -> str:
    """A number as text without trailing zeros."""
    fixed = f"format('{{:.{digits}f}}', round_even(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"regexp_replace(regexp_replace({fixed}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def pct(share: str, digits: int = 1) -> str:
    return f"format('{{:.{digits}f}}', round_even(100.0 * ({share}), {digits})) || '%'"


def _event_value(moment: str, how: str) -> str:
    e = EVENT_OF[moment]
    return (f"{how}(CASE WHEN event_type = '{e}' THEN value END, CASE WHEN event_type = '{e}' THEN event_id END)"
            f" FILTER (event_type = '{e}')")


def _report(v: str) -> str:
    return (f"CASE WHEN {v} < 5 THEN 'pending' WHEN {v} < 15 THEN 'NR' "
            f"WHEN {v} >= 15 THEN '1/' || CAST(CAST(floor({v} / 10) * 10 AS BIGINT) AS VARCHAR) END")


def _titre(text: str) -> str:
    return (f"CASE WHEN {text} = 'NR' THEN 0.0 WHEN contains({text}, '/') "
            f"THEN TRY_CAST(substr({text}, strpos({text}, '/') + 1) AS DOUBLE) END")


COHORT = f"""
last AS (SELECT user_id AS id, {', '.join(f'{_event_value(m, "arg_max")} AS v_{m}' for m in MOMENTS)} FROM events GROUP BY 1),
people AS (SELECT c_custkey AS id, c_mktsegment AS vaccine,
    CASE WHEN c_acctbal < 500 THEN 'SI' WHEN c_acctbal < 9000 THEN 'NO' END AS prior_covid,
    CASE WHEN c_nationkey < 12 THEN 'Femenino' ELSE 'Masculino' END AS sex, 50.0 + floor(abs(c_acctbal) / 200) AS age
    FROM customer),
cohort AS (SELECT last.id, {', '.join(f'{_titre("(" + _report(f"v_{m}") + ")")} AS {m}' for m in MOMENTS)},
    CASE WHEN vaccine IN {SEGMENTS} THEN vaccine END AS vaccine, prior_covid, sex, age,
    CASE WHEN age < 80 THEN '< 80 years' WHEN age >= 80 THEN '>= 80 years' END AS age_group
    FROM last LEFT JOIN people USING (id)),
marked AS (SELECT *, CASE WHEN baseline = 0 THEN 'NO' WHEN baseline <> 0 THEN 'SI' END AS exposed FROM cohort),
long AS ({' UNION ALL '.join(
    f"SELECT id, vaccine, exposed, prior_covid, sex, age, age_group, '{m}' AS moment, {i} AS ord, {m} AS titre FROM marked"
    for i, m in enumerate(MOMENTS, 1))}),
complete AS (SELECT * FROM long WHERE id NOT IN (SELECT id FROM long WHERE titre IS NULL)),
available AS (SELECT * FROM long WHERE age >= 60),
firsts AS (SELECT user_id AS id, {', '.join(f'{_event_value(m, "arg_min")} / 4.0 AS v_{m}' for m in MOMENTS[1:])}
    FROM events GROUP BY 1),
assay AS ({' UNION ALL '.join(f"SELECT id, '{m}' AS moment, v_{m} AS titre2 FROM firsts" for m in MOMENTS[1:])}),
both_assays AS (SELECT available.*, titre2 FROM available LEFT JOIN assay USING (id, moment)),
scored AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
"""


def with_cohort(sql: str, *ctes: str) -> str:
    return "WITH " + ", ".join([COHORT, *ctes]) + " " + sql


def with_(sql: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + sql


# --- rank tests -------------------------------------------------------------------------------------------------------------

def pair_table(levels: Sequence[str]) -> str:
    rows = ", ".join(f"('{a}', '{b}', {i + 1}, {j + 1})" for i, a in enumerate(levels) for j, b in enumerate(levels) if i < j)
    return f"pair(group1, group2, ord1, ord2) AS (VALUES {rows})"


def rank_sum(source: str, by: Sequence[str], level: str, value: str, levels: Sequence[str]) -> list[str]:
    """CTEs ending in ``tests``: average ranks over raw rows, one set of ranks per pair of levels."""
    key = ", ".join([*by, "group1", "group2", "ord1", "ord2"])
    return [pair_table(levels),
            f"ranked AS (SELECT {key}, {level} AS lv, rank() OVER (PARTITION BY {key} ORDER BY {value}) + "
            f"(count(*) OVER (PARTITION BY {key}, {value}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {key}, {value}) AS t "
            f"FROM (SELECT * FROM {source} WHERE {value} IS NOT NULL) s JOIN pair ON s.{level} IN (group1, group2))",
            f"sums AS (SELECT {key}, count(*) FILTER (lv = group1) AS n1, count(*) FILTER (lv = group2) AS n2, "
            f"sum(rk) FILTER (lv = group1) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ranked GROUP BY {key})",
            f"stats AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS statistic, "
            "CAST(n1 AS DOUBLE) * n2 / 12.0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))) AS v "
            "FROM sums WHERE n1 > 0 AND n2 > 0)",
            "scored_z AS (SELECT *, CASE WHEN v > 0 THEN (statistic - CAST(n1 AS DOUBLE) * n2 / 2.0 - "
            "0.5 * sign(statistic - CAST(n1 AS DOUBLE) * n2 / 2.0)) / sqrt(v) END AS z FROM stats)",
            f"tests AS (SELECT *, {normal_p('z')} AS p FROM scored_z)"]


def signed_rank(source: str, by: Sequence[str], value: str, levels: Sequence[str]) -> list[str]:
    """CTEs ending in ``tests``; participants are matched by ``id`` within ``by``."""
    key = ", ".join([*by, "group1", "group2", "ord1", "ord2"])
    left = "".join(f"a.{b}, " for b in by)
    same = " AND ".join(["a.id = b.id", *[f"a.{b} IS NOT DISTINCT FROM b.{b}" for b in by]])
    return [pair_table(levels),
            f"diffs AS (SELECT {left}group1, group2, ord1, ord2, a.{value} - b.{value} AS d FROM pair "
            f"JOIN {source} a ON a.moment = group1 JOIN {source} b ON b.moment = group2 AND {same} "
            f"WHERE a.{value} IS NOT NULL AND b.{value} IS NOT NULL)",
            f"nonzero AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY abs(d)) + "
            f"(count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {key}, abs(d)) AS t "
            "FROM diffs WHERE d <> 0)",
            f"sizes AS (SELECT {key}, count(*) AS n1 FROM diffs GROUP BY {key})",
            f"sums AS (SELECT {key}, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS statistic, "
            f"sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM nonzero GROUP BY {key})",
            f"stats AS (SELECT {', '.join(f'sizes.{k}' for k in [*by, 'group1', 'group2', 'ord1', 'ord2'])}, n1, n1 AS n2, "
            "coalesce(n, 0) AS n, coalesce(statistic, 0) AS statistic, "
            "coalesce(n * (n + 1.0) * (2 * n + 1.0) / 24.0 - ties / 48.0, 0) AS v FROM sizes LEFT JOIN sums ON "
            + " AND ".join(f"sizes.{k} IS NOT DISTINCT FROM sums.{k}" for k in [*by, "group1", "group2"]) + ")",
            "scored_z AS (SELECT *, CASE WHEN v > 0 THEN (statistic - n * (n + 1) / 4.0 - "
            "0.5 * sign(statistic - n * (n + 1) / 4.0)) / sqrt(v) END AS z FROM stats)",
            f"tests AS (SELECT *, {normal_p('z')} AS p FROM scored_z)"]


def holm(by: Sequence[str]) -> list[str]:
    part = "PARTITION BY " + ", ".join([*by, "(p IS NULL)"])
    return [f"steps AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, (count(p) OVER ({part}) - row_number() OVER ({part} ORDER BY p, ord1, ord2) + 1) "
            "* p) END AS step FROM tests)",
            f"adjusted AS (SELECT *, max(step) OVER ({part} ORDER BY p, ord1, ord2 ROWS UNBOUNDED PRECEDING) AS p_adj FROM steps)"]


TEST_COLUMNS = (f"group1, group2, ord1, ord2, {big('n1')} AS n1, {big('n2')} AS n2, {r('statistic')} AS statistic, "
                f"{r('z')} AS z, {r('p')} AS p")
PAIRWISE = f"{TEST_COLUMNS}, {r('p_adj')} AS p_adj, {stars('p')} AS p_signif, {stars('p_adj')} AS p_adj_signif"


def spearman(source: str, by: Sequence[str], x: str, y: str) -> list[str]:
    """CTEs ending in ``rho``: Pearson correlation of ranks over raw rows."""
    part = "PARTITION BY " + ", ".join(by)
    keys = ", ".join(by)
    rank = lambda c: (f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part}, {c}) - 1) / 2.0")
    return [f"ranked AS (SELECT {keys}, {rank(x)} AS rx, {rank(y)} AS ry FROM {source} "
            f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)",
            f"base AS (SELECT {keys}, count(*) AS n, corr(rx, ry) AS rho0 FROM ranked GROUP BY {keys})",
            "cleaned AS (SELECT * EXCLUDE (rho0), CASE WHEN isnan(rho0) THEN NULL WHEN abs(rho0) > 1 - 1e-12 THEN sign(rho0) ELSE rho0 END AS rho FROM base)",
            "rho AS (SELECT *, CASE WHEN n > 3 THEN tanh(atanh(rho) - 1.959963984540054 * sqrt(1.06 / (n - 3))) END AS ci_low, "
            "CASE WHEN n > 3 THEN tanh(atanh(rho) + 1.959963984540054 * sqrt(1.06 / (n - 3))) END AS ci_high, "
            "CASE WHEN n > 2 AND abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t FROM cleaned)",
            f"full_rho AS (SELECT *, CASE WHEN abs(rho) = 1 AND n > 2 THEN 0.0 WHEN t IS NOT NULL THEN {student_p('t', '(n - 2)')} END AS p FROM rho)"]


def spearman_exact_sql(columns: str) -> str:
    """P-values of small untied groups from all permutations of up to nine numbers, written out one place at a time."""
    ctes = spearman("lineitem", ["l_orderkey"], "l_quantity", "l_extendedprice")
    untied = ("untied AS (SELECT l_orderkey, count(*) AS k, CAST(sum((rx - ry) * (rx - ry)) AS BIGINT) AS d FROM ranked GROUP BY 1 "
              "HAVING count(DISTINCT rx) = count(*) AND count(DISTINCT ry) = count(*) AND count(*) BETWEEN 2 AND 9)")
    orders = ("perms(k, place, used, s) AS (SELECT k, 0, 0, 0 FROM (SELECT DISTINCT k FROM untied) UNION ALL "
              "SELECT k, place + 1, used | (1 << i), s + (i - place) * (i - place) FROM perms, range(0, 9) AS numbers(i) "
              "WHERE i < k AND place < k AND (used >> i) & 1 = 0)")
    tails = ("exact AS (SELECT l_orderkey, least(1.0, 2.0 * least(sum((s >= d)::INT), sum((s <= d)::INT)) / count(*)) AS q "
             "FROM (SELECT l_orderkey, d, s FROM untied JOIN perms ON perms.k = untied.k AND place = untied.k) GROUP BY 1)")
    return ("WITH RECURSIVE " + ", ".join([*ctes, untied, orders, tails]) + f" SELECT l_orderkey, n, {columns} FROM (SELECT full_rho.* REPLACE "
            "(coalesce(q, p) AS p) FROM full_rho LEFT JOIN exact USING (l_orderkey))")


RHO_TEXT = (f"'rho = ' || coalesce({plain('rho', 2)}, 'NA') || ', CI[' || coalesce({plain('ci_low', 2)}, 'NA') || ', ' || "
            f"coalesce({plain('ci_high', 2)}, 'NA') || '], ' || coalesce(CASE WHEN p < 0.05 THEN 'p < 0.05' "
            f"ELSE 'p = ' || {plain('p', 4)} END, 'NA')")


def quartile(value: str, p: float) -> str:
    return f"quantile_cont(CAST({value} AS DOUBLE), {p})"


# --- contingency --------------------------------------------------------------------------------------------------------------

def chi_square(source: str, by: Sequence[str], row: str, column: str, yates: bool = True) -> list[str]:
    """CTEs ending in ``chi`` over the full grid of row and column levels of each table."""
    key = "".join(f"{b}, " for b in by)
    on = "".join(f" AND o.{b} IS NOT DISTINCT FROM g.{b}" for b in by)
    grid_on = " AND ".join([f"rr.{b} IS NOT DISTINCT FROM cc.{b}" for b in by]) or "TRUE"
    keep = "".join(f"rr.{b} AS {b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    correction = "least(0.5, abs(o - e))" if yates else "0.0"
    return [f"o AS (SELECT {key}{row} AS rl, {column} AS cl, count(*) AS o FROM {source} WHERE {row} IS NOT NULL "
            f"AND {column} IS NOT NULL GROUP BY {key}{row}, {column})",
            f"rr AS (SELECT {key}rl, sum(o) AS rs FROM o GROUP BY {key}rl)",
            f"cc AS (SELECT {key}cl, sum(o) AS cs FROM o GROUP BY {key}cl)",
            f"g AS (SELECT {keep}rl, cl, rs, cs FROM rr JOIN cc ON {grid_on})",
            f"cells AS (SELECT g.*, coalesce(o.o, 0) AS o, sum(coalesce(o.o, 0)) OVER (PARTITION BY "
            f"{', '.join(f'g.{b}' for b in by) or '1'}) AS n FROM g LEFT JOIN o ON o.rl = g.rl AND o.cl = g.cl{on})",
            "expected AS (SELECT *, CAST(rs AS DOUBLE) * cs / n AS e FROM cells)",
            f"shape AS (SELECT {key}max(n) AS n_total, count(DISTINCT rl) AS \"rows\", count(DISTINCT cl) AS \"columns\", "
            f"min(e) AS min_expected, sum((o - e) * (o - e) / e) AS plain, "
            f"sum(pow(abs(o - e) - {correction}, 2) / e) AS corrected FROM expected {group})",
            f"chi0 AS (SELECT *, (\"rows\" - 1) * (\"columns\" - 1) AS df, "
            f"CASE WHEN \"rows\" = 2 AND \"columns\" = 2 THEN corrected ELSE plain END AS statistic FROM shape)",
            f"chi AS (SELECT *, CASE WHEN df > 0 THEN {chi2_p('statistic', 'df')} END AS p FROM chi0)"]


# --- resampling ---------------------------------------------------------------------------------------------------------------

def draws(source: str, columns: str, key: str, replicates: int, where: str = "TRUE", seed: int = 1) -> list[str]:
    """CTE ``drawn``: rows of ``source`` times replicates with their draw ``x`` (the same counter-based generator)."""
    return [f"d0 AS (SELECT {columns}, CAST({key} AS BIGINT) AS k, {key_input(f'CAST({key} AS BIGINT)', seed)} AS x0 "
            f"FROM {source} WHERE {where})",
            f"d1 AS (SELECT *, {round_text('x0')} AS x1 FROM d0)",
            f"d2 AS (SELECT *, {key_second_input('x1', 'k', '//')} AS x2 FROM d1)",
            f"d3 AS (SELECT *, {round_text('x2')} AS h FROM d2)",
            f"d4 AS (SELECT *, {draw_input('h', 'rep')} AS x4 FROM d3, (SELECT unnest(range(1, {replicates + 1})) AS rep))",
            f"drawn AS (SELECT *, {round_text('x4')} AS x FROM d4)"]


def poisson_geomean(source: str, by: str, value: str, key: str, replicates: int, digits: int, where: str = "TRUE") -> str:
    ctes = draws(source, f"{by}, ln({value}) AS y", key, replicates, where)
    return with_(
        f"SELECT {by}, n, {r('exp(m)', digits)} AS geo_mean, {r('exp(lo)', digits)} AS lower, {r('exp(hi)', digits)} AS upper "
        f"FROM (SELECT {by}, count(*) AS n, avg(ln({value})) AS m FROM {source} WHERE {where} GROUP BY {by}) "
        f"JOIN (SELECT {by}, {quartile('b', 0.025)} AS lo, {quartile('b', 0.975)} AS hi FROM reps GROUP BY {by}) USING ({by})",
        *ctes, f"weighted AS (SELECT {by}, rep, y, {poisson_weight('x')} AS w FROM drawn)",
        f"reps AS (SELECT {by}, rep, sum(w * y) / sum(w) AS b FROM weighted GROUP BY {by}, rep HAVING sum(w) > 0)")


def deming_fit(delta: str, prefix: str = "") -> str:
    gap = f"(syy - {delta} * sxx)"
    return f"CASE WHEN sxy <> 0 THEN ({gap} + sqrt({gap} * {gap} + 4 * {delta} * sxy * sxy)) / (2 * sxy) END"


def deming_point(source: str, by: str, x: str, y: str, delta: str = "(syy / sxx)") -> list[str]:
    return [f"mom AS (SELECT {by}, count(*) AS n, var_samp({x}) AS sxx, var_samp({y}) AS syy, covar_samp({x}, {y}) AS sxy, "
            f"avg({x}) AS mx, avg({y}) AS my, min({x}) AS x_min, max({x}) AS x_max FROM {source} GROUP BY {by})",
            f"fit AS (SELECT {by}, n, slope, my - slope * mx AS intercept, x_min, x_max FROM "
            f"(SELECT *, {deming_fit(delta)} AS slope FROM mom))"]


def deming_reps(source: str, by: str, x: str, y: str, key: str, replicates: int) -> list[str]:
    return [*draws(source, f"{by}, {x} AS lx, {y} AS ly", key, replicates),
            f"weighted AS (SELECT {by}, rep, lx, ly, {poisson_weight('x')} AS w FROM drawn)",
            f"wsum AS (SELECT {by}, rep, sum(w) AS sw, sum(w * lx) / sum(w) AS mx, sum(w * ly) / sum(w) AS my "
            f"FROM weighted GROUP BY {by}, rep HAVING sum(w) > 1)",
            f"wmom AS (SELECT {by}, rep, max(sw) AS sw, max(mx) AS mx, max(my) AS my, sum(w * (lx - mx) * (lx - mx)) / (max(sw) - 1) AS sxx, "
            f"sum(w * (ly - my) * (ly - my)) / (max(sw) - 1) AS syy, sum(w * (lx - mx) * (ly - my)) / (max(sw) - 1) AS sxy, "
            f"count(DISTINCT lx) FILTER (w > 0) AS dx, count(DISTINCT ly) FILTER (w > 0) AS dy "
            f"FROM weighted JOIN wsum USING ({by}, rep) GROUP BY {by}, rep)",
            f"reps AS (SELECT {by}, rep, slope, my - slope * mx AS intercept FROM (SELECT *, {deming_fit('(syy / sxx)')} AS slope "
            "FROM wmom WHERE dx > 1 AND dy > 1) WHERE slope IS NOT NULL)"]


def deming_band_ctes(by: str, points: int) -> list[str]:
    return [f"grid AS (SELECT {by}, point, x_min + (x_max - x_min) * point / {points - 1}.0 AS x, slope, intercept FROM fit, "
            f"(SELECT unnest(range(0, {points})) AS point))",
            f"band AS (SELECT grid.{by}, point, max(grid.x) AS x, max(grid.intercept + grid.slope * grid.x) AS y, "
            f"{quartile('reps.intercept + reps.slope * grid.x', 0.025)} AS lower, "
            f"{quartile('reps.intercept + reps.slope * grid.x', 0.975)} AS upper "
            f"FROM grid LEFT JOIN reps ON reps.{by} = grid.{by} GROUP BY grid.{by}, point)"]


def normal_equations(source: str, by: str, xs: Sequence[str], y: str) -> list[str]:
    """``solved``: per group the inverse of X'X for two or three centred predictors by cofactors, and what follows from it."""
    names, p = [*xs, y], len(xs)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names))
    products = ", ".join(f"sum(({names[i]} - m{i}) * ({names[j]} - m{j})) AS s{i}{j}" for i in range(p + 1) for j in range(i, p + 1))
    kept = ", ".join(f"max(m{i}) AS m{i}" for i in range(p + 1))
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    if p == 2:
        det = "(s00 * s11 - s01 * s01)"
        inverse = {(0, 0): "s11", (0, 1): "-s01", (1, 1): "s00"}
    else:
        minor = lambda i, j: "({} * {} - {} * {})".format(*(s(a, b) for a, b in (
            ((i + 1) % 3, (j + 1) % 3), ((i + 2) % 3, (j + 2) % 3), ((i + 1) % 3, (j + 2) % 3), ((i + 2) % 3, (j + 1) % 3))))
        inverse = {(i, j): minor(i, j) for i in range(3) for j in range(i, 3)}
        det = f"(s00 * {inverse[0, 0]} + s01 * {inverse[0, 1]} + s02 * {inverse[0, 2]})"
    cells = ", ".join(f"{e} / {det} AS i{i}{j}" for (i, j), e in inverse.items())
    inv = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    slopes = ", ".join(f"{' + '.join(f'{inv(i, j)} * s{j}{p}' for j in range(p))} AS b{i}" for i in range(p))
    quadratic = " + ".join(f"m{i} * m{j} * {inv(i, j)}" for i in range(p) for j in range(p))
    return [f"means AS (SELECT {by}, count(*) AS n, {means} FROM {source} GROUP BY 1)",
            f"gram AS (SELECT {by}, max(n) AS n, {kept}, {products} FROM {source} JOIN means USING ({by}) GROUP BY 1)",
            f"inverted AS (SELECT *, {cells} FROM gram)", f"slopes AS (SELECT *, {slopes} FROM inverted)",
            f"errors AS (SELECT *, s{p}{p} - ({' + '.join(f'b{i} * s{i}{p}' for i in range(p))}) AS sse FROM slopes)",
            f"solved AS (SELECT *, sqrt(sse / (n - {p + 1})) AS sigma, 1 - sse / s{p}{p} AS r2, m{p} - ({' + '.join(f'b{i} * m{i}' for i in range(p))}) AS a, "
            f"sqrt(1.0 / n + {quadratic}) AS ca FROM errors)"]


def ols_ctes(source: str, by: str | None, x: str, y: str) -> list[str]:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    p = lambda t: student_p(t, "(n - 2)")
    # centred sums: the means first, then sums of squares around them
    join = f"JOIN means USING ({by})" if by else ", means"
    return [f"means AS (SELECT {key}count(*) AS n, avg({x}) AS x_mean, avg({y}) AS y_mean FROM {source} {group})",
            f"ss AS (SELECT {key}max(n) AS n, max(x_mean) AS x_mean, max(y_mean) AS y_mean, sum(pow({x} - x_mean, 2)) AS sxx, "
            f"sum(pow({y} - y_mean, 2)) AS syy, sum(({x} - x_mean) * ({y} - y_mean)) AS sxy FROM {source} {join} {group})",
            "line AS (SELECT *, sxy / sxx AS slope, y_mean - sxy / sxx * x_mean AS intercept, syy - sxy * sxy / sxx AS sse, "
            "sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM ss)",
            "se AS (SELECT *, sigma / sqrt(sxx) AS slope_se, sigma * sqrt(1.0 / n + x_mean * x_mean / sxx) AS intercept_se, "
            "1 - sse / syy AS r2 FROM line)",
            "tv AS (SELECT *, slope / slope_se AS slope_t, intercept / intercept_se AS intercept_t, "
            "1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2 FROM se)",
            f"fit AS (SELECT *, {p('slope_t')} AS slope_p, {p('intercept_t')} AS intercept_p, slope_t * slope_t AS f FROM tv)"]


OLS_COLUMNS = "n, " + ", ".join(f"{r(c, 4)} AS {c}" for c in (
    "intercept", "intercept_se", "intercept_t", "intercept_p", "slope", "slope_se", "slope_t", "slope_p", "sigma", "r2",
    "adj_r2", "f", "x_mean", "y_mean", "sxx", "sse"))

ORDER_ROWS = "od AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE) AS px, ln(o_totalprice) AS py FROM orders)"
LOG_LINES = ("ll AS (SELECT l_returnflag, l_shipdate, l_quantity, log10(l_quantity) AS lx, log10(l_extendedprice) AS ly, "
             "ln(l_extendedprice) AS log_price FROM lineitem)")
LOG_ASSAYS = ("la AS (SELECT id, moment, log10(CASE WHEN titre = 0 THEN 1.0 ELSE titre END) AS lx, "
              "log10(CASE WHEN titre2 = 0 THEN 1.0 ELSE titre2 END) AS ly FROM both_assays WHERE titre IS NOT NULL AND titre2 IS NOT NULL)")
KNOWN = "known AS (SELECT * FROM complete WHERE vaccine IS NOT NULL)"
FLOORED = ("floored AS (SELECT moment, vaccine, id, CASE WHEN titre = 0 THEN 1.0 ELSE titre END AS y FROM available "
           "WHERE titre IS NOT NULL AND vaccine IS NOT NULL AND exposed = 'NO' AND prior_covid = 'NO')")


def density_sql(source: str, by: str, axis: str, back: str, points: int, scale: str, digits: int) -> str:
    """Linear binning on the wide grid and a sum of kernels over its cells."""
    step = f"((hi - lo + 8 * bw) / {points - 1})"
    peak = f"/ max(density) OVER (PARTITION BY {by})" if scale == "width" else ""
    return with_(
        f"SELECT {by}, point, {r(back, digits)} AS x, n, {r(f'density {peak}', digits)} AS density FROM curve",
        f"data AS (SELECT {by}, {axis} AS a FROM {source})",
        f"st AS (SELECT {by}, count(*) AS n, stddev_samp(a) AS sd, min(a) AS lo, max(a) AS hi, {quartile('a', .75)} - "
        f"{quartile('a', .25)} AS iqr FROM data GROUP BY {by})",
        f"par AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM st)",
        f"pos AS (SELECT {by}, (a - lo + 4 * bw) / {step} AS pos FROM data JOIN par USING ({by}))",
        f"bins AS (SELECT {by}, cell, sum(w) AS w FROM (SELECT {by}, floor(pos) AS cell, 1 - (pos - floor(pos)) AS w FROM pos "
        f"UNION ALL SELECT {by}, floor(pos) + 1, pos - floor(pos) FROM pos) GROUP BY {by}, cell)",
        f"curve AS (SELECT par.{by}, point, max(lo + (hi - lo) * point / {points - 1}.0) AS pos_at, max(n) AS n, "
        f"sum(w * exp(-0.5 * pow(((hi - lo) * point / {points - 1}.0 + 4 * bw - cell * {step}) / bw, 2))) "
        f"/ (max(n) * max(bw) * {math.sqrt(2 * math.pi)!r}) AS density FROM par JOIN bins USING ({by}), "
        f"(SELECT unnest(range(0, {points})) AS point) GROUP BY par.{by}, point)")


def profile_sql(source: str, columns: Sequence[str], by: str | None = None, digits: int = 4) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    one = lambda c: (
        f"SELECT {key}'{c}' AS variable, count(*) - count({c}) AS n_missing, {r(f'count({c}) / count(*)', digits)} AS complete_rate, "
        f"{r(f'avg({c})', digits)} AS mean, {r(f'stddev_samp({c})', digits)} AS sd, {r(f'min({c})', digits)} AS p0, "
        + ", ".join(f"{r(quartile(c, p), digits)} AS {n}" for n, p in (("p25", .25), ("p50", .5), ("p75", .75)))
        + f", {r(f'max({c})', digits)} AS p100 FROM {source} {group}")
    return " UNION ALL ".join(one(c) for c in columns)


def pareto_sql(columns: Sequence[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(*) AS total FROM scored"
                              for c in columns)
    return with_cohort(
        f"SELECT variable, n_missing, {r('n_missing / total')} AS ratio, CAST(row_number() OVER w AS INTEGER) AS position, "
        f"{r('sum(n_missing) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n_missing) OVER ()')} AS cumulative FROM m "
        "WINDOW w AS (ORDER BY n_missing DESC, variable)", f"m AS ({rows})")


def table_one_sql(overall: bool = False) -> str:
    rows = "t AS (SELECT * FROM scored WHERE lang IS NOT NULL"
    rows += " UNION ALL SELECT * REPLACE ('overall' AS lang) FROM scored WHERE lang IS NOT NULL)" if overall else ")"
    cat = lambda c: f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, lang, count(*) AS n FROM t GROUP BY 2, 3"
    share = "n / sum(n) FILTER (level IS NOT NULL) OVER (PARTITION BY variable, lang)"
    d1 = lambda e: f"format('{{:.1f}}', round_even({e}, 1))"
    none = "CAST(NULL AS DOUBLE)"
    return with_cohort(
        f"SELECT variable, level, lang, CASE WHEN level IS NULL THEN 'unknown' ELSE 'categorical' END AS kind, n, "
        f"CASE WHEN level IS NOT NULL THEN {r(share)} END AS percent, {none} AS p25, {none} AS median, {none} AS p75, "
        f"{big("coalesce(sum(n) FILTER (level IS NOT NULL AND lang <> 'overall') OVER (PARTITION BY variable), 0)")} AS n_present, "
        f"CASE WHEN level IS NULL THEN CAST(n AS VARCHAR) ELSE n || ' (' || {pct(share)} || ')' END AS text FROM c "
        f"UNION ALL SELECT 'n_chars', NULL, lang, 'continuous', count(*), NULL, {r(quartile('n_chars', .25))}, "
        f"{r(quartile('n_chars', .5))}, {r(quartile('n_chars', .75))}, {big("sum(count(*)) FILTER (lang <> 'overall') OVER ()")}, "
        f"{d1(quartile('n_chars', .5))} || ' (' || {d1(quartile('n_chars', .25))} || ', ' || {d1(quartile('n_chars', .75))} || ')' "
        f"FROM t GROUP BY lang", rows,
        f"c AS ({' UNION ALL '.join(cat(c) for c in ('quality', 'toxic', 'source'))})")


def characteristics_sql() -> str:
    rows = ("ch AS (SELECT vaccine, CASE WHEN sex = 'Femenino' THEN 'Female' ELSE 'Male' END AS gender, age_group, "
            "CASE WHEN prior_covid = 'SI' OR exposed = 'SI' THEN 'Yes' WHEN prior_covid IS NOT NULL AND exposed IS NOT NULL "
            "THEN 'No' END AS exposure FROM marked WHERE age >= 60 AND vaccine IS NOT NULL)")
    one = lambda name, c: f"SELECT '{name}' AS variable, {c} AS level, vaccine, count(*) AS n FROM ch WHERE {c} IS NOT NULL GROUP BY 2, 3"
    return with_cohort(
        f"SELECT variable, level, vaccine, n, {r('n / sum(n) OVER (PARTITION BY variable, vaccine)')} AS percent, "
        f"{big('sum(n) OVER (PARTITION BY variable)')} AS n_present FROM c", rows,
        f"c AS ({one('Gender', 'gender')} UNION ALL {one('Age', 'age_group')} UNION ALL {one('Previous exposure', 'exposure')})")


def characteristics_missing_sql() -> str:
    rows = characteristics_sql().split("ch AS (", 1)[1].split("WHERE age >= 60", 1)[0]
    one = lambda name, c: (
        f"SELECT '{name}' AS variable, {c} AS level, vaccine, CASE WHEN {c} IS NULL THEN 'unknown' ELSE 'categorical' END AS kind, "
        f"count(*) AS n FROM ch GROUP BY ALL")
    return with_cohort(
        f"SELECT variable, level, vaccine, kind, n, {big("coalesce(sum(n) FILTER (level IS NOT NULL) OVER (PARTITION BY variable), 0)")} AS n_present FROM c",
        f"ch AS ({rows}WHERE age >= 60 AND vaccine IS NOT NULL)",
        f"c AS ({one('Gender', 'gender')} UNION ALL {one('Age', 'age_group')} UNION ALL {one('Previous exposure', 'exposure')})")


def fisher_three_rows_sql() -> str:
    """All 3 x 4 tables with the margins of a source's, cell by cell."""
    rows, cols = ("good", "poor", "toxic"), ("de", "en", "es", "fr")
    kind = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
    cells = ", ".join(f"count(*) FILTER (k = '{a}' AND lang = '{b}') AS o{i}{j}" for i, a in enumerate(rows) for j, b in enumerate(cols))
    margins = ", ".join([*[" + ".join(f"o{i}{j}" for j in range(4)) + f" AS r{i}" for i in range(3)],
                         *[" + ".join(f"o{i}{j}" for i in range(3)) + f" AS c{j}" for j in range(4)]])
    ctes = [f"k AS (SELECT source, lang, {kind} AS k FROM scored)", f"t AS (SELECT source, {cells} FROM k WHERE k IS NOT NULL GROUP BY 1)",
            f"s0 AS (SELECT *, {margins} FROM t)"]
    step = 0
    for i in range(2):
        for j in range(3):
            used = " - ".join([f"r{i}", *[f"x{i}{b}" for b in range(j)]])
            room = " - ".join([f"c{j}", *[f"x{a}{j}" for a in range(i)]])
            ctes.append(f"s{step + 1} AS (SELECT *, unnest(range(0, least({used}, {room}) + 1)) AS x{i}{j} FROM s{step})")
            step += 1
        last = " - ".join([f"r{i}", *[f"x{i}{b}" for b in range(3)]])
        ctes.append(f"s{step + 1} AS (SELECT * FROM (SELECT *, {last} AS x{i}3 FROM s{step}) WHERE x{i}3 BETWEEN 0 AND "
                    + " - ".join(["c3", *[f"x{a}3" for a in range(i)]]) + ")")
        step += 1
    ctes.append(f"f AS (SELECT *, " + ", ".join(f"c{j} - x0{j} - x1{j} AS x2{j}" for j in range(4)) + f" FROM s{step})")
    score = lambda name: " + ".join(f"lgamma({name}{i}{j} + 1.0)" for i in range(3) for j in range(4))
    ctes.append(f"w AS (SELECT source, exp(-({score('x')}) + ({score('o')})) AS w, (r0 > 0)::INT + (r1 > 0)::INT + (r2 > 0)::INT AS nr, "
                "(c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT AS nc FROM f)")
    return with_cohort(f"SELECT source, {r('least(1.0, sum(w) FILTER (w <= 1 + 1e-7) / sum(w))')} AS p, 'exact' AS method FROM w "
                       "WHERE nr > 1 AND nc > 1 GROUP BY source", *ctes)


def newton_quantile(p: str) -> str:
    """Inverse normal by Newton steps on a Simpson distribution function, from a logistic start."""
    cdf = f"(0.5 + {simpson('0.3989422804014327 * EXP(-0.5 * x * x)', 'a', 400)})"
    step = f"a - ({cdf} - {p}) / (0.3989422804014327 * EXP(-0.5 * a * a))"
    return f"list_reduce([ln({p} / (1 - {p})) / 1.702] || [0.0 for j in range(0, 8)], lambda a, b: {step})"


def global_test_sql() -> str:
    rows = ("rs AS (SELECT o_orderstatus, n, (py - intercept - slope * px) / sqrt(sse / n) AS rr, slope * (px - x_mean) AS gg, "
            "px - x_mean AS hh, CAST(o_orderkey AS DOUBLE) AS vv FROM od JOIN fit USING (o_orderstatus))")
    stats = ("st AS (SELECT o_orderstatus, pow(sum(pow(rr, 3)), 2) / (6 * max(n)) AS s1, "
             "pow(sum(pow(rr, 4) - 3), 2) / (24 * max(n)) AS s2, "
             "(pow(sum(gg * gg * rr), 2) / max(n)) / (avg(pow(gg, 4)) - pow(avg(gg * gg), 2) - pow(avg(gg * gg * hh), 2) / avg(hh * hh)) AS s3, "
             "pow(sum((vv - vm) * (rr * rr - 1)), 2) / (2 * max(n) * var_pop(vv)) AS s4 FROM rs JOIN "
             "(SELECT o_orderstatus, avg(vv) AS vm FROM rs GROUP BY 1) USING (o_orderstatus) GROUP BY o_orderstatus)")
    parts = " UNION ALL ".join(
        f"SELECT o_orderstatus, '{name}' AS \"check\", {expr} AS s, CAST({df} AS BIGINT) AS df FROM st" for name, expr, df in (
            ("global", "s1 + s2 + s3 + s4", 4), ("skewness", "s1", 1), ("kurtosis", "s2", 1), ("link function", "s3", 1),
            ("heteroscedasticity", "s4", 1)))
    return with_(f"SELECT o_orderstatus, \"check\", {r('s', 4)} AS statistic, df, {r(chi2_p('s', 'df'), 4)} AS p FROM u",
                 ORDER_ROWS, *ols_ctes("od", "o_orderstatus", "px", "py"), rows, stats, f"u AS ({parts})")


def fisher_two_by_two_sql() -> str:
    lg = lambda k: f"lgamma({k} + 1.0)"
    choose = lambda a, b: f"({lg(a)} - {lg(b)} - {lg(f'({a} - {b})')})"
    return with_cohort(
        f"SELECT lang, {r('least(1.0, sum(w) FILTER (w <= w0 * (1 + 1e-7)) / sum(w))')} AS p, 'exact' AS method FROM ws GROUP BY lang",
        "tab AS (SELECT lang, count(*) FILTER (toxic = 0) AS r1, count(*) FILTER (quality = 0) AS c1, count(*) AS n, "
        "count(*) FILTER (toxic = 0 AND quality = 0) AS a FROM scored WHERE toxic IS NOT NULL AND quality IS NOT NULL GROUP BY lang)",
        "sp AS (SELECT *, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS k FROM tab "
        "WHERE r1 > 0 AND r1 < n AND c1 > 0 AND c1 < n)",
        f"ws AS (SELECT lang, exp({choose('c1', 'k')} + {choose('(n - c1)', '(r1 - k)')} - {choose('n', 'r1')}) AS w, "
        f"exp({choose('c1', 'a')} + {choose('(n - c1)', '(r1 - a)')} - {choose('n', 'r1')}) AS w0 FROM sp)")


def pseudo(x: str) -> str:
    return (f"(ln(abs({x}) / 20.0 + sqrt(pow({x} / 20.0, 2) + 1)) / {math.log(2)!r} "
            f"* CASE WHEN {x} < 0 THEN -1 ELSE 1 END)")


def pseudo_back(a: str) -> str:
    return f"20.0 * sinh({a} * {math.log(2)!r})"


def exact_geomean_sql(replicates: int, digits: int) -> str:
    """Bootstrap of small groups: numbered rows, drawn positions, one percentile interval."""
    return with_cohort(
        f"SELECT moment, vaccine, n, {r('exp(m)', digits)} AS geo_mean, {r('exp(lo)', digits)} AS lower, {r('exp(hi)', digits)} AS upper "
        f"FROM (SELECT moment, vaccine, count(*) AS n, avg(ln(y)) AS m FROM floored GROUP BY ALL) JOIN "
        f"(SELECT moment, vaccine, {quartile('b', .025)} AS lo, {quartile('b', .975)} AS hi FROM reps GROUP BY ALL) USING (moment, vaccine)",
        FLOORED,
        "num AS (SELECT moment, vaccine, ln(y) AS y, row_number() OVER (PARTITION BY moment, vaccine ORDER BY y) AS pos FROM floored)",
        "slots AS (SELECT moment, vaccine, n, unnest(range(1, n + 1)) AS slot FROM "
        "(SELECT moment, vaccine, count(*) AS n FROM floored GROUP BY ALL))",
        *draws("slots", "moment, vaccine, n", "slot", replicates),
        "reps AS (SELECT drawn.moment, drawn.vaccine, rep, avg(y) AS b FROM drawn JOIN num ON num.moment = drawn.moment "
        "AND num.vaccine = drawn.vaccine AND num.pos = x % n + 1 GROUP BY ALL)")


# --- the queries ----------------------------------------------------------------------------------------------------------------

def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    day0 = "TIMESTAMP '1995-01-01 06:00:00'"
    days = f"(epoch_us(o_orderdate) - epoch_us({day0})) / 86400000000.0"
    q["titre_parse_long"] = with_cohort(
        "SELECT id, moment, CAST(ord AS INTEGER) AS ord, titre, CASE WHEN titre = 0 THEN 'NR' WHEN titre <> 0 THEN 'R' END AS titre_qual FROM long")
    q["typed_read"] = ("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, TRY_CAST(o_orderpriority AS INTEGER) AS o_rank, "
                       "o_totalprice FROM orders")
    q["scalar_functions"] = (
        "SELECT o_orderkey, upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS priority, "
        "CASE WHEN o_orderpriority LIKE '1%' THEN 'first' ELSE 'other' END AS site, "
        f"{big(f'floor({days})')} AS days, {big(f'floor({days} / 365.25)')} AS years, {r(days, 4)} AS exact_days, "
        f"{r('round_even(o_orderkey / 8.0, 2)', 4)} AS even_rounded, {r('trunc(o_totalprice - 250000)', 4)} AS truncated, "
        "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS band, "
        "o_orderstatus || ' / ' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'NA' END AS label FROM orders")
    q["exposure_rules"] = with_cohort(
        "SELECT id, exposed, CASE WHEN prior_covid = 'NO' AND baseline > 0 THEN 'SI' "
        "WHEN NOT (prior_covid = 'NO' AND baseline > 0) THEN prior_covid END AS corrected, "
        "CASE WHEN prior_covid = 'SI' OR exposed = 'SI' THEN 'Yes' WHEN NOT (prior_covid = 'SI' OR exposed = 'SI') THEN 'No' END AS either "
        "FROM marked WHERE age >= 0")
    q["kleene_strata"] = with_cohort(
        "SELECT 'naive' AS filter, count(*) AS n FROM marked WHERE age >= 0 AND exposed = 'NO' AND prior_covid = 'NO' UNION ALL "
        "SELECT 'not_naive', count(*) FROM marked WHERE age >= 0 AND (exposed <> 'NO' OR prior_covid <> 'NO') UNION ALL "
        "SELECT 'exposed', count(*) FROM marked WHERE age >= 0 AND (exposed = 'SI' OR prior_covid = 'SI')")
    q["recode_fill"] = with_cohort(
        f"SELECT doc_id, CASE WHEN lang IN ('fr', 'en', 'de') THEN lang END AS lang, CAST({levels_case('lang', ('fr', 'en', 'de'))} AS INTEGER) AS lang_ord, "
        "CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' ELSE 'No data' END AS quality FROM scored")
    q["age_band_counts"] = (
        "SELECT CASE WHEN floor(d / 365.25) < 83 THEN '< 83 years' ELSE '>= 83 years' END AS age_group, count(*) AS n FROM "
        "(SELECT CAST(30000 + o_custkey % 900 AS DOUBLE) AS d FROM orders) GROUP BY 1")
    q["complete_cases"] = q["complete_cases_long"] = with_cohort("SELECT id, moment, titre FROM complete")
    q["incomplete_participants"] = with_cohort("SELECT DISTINCT id FROM long WHERE titre IS NULL")
    q["left_join_two_assays"] = with_cohort(f"SELECT id, moment, {r('titre')} AS titre, {r('titre2')} AS titre2 FROM both_assays")
    q["two_assay_counts"] = with_cohort(
        "SELECT moment, count(*) AS n, count(titre) AS n_titre, count(titre2) AS n_titre2 FROM both_assays GROUP BY moment")
    q["duplicate_keys"] = ("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
    q["drop_by_position"] = (
        "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation) "
        "WHERE pos NOT IN (2, 3, 5, 7, 24)")
    q["counts_wide"] = ("SELECT o_orderpriority, " + ", ".join(
        f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
    q["paired_values"] = with_cohort(
        "SELECT a.id, a.moment AS group1, b.moment AS group2, a.titre AS value1, b.titre AS value2 FROM long a JOIN long b USING (id) "
        "WHERE a.titre IS NOT NULL AND b.titre IS NOT NULL AND a.ord < b.ord")
    # summaries
    q["median_by_group_time"] = with_cohort(
        f"SELECT vaccine, moment, count(*) AS n, {r('median(titre)')} AS median FROM known GROUP BY 1, 2", KNOWN)
    q["quartiles_iqr"] = (
        f"SELECT l_returnflag, count(*) AS n, {', '.join(f'{r(quartile("l_extendedprice", p))} AS {n}' for n, p in (('p25', .25), ('p50', .5), ('p75', .75)))}, "
        f"{r(quartile('l_extendedprice', .75) + ' - ' + quartile('l_extendedprice', .25))} AS iqr FROM lineitem GROUP BY 1")
    q["group_counts_labels"] = with_cohort(
        "SELECT vaccine, count(DISTINCT id) AS n, CASE WHEN vaccine = 'BUILDING' THEN 'Building' ELSE vaccine END || "
        "' (n = ' || count(DISTINCT id) || ')' AS label FROM known GROUP BY vaccine", KNOWN)
    q["assay_quartiles"] = with_cohort(
        f"SELECT sex, moment, count(*) AS n, {', '.join(f'{r(quartile("titre2", p))} AS {n}' for n, p in (('p25', .25), ('p50', .5), ('p75', .75)))} "
        "FROM assay LEFT JOIN marked USING (id) WHERE titre2 IS NOT NULL GROUP BY 1, 2")
    q["geomean_by_group"] = with_cohort(
        f"SELECT moment, vaccine, count(*) AS n, {r('exp(avg(ln(y)))')} AS geo_mean FROM floored GROUP BY 1, 2", FLOORED)
    q["log_mean_control"] = with_cohort(
        f"SELECT moment, {r('avg(log10(y))')} AS mean_log10, {r('avg(y)')} AS mean FROM (SELECT moment, CASE WHEN titre = 0 THEN 1.0 ELSE titre END AS y "
        "FROM both_assays WHERE titre2 IS NOT NULL) GROUP BY 1")
    q["moments_by_group"] = (
        f"SELECT l_linestatus, {r('var_samp(l_quantity)')} AS var_l_quantity, {r('stddev_samp(l_quantity)')} AS sd_l_quantity, "
        f"{r('var_samp(l_discount)')} AS var_l_discount, {r('stddev_samp(l_discount)')} AS sd_l_discount, "
        f"{r('covar_samp(l_quantity, l_discount)')} AS cov FROM lineitem GROUP BY 1")
    q["oneway_freq"] = with_cohort(
        f"SELECT quality, n, {r('n / sum(n) OVER ()')} AS percent, CASE WHEN quality IS NOT NULL THEN "
        f"{r('n / sum(n) FILTER (quality IS NOT NULL) OVER ()')} END AS valid_percent, {pct('n / sum(n) OVER ()')} AS percent_text "
        "FROM (SELECT quality, count(*) AS n FROM scored GROUP BY 1)")
    share = "n / sum(n) OVER (PARTITION BY lang)"
    q["crosstab_colpct"] = with_cohort(
        f"SELECT quality, lang, n, {r(share)} AS percent, {pct(share)} || ' (' || n || ')' AS text FROM "
        "(SELECT quality, lang, count(*) AS n FROM scored GROUP BY 1, 2)")
    wide = lambda s: (f"{pct(f'count(*) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)}) / sum(count(*) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)})) OVER ()')} "
                      f"|| ' (' || count(*) FILTER (o_orderstatus = '{s}') || ')' AS {s}")
    q["crosstab_wide"] = f"SELECT o_orderpriority, {', '.join(wide(s) for s in 'FOP')} FROM orders GROUP BY 1"
    q["missing_pareto"] = pareto_sql(["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"])
    q["numeric_profile"] = profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    q["numeric_profile_by_group"] = with_cohort(profile_sql("scored", ["n_chars", "quality", "toxic"], "lang"))
    dd = "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0"
    q["dose_interval_summary"] = (
        f"SELECT o_orderpriority, {r('min(d)')} AS min_days, {r('max(d)')} AS max_days, {r('avg(d)')} AS mean_days, "
        f"{r(quartile('d', .25))} AS p25_days, {r(quartile('d', .5))} AS median_days, {r(quartile('d', .75))} AS p75_days, "
        f"{r(quartile('d', .75) + ' - ' + quartile('d', .25))} AS iqr_days FROM (SELECT o_orderpriority, {dd} AS d FROM orders "
        "JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
    q["table_one"] = table_one_sql()
    q["table_one_overall"] = table_one_sql(overall=True)
    # all expected counts reach five here, so both variables take the chi-square test
    q["table_one_tests"] = with_cohort(
        f"SELECT variable, CASE WHEN min_expected >= 5 THEN 'chi-square' END AS test, {r('statistic')} AS statistic, {r('p')} AS p, "
        f"{r('min_expected')} AS min_expected FROM chi",
        "src AS (SELECT 'quality' AS variable, CAST(quality AS VARCHAR) AS level, lang FROM scored UNION ALL "
        "SELECT 'source', source, lang FROM scored)", *chi_square("src", ["variable"], "level", "lang", yates=False))
    q["table_one_rank_tests"] = with_(
        f"SELECT variable, CASE WHEN min_expected >= 5 THEN 'chi-square' END AS test, {r('statistic')} AS statistic, {r('p')} AS p, {r('min_expected')} AS min_expected FROM chi "
        f"UNION ALL SELECT s, 'k-sample rank', {r('statistic')}, {r('p')}, NULL FROM ks",
        "src AS (SELECT 'l_linestatus' AS variable, l_linestatus AS level, l_returnflag FROM lineitem)", *chi_square("src", ["variable"], "level", "l_returnflag", yates=False),
        "stacked AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, l_returnflag, {c} AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")",
        *k_sample("stacked", "variable", "l_returnflag", "value"))
    q["ksample_by_priority"] = with_(
        f"SELECT s AS o_orderpriority, {big('n')} AS n, groups, {r('statistic')} AS statistic, df, {r('p')} AS p FROM ks",
        *k_sample("orders", "o_orderpriority", "o_orderstatus", "o_totalprice"))
    q["published_result"] = (
        "SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) * CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END AS n, "
        f"{big('sum(CAST(l_quantity AS BIGINT))')} AS quantity FROM lineitem GROUP BY 1, 2, 3")
    q["conform_losses"] = (
        "SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS dropped, count(*) FILTER (o_orderstatus = 'P') AS failed_o_orderkey, "
        "count(*) AS failed_o_rank, 0 AS failed_o_totalprice, count(*) FILTER (o_orderstatus <> 'P') AS kept, "
        "count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 1000) AS prices FROM orders")
    q["characteristics_table"] = characteristics_sql()
    # tests
    q["ranksum_by_stratum"] = with_(
        f"SELECT l_returnflag, {TEST_COLUMNS}, {stars('p')} AS p_signif FROM tests",
        *rank_sum("lineitem", ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"]))
    q["ranksum_pairwise_holm"] = with_(
        f"SELECT l_linestatus, {PAIRWISE} FROM adjusted",
        *rank_sum("lineitem", ["l_linestatus"], "l_returnflag", "l_extendedprice", ["A", "N", "R"]), *holm(["l_linestatus"]))
    q["ranksum_vaccine_by_moment"] = with_cohort(
        f"SELECT exposed, moment, {PAIRWISE} FROM adjusted", KNOWN,
        *rank_sum("known", ["exposed", "moment"], "vaccine", "titre", SEGMENTS), *holm(["exposed", "moment"]))
    # the groups of the second assay have 50 members or more, where the normal approximation applies
    q["ranksum_second_assay"] = with_cohort(
        f"SELECT moment, {TEST_COLUMNS} FROM tests",
        "src AS (SELECT moment, sex, titre2 FROM assay JOIN marked USING (id))",
        *rank_sum("src", ["moment"], "sex", "titre2", ["Femenino", "Masculino"]))
    q["signedrank_pairwise_holm"] = with_cohort(
        f"SELECT vaccine, {PAIRWISE} FROM adjusted", KNOWN, *signed_rank("known", ["vaccine"], "titre", MOMENTS), *holm(["vaccine"]))
    q["signedrank_stored"] = q["signedrank_pairwise_holm"]
    q["complete_cases_stored"] = q["complete_cases_long"]
    q["signedrank_display"] = with_cohort(
        f"SELECT vaccine, CAST(row_number() OVER (ORDER BY vaccine, position) AS INTEGER) AS id, CAST(position AS INTEGER) AS position, group1, group2, "
        f"{r('p_adj')} AS p_adj FROM (SELECT *, CASE WHEN ord1 = 2 AND ord2 = 3 THEN 1 WHEN ord1 = 3 AND ord2 = 4 THEN 2 "
        "WHEN ord1 = 4 AND ord2 = 5 THEN 3 WHEN ord1 = 1 AND ord2 = 3 THEN 4 END AS position FROM adjusted) WHERE position IS NOT NULL",
        KNOWN, *signed_rank("known", ["vaccine"], "titre", MOMENTS), *holm(["vaccine"]))
    q["signedrank_two_level"] = with_cohort(
        f"SELECT {TEST_COLUMNS} FROM tests", *signed_rank("assay", [], "titre2", ["after_dose1", "after_dose2"]))
    cols = f"moment, group1, group2, {big('n1')} AS n1, {big('n2')} AS n2, {r('statistic')} AS statistic, {r('p_adj')} AS p_adj"
    fixed = " UNION ALL ".join(
        f"SELECT 'baseline', '{a}', '{b}', NULL, NULL, NULL, NULL, 'ns'" for i, a in enumerate(SEGMENTS) for b in SEGMENTS[i + 1:])
    q["union_placeholder"] = with_cohort(
        f"SELECT {cols}, {stars('p_adj')} AS p_adj_signif FROM adjusted UNION ALL {fixed}",
        "known AS (SELECT * FROM complete WHERE vaccine IS NOT NULL AND exposed = 'NO' AND moment <> 'baseline')",
        *rank_sum("known", ["moment"], "vaccine", "titre", SEGMENTS), *holm(["moment"]))
    rho = ", ".join(f"{r(c)} AS {c}" for c in ("rho", "ci_low", "ci_high", "t", "p"))
    q["spearman_by_group"] = with_(f"SELECT l_returnflag, n, {rho} FROM full_rho",
                                   *spearman("lineitem", ["l_returnflag"], "l_quantity", "l_extendedprice"))
    q["spearman_exact"] = spearman_exact_sql(rho)
    q["spearman_text"] = with_cohort(
        f"SELECT moment, n, {RHO_TEXT} AS text FROM full_rho",
        "sp AS (SELECT moment, CASE WHEN titre = 0 THEN 1.0 ELSE titre END AS y, titre2 FROM both_assays WHERE titre2 IS NOT NULL)",
        *spearman("sp", ["moment"], "y", "titre2"))
    q["age_correlation"] = with_cohort(
        f"SELECT vaccine, n, {RHO_TEXT} AS text FROM full_rho",
        "sp AS (SELECT vaccine, trunc(age) AS a, titre FROM both_assays WHERE moment = 'after_dose2' AND vaccine IS NOT NULL)",
        *spearman("sp", ["vaccine"], "a", "titre"))
    chi = (f"{big('n_total')} AS n_total, {big('\"rows\"')} AS \"rows\", {big('\"columns\"')} AS \"columns\", {big('df')} AS df, "
           f"{r('statistic')} AS statistic, {r('p')} AS p, {r('min_expected')} AS min_expected")
    q["chisq_status_priority"] = with_(f"SELECT {chi} FROM chi", *chi_square("orders", [], "o_orderstatus", "o_orderpriority"))
    q["chisq_two_by_two"] = with_(
        f"SELECT l_returnflag, {chi} FROM chi",
        "src AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_tax > 0.04 THEN 'yes' ELSE 'no' END AS late FROM lineitem)",
        *chi_square("src", ["l_returnflag"], "l_linestatus", "late"))
    q["fisher_by_language"] = fisher_two_by_two_sql()
    # regression and resampling
    line = f"n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('x_min')} AS x_min, {r('x_max')} AS x_max"
    q["deming_by_group"] = with_(f"SELECT l_returnflag, {line} FROM fit", LOG_LINES, *deming_point("ll", "l_returnflag", "lx", "ly"))
    q["deming_fixed_ratio"] = with_(f"SELECT l_returnflag, {line} FROM fit", LOG_LINES,
                                    *deming_point("ll", "l_returnflag", "lx", "ly", "1.0"))
    q["deming_replicates"] = with_cohort(
        f"SELECT moment, rep AS replicate, {r('slope', 5)} AS slope, {r('intercept', 5)} AS intercept FROM reps", LOG_ASSAYS,
        *deming_reps("la", "moment", "lx", "ly", "id", 100))
    band = ", ".join(f"{r(c, 5)} AS {c}" for c in ("x", "y", "lower", "upper"))
    q["deming_band"] = with_cohort(
        f"SELECT moment, CAST(point AS INTEGER) AS point, {band} FROM band", LOG_ASSAYS, *deming_point("la", "moment", "lx", "ly"),
        *deming_reps("la", "moment", "lx", "ly", "id", 100), *deming_band_ctes("moment", 80))
    q["bootstrap_geomean_exact"] = exact_geomean_sql(10_000, 5)
    q["bootstrap_geomean_poisson"] = poisson_geomean(
        "(SELECT event_type, event_id, CASE WHEN value = 0 THEN 1.0 ELSE value END AS value FROM events)", "event_type", "value", "event_id", 10_000, 5)
    q["error_bars"] = poisson_geomean("orders", "o_orderstatus", "o_totalprice", "o_orderkey", 10_000, 2)
    q["ols_log_price"] = with_(f"SELECT {OLS_COLUMNS} FROM fit", LOG_LINES, *ols_ctes("ll", None, "l_quantity", "log_price"))
    q["ols_by_group"] = with_(f"SELECT l_returnflag, {OLS_COLUMNS} FROM fit", LOG_LINES,
                              *ols_ctes("ll", "l_returnflag", "l_quantity", "log_price"))
    xs = ("l_quantity", "l_discount", "l_tax")
    terms = ["SELECT *, 0 AS position, '(intercept)' AS term, a AS estimate, sigma * ca AS se FROM solved",
             *[f"SELECT *, {i + 1}, '{x}', b{i}, sigma * sqrt(i{i}{i}) FROM solved" for i, x in enumerate(xs)]]
    several = "(1 - r2) / (n - 4)"
    q["ols_several_predictors"] = with_(
        f"SELECT l_returnflag, position, term, {', '.join(f'{r(e, 4)} AS {c}' for c, e in {'estimate': 'estimate', 'se': 'se', 't': 'estimate / se', 'p': student_p('estimate / se', '(n - 4)'), 'sigma': 'sigma', 'r2': 'r2', 'adj_r2': f'1 - {several} * (n - 1)', 'f': f'r2 / 3 / ({several})'}.items())}, n "
        "FROM terms", "ln3 AS (SELECT l_returnflag, l_quantity, l_discount, l_tax, ln(l_extendedprice) AS y FROM lineitem)",
        *normal_equations("ln3", "l_returnflag", xs, "y"), f"terms AS ({' UNION ALL '.join(terms)})")
    q["ols_several_diagnostics"] = with_(
        f"SELECT o_orderkey, o_orderstatus, {r('fitted', 4)} AS fitted, {r('py - fitted', 4)} AS residual, {r('h', 4)} AS leverage, {r('sr', 4)} AS std_residual, "
        f"{r('sr * sr * h / (3 * (1 - h))', 4)} AS cooks_distance FROM (SELECT *, (py - fitted) / (sigma * sqrt(1 - h)) AS sr FROM (SELECT *, "
        "a + b0 * px + b1 * late AS fitted, 1.0 / n + (px - m0) * (px - m0) * i00 + 2 * (px - m0) * (late - m1) * i01 + (late - m1) * (late - m1) * i11 AS h "
        "FROM od2 JOIN solved USING (o_orderstatus)))",
        "od2 AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE) AS px, CAST(dayofyear(o_orderdate) AS DOUBLE) AS late, ln(o_totalprice) AS py FROM orders)",
        *normal_equations("od2", "o_orderstatus", ("px", "late"), "py"))
    q["ols_diagnostics"] = with_(
        f"SELECT o_orderkey, o_orderstatus, {r('px', 4)} AS x, {r('py', 4)} AS y, {r('fitted', 4)} AS fitted, {r('py - fitted', 4)} AS residual, "
        f"{r('h', 4)} AS leverage, {r('sr', 4)} AS std_residual, {r('sr * sr * h / (2 * (1 - h))', 4)} AS cooks_distance FROM "
        "(SELECT *, (py - fitted) / (sigma * sqrt(1 - h)) AS sr FROM (SELECT od.*, sigma, intercept + slope * px AS fitted, "
        "1.0 / n + pow(px - x_mean, 2) / sxx AS h FROM od JOIN fit USING (o_orderstatus)))",
        ORDER_ROWS, *ols_ctes("od", "o_orderstatus", "px", "py"))
    q["ols_global_test"] = global_test_sql()
    q["normal_quantiles"] = with_(
        f"SELECT l_returnflag, {r('l_quantity', 5)} AS l_quantity, n, {r(newton_quantile('pp'), 5)} AS theoretical FROM pp",
        "rk AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS lo, "
        "count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)",
        "vals AS (SELECT l_returnflag, l_quantity, count(*) AS n, min(lo) AS lo, max(total) AS total FROM rk GROUP BY 1, 2)",
        "pp AS (SELECT l_returnflag, l_quantity, n, (lo + (n - 1) / 2.0 - o) / (total + 1 - 2 * o) AS pp FROM "
        "(SELECT *, CASE WHEN total <= 10 THEN 0.375 ELSE 0.5 END AS o FROM vals))")
    # charts
    q["pseudolog_quartiles"] = with_cohort(
        "SELECT vaccine, moment, count(*) AS n, " + ", ".join(
            f"{r(pseudo_back(quartile(pseudo('titre'), p)))} AS {n}" for n, p in (("p25", .25), ("p50", .5), ("p75", .75)))
        + " FROM known GROUP BY 1, 2", KNOWN)
    q["density_by_group"] = density_sql("lineitem", "l_returnflag", "log10(l_extendedprice)", "pow(10.0, pos_at)", 128, "area", 5).replace(
        "SELECT l_returnflag, point,", "SELECT l_returnflag, CAST(point AS INTEGER) AS point,")
    q["density_width_scaled"] = density_sql("events", "event_type", pseudo("value"), pseudo_back("pos_at"), 64, "width", 5).replace(
        "SELECT event_type, point,", "SELECT event_type, CAST(point AS INTEGER) AS point,")
    q["trajectories"] = with_cohort(
        f"SELECT id, CAST({levels_case('moment', ('after_dose1', 'after_dose2'))} AS INTEGER) AS ord, moment, {r('titre2')} AS titre2 FROM assay a "
        "WHERE moment IN ('after_dose1', 'after_dose2') AND id IN (SELECT id FROM assay WHERE moment IN ('after_dose1', 'after_dose2') "
        "AND titre2 IS NOT NULL GROUP BY id HAVING count(*) = 2)")
    q["scatter_band"] = with_(
        f"SELECT o_orderstatus, CAST(point AS INTEGER) AS point, {band} FROM band",
        "ll AS (SELECT o_orderkey, o_orderstatus, log10(CASE WHEN o_custkey = 0 THEN 1.0 ELSE CAST(o_custkey AS DOUBLE) END) AS lx, "
        "log10(CASE WHEN o_totalprice = 0 THEN 1.0 ELSE o_totalprice END) AS ly FROM orders)",
        *deming_point("ll", "o_orderstatus", "lx", "ly"), *deming_reps("ll", "o_orderstatus", "lx", "ly", "o_orderkey", 100),
        *deming_band_ctes("o_orderstatus", 80))
    q["selected_columns"] = "SELECT l_orderkey, l_partkey, l_shipdate AS shipped, l_linenumber FROM lineitem"
    q["typed_positions"] = "SELECT o_orderkey, o_custkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority FROM orders"
    q["large_row_index"] = ("SELECT o_orderkey + 1152921504606846976 AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
    q["drop_with_missing_key"] = (
        "SELECT key, n_name FROM (SELECT *, row_number() OVER (ORDER BY key NULLS FIRST) AS pos FROM "
        "(SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS key, n_name FROM nation)) WHERE pos NOT IN (1, 4)")
    q["characteristics_missing"] = characteristics_missing_sql()
    price = "CASE WHEN l_linenumber > 2 THEN l_extendedprice END"
    q["nan_summaries"] = with_(
        "SELECT * FROM profile JOIN means USING (l_returnflag)",
        f"prices AS (SELECT l_returnflag, {price} AS price FROM lineitem)", f"profile AS ({profile_sql('prices', ['price'], 'l_returnflag')})",
        f"means AS (SELECT l_returnflag, count(price) AS n, {r('exp(avg(ln(price)))', 4)} AS geo_mean, {r('min(price)', 4)} AS min_price, "
        f"{r('max(price)', 4)} AS max_price, {r('avg(price)', 4)} AS mean_price FROM prices GROUP BY 1)")
    at = "SELECT o_orderpriority, o_orderstatus, CAST(epoch_us(o_orderdate) AS DOUBLE) AS stamp FROM orders"
    q["narrow_quartiles"] = (
        "SELECT o_orderstatus, count(*) AS n, " + ", ".join(f"{r(quartile('stamp', p), 0)} AS {n}" for n, p in (("p25", .25), ("p50", .5), ("p75", .75)))
        + f" FROM ({at}) GROUP BY 1")
    q["narrow_ranksum"] = with_(
        f"SELECT o_orderpriority, group1, group2, CAST(ord1 AS INTEGER) AS ord1, CAST(ord2 AS INTEGER) AS ord2, n1, n2, {r('statistic')} AS statistic, "
        f"{r('z')} AS z, {r('p')} AS p FROM tests", f"dates AS ({at})", *rank_sum("dates", ["o_orderpriority"], "o_orderstatus", "stamp", ["F", "O"]))
    # all subsets of a nation's suppliers (all signs of its differences) as bit masks
    two_sided = "least(1.0, 2.0 * CASE WHEN w > middle THEN sum((v >= w)::INT) ELSE sum((v <= w)::INT) END / count(*))"
    q["exact_ranksum"] = (
        "WITH ranked AS (SELECT s_nationkey, s_suppkey % 2 = 0 AS even, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS rk FROM supplier), "
        "g AS (SELECT s_nationkey, count(*) FILTER (even) AS n1, count(*) FILTER (NOT even) AS n2, count(*) AS n, "
        "sum(rk) FILTER (even) - count(*) FILTER (even) * (count(*) FILTER (even) + 1) / 2.0 AS w FROM ranked GROUP BY 1), "
        "m AS (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM g WHERE n1 > 0 AND n2 > 0), "
        "v AS (SELECT *, n1 * n2 / 2.0 AS middle, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) "
        "- n1 * (n1 + 1) / 2.0 AS v FROM m WHERE bit_count(mask) = n1) "
        f"SELECT s_nationkey, n1, n2, {r('w')} AS statistic, {r(two_sided)} AS p FROM v GROUP BY s_nationkey, n1, n2, w, middle")
    q["exact_signedrank"] = (
        "WITH d AS (SELECT s_nationkey, s_acctbal - (s_suppkey * 377 % 1009) * 7.25 AS d FROM supplier), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(d)) AS rk FROM d), "
        "g AS (SELECT s_nationkey, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w FROM ranked GROUP BY 1), "
        "v AS (SELECT *, n * (n + 1) / 4.0 AS middle, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) AS v "
        "FROM (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM g)) "
        f"SELECT s_nationkey, n AS n1, {r('w')} AS statistic, {r(two_sided)} AS p FROM v GROUP BY s_nationkey, n, w, middle")
    # the same with mid-ranks (doubled): every permutation of tied samples, every sign of tied differences
    picked = "list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN a[i] ELSE 0 END))"
    doubled = "2 * rank() OVER (PARTITION BY l_orderkey ORDER BY x) - 1 + count(*) OVER (PARTITION BY l_orderkey, x) AS a"
    both = "least(1.0, 2.0 * least(sum((v >= w)::INT), sum((v <= w)::INT)) / count(*))"
    q["tied_ranksum"] = (
        f"WITH ranked AS (SELECT *, {doubled} FROM (SELECT l_orderkey, l_linestatus = 'F' AS f, l_discount AS x FROM lineitem)), "
        "g AS (SELECT l_orderkey, list(a ORDER BY a) AS a, count(*) AS n, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(a) FILTER (f) AS w "
        "FROM ranked GROUP BY 1 HAVING count(*) FILTER (f) > 0 AND count(*) FILTER (NOT f) > 0), "
        "m AS (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM g), "
        f"v AS (SELECT *, {picked} AS v FROM m WHERE bit_count(mask) = n1) "
        f"SELECT l_orderkey, n1, n2, {r('(w - n1 * (n1 + 1)) / 2.0', 12)} AS statistic, {r(both, 12)} AS p FROM v GROUP BY l_orderkey, n1, n2, w")
    q["tied_signedrank"] = (
        "WITH d AS (SELECT l_orderkey, round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), "
        f"ranked AS (SELECT *, {doubled} FROM (SELECT l_orderkey, d, abs(d) AS x FROM d WHERE d <> 0)), "
        "g AS (SELECT l_orderkey, list(a ORDER BY a) AS a, count(*) AS n, coalesce(sum(a) FILTER (d > 0), 0) AS w FROM ranked GROUP BY 1), "
        f"v AS (SELECT *, {picked} AS v FROM (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM g)), "
        f"p AS (SELECT l_orderkey, w / 2.0 AS s, {both} AS p FROM v GROUP BY l_orderkey, w) "
        f"SELECT d.l_orderkey, count(*) AS n1, {r('coalesce(any_value(s), 0)', 12)} AS statistic, {r('coalesce(any_value(p), 1)', 12)} AS p "
        "FROM d LEFT JOIN p USING (l_orderkey) GROUP BY d.l_orderkey")
    q["fisher_three_rows"] = fisher_three_rows_sql()
    q["age_regression"] = with_cohort(
        f"SELECT {OLS_COLUMNS} FROM fit",
        "ar AS (SELECT trunc(age) AS a, ln(CASE WHEN titre = 0 THEN 1.0 ELSE titre END) AS y FROM both_assays WHERE moment = 'after_dose2' "
        "AND vaccine IS NOT NULL AND exposed = 'NO' AND prior_covid = 'NO' AND titre IS NOT NULL AND age IS NOT NULL)",
        *ols_ctes("ar", None, "a", "y"))
    return q
