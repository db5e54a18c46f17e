"""Distribution tails and quantiles as Spark SQL expressions.

Spark has no ``erf``, ``lgamma`` or Student-t function, so the tails needed by the test operators are written with the
published approximations below.  They stay JVM-side.  Arguments are SQL expression texts (usually a column name) and the
result is a Column: a formula is one parsed expression instead of several hundred Column calls, and its argument is bound
once to a lambda variable so that collapsed projections do not copy it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of erf and erfc (W. J. Cody, Math. Comp. 23, 1969), highest power last.
ERF_NUM = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00,
           1.85777706184603153e-1)
ERF_DEN = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0)
ERFC_MID_NUM = (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02,
                2.98635138197400131e02, 6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1,
                2.15311535474403846e-8)
ERFC_MID_DEN = (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03,
                1.62138957456669019e03, 5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0)
ERFC_FAR_NUM = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1,
                3.05326634961232344e-1, 1.63153871373020978e-2)
ERFC_FAR_DEN = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e00,
                2.56852019228982242e00, 1.0)

# Normal quantile, algorithm AS 241 (M. J. Wichura, Appl. Statist. 37, 1988), highest power last.
QNORM_CENTRE_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
                    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
QNORM_CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
QNORM_MID_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
                 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2,
                 7.74545014278341407640e-4)
QNORM_MID_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
                 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
                 1.05075007164441684324e-9)
QNORM_FAR_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
                 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
                 2.71155556874348757815e-5, 2.01033439929228813265e-7)
QNORM_FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
                 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
                 2.04426310338993978564e-15)


def number(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def _let(**bindings: str):
    """Bind expressions to the fields of lambda variable ``a`` while evaluating a formula over them."""
    fields = ", ".join(f"'{name}', {expr}" for name, expr in bindings.items())
    return lambda formula: f"get(transform(array(named_struct({fields})), a -> {formula}), 0)"


def polynomial(x: str, coefficients: Sequence[float]) -> str:
    """Horner form; ``coefficients`` start with the constant term."""
    out = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {number(c)})"
    return out


def _ratio(x: str, num: Sequence[float], den: Sequence[float]) -> str:
    return f"({polynomial(x, num)} / {polynomial(x, den)})"


def erfc_sql(x: str) -> str:
    """Complementary error function, relative error about 1e-15."""
    upper = _let(x="a.x", m="abs(a.x)", s="a.x * a.x", i="1D / greatest(a.x * a.x, 0.1D)", g="exp(-a.x * a.x)")(
        f"""CASE WHEN a.m <= 0.46875D THEN 1D - a.m * {_ratio('a.s', ERF_NUM, ERF_DEN)}
                 WHEN a.m <= 4D THEN a.g * {_ratio('a.m', ERFC_MID_NUM, ERFC_MID_DEN)}
                 WHEN a.m <= 26.5D THEN a.g / a.m
                      * ({number(1.0 / math.sqrt(math.pi))} - a.i * {_ratio('a.i', ERFC_FAR_NUM, ERFC_FAR_DEN)})
                 ELSE 0D END""")
    return _let(x=f"CAST({x} AS DOUBLE)")(
        f"CASE WHEN a.x IS NULL THEN NULL WHEN a.x >= 0 THEN {upper} ELSE 2D - {upper} END")


def normal_two_sided_sql(z: str) -> str:
    return erfc_sql(f"abs({z}) * {number(math.sqrt(0.5))}")


def normal_quantile_sql(p: str) -> str:
    tail = (f"CASE WHEN a.r <= 5D THEN {_ratio('(a.r - 1.6D)', QNORM_MID_NUM, QNORM_MID_DEN)} "
            f"ELSE {_ratio('(a.r - 5D)', QNORM_FAR_NUM, QNORM_FAR_DEN)} END")
    centre = f"a.q * {_ratio('(0.180625D - a.q * a.q)', QNORM_CENTRE_NUM, QNORM_CENTRE_DEN)}"
    inner = _let(q="a.p - 0.5D", r="sqrt(-ln(least(a.p, 1D - a.p)))")(
        f"CASE WHEN abs(a.q) <= 0.425D THEN {centre} ELSE signum(a.q) * {tail} END")
    return _let(p=f"CAST({p} AS DOUBLE)")(f"CASE WHEN a.p > 0 AND a.p < 1 THEN {inner} END")


def _series(terms: str, first: str, factor: str) -> str:
    """Sum of ``terms`` terms, starting with ``first``; term k+1 is term k times ``factor`` (a text in k)."""
    return (f"aggregate(sequence(1, greatest(CAST({terms} AS INT), 1)), named_struct('total', 0D, 'term', {first}), "
            f"(c, k) -> named_struct('total', c.total + c.term, 'term', c.term * {factor}), c -> c.total)")


def chi2_upper_sql(x: str, df: str) -> str:
    """Upper tail of chi-square with integer degrees of freedom: finite sums of about df/2 terms."""
    # even df: exp(-h) sum h^k / k!     odd df: erfc(sqrt h) + exp(-h) sum h^(k-1/2) / Gamma(k+1/2),  h = x/2
    even = f"exp(-a.h) * {_series('a.df / 2', '1D', 'a.h / k')}"
    more = _series("(a.df - 1) / 2", f"sqrt(a.h) * {number(2.0 / math.sqrt(math.pi))}", "a.h / (k + 0.5D)")
    odd = f"{erfc_sql('sqrt(a.h)')} + CASE WHEN a.df >= 3 THEN exp(-a.h) * {more} ELSE 0D END"
    return _let(h=f"CAST({x} AS DOUBLE) / 2D", df=f"CAST({df} AS BIGINT)")(
        f"CASE WHEN a.df < 1 THEN NULL WHEN a.h <= 0 THEN 1D WHEN a.df % 2 = 0 THEN {even} ELSE {odd} END")


def student_t_two_sided_sql(t: str, df: str) -> str:
    """P(|T| > |t|) for integer degrees of freedom.

    Up to 40 degrees of freedom the finite trigonometric series is summed; above that the expansion of G. W. Hill (CACM
    algorithm 395, 1970) maps t to a normal deviate, so the cost does not grow with df.
    """
    cos2, sin = "(a.df / (a.df + a.t * a.t))", "(abs(a.t) / sqrt(a.df + a.t * a.t))"
    odd = (f"1D - {number(2.0 / math.pi)} * (atan(abs(a.t) / sqrt(a.df)) + CASE WHEN a.df > 1 THEN {sin} * "
           f"{_series('(a.df - 1) / 2', f'sqrt({cos2})', f'{cos2} * (2D * k) / (2D * k + 1D)')} ELSE 0D END)")
    even = f"1D - {sin} * {_series('a.df / 2', '1D', f'{cos2} * (2D * k - 1D) / (2D * k)')}"
    expansion = _let(b="48D * (a.df - 0.5D) * (a.df - 0.5D)", y="(a.df - 0.5D) * log1p(a.t * a.t / a.df)")(
        "sqrt(a.y) * (((((-0.4D * a.y - 3.3D) * a.y - 24D) * a.y - 85.5D) "
        "/ (0.8D * a.y * a.y + 100D + a.b) + a.y + 3D) / a.b + 1D)")
    return _let(t=f"CAST({t} AS DOUBLE)", df=f"CAST({df} AS BIGINT)")(
        f"CASE WHEN a.df < 1 OR a.t IS NULL THEN NULL WHEN a.df > 40 THEN {normal_two_sided_sql(expansion)} "
        f"WHEN a.df % 2 = 1 THEN {odd} ELSE {even} END")


def erfc(x: str) -> Column:
    return F.expr(erfc_sql(x))


def normal_two_sided(z: str) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    return F.expr(normal_two_sided_sql(z))


def normal_quantile(p: str) -> Column:
    """Inverse of the standard normal distribution function; NULL outside (0, 1)."""
    return F.expr(normal_quantile_sql(p))


def chi2_upper(x: str, df: str) -> Column:
    return F.expr(chi2_upper_sql(x, df))


def student_t_two_sided(t: str, df: str) -> Column:
    return F.expr(student_t_two_sided_sql(t, df))
