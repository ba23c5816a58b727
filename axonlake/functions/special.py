"""Normal, t, F, chi-square and hypergeometric probabilities: as column expressions, and as NumPy-free Python for small kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Chebyshev coefficients of the complementary error function (relative error below 1.2e-7 everywhere).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def norm_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def norm_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return erfc(F.abs(z) / math.sqrt(2))


def erfc_sql(x: str) -> str:
    """The same expression in SQL, for oracles."""
    t = f"(1 / (1 + abs({x}) / 2))"
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    r = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {r} ELSE 2 - {r} END)"


#: Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x, coefficients, end=None):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out if end is None else out * x + end


def norm_ppf(p: Column) -> Column:
    """The normal quantile; null outside (0, 1)."""
    lit = lambda xs: [F.lit(x) for x in xs]
    q = p - 0.5
    r = q * q
    mid = _horner(r, lit(PPF_A)) * q / _horner(r, lit(PPF_B), F.lit(1.0))
    tail = lambda y: _horner(y, lit(PPF_C)) / _horner(y, lit(PPF_D), F.lit(1.0))
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(mid)


def norm_ppf_sql(p: str) -> str:
    h = lambda x, cs, end=None: (lambda s: s if end is None else f"({s} * {x} + {end})")(_nest(x, cs))
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"({h(r, PPF_A)} * {q} / {h(r, PPF_B, 1.0)})"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda y: f"({h(y, PPF_C)} / {h(y, PPF_D, 1.0)})"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > {1 - 0.02425} THEN -{tail(high)} ELSE {mid} END)"


def _nest(x: str, cs: tuple) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows where both are known; null for a constant (the built-in divides by zero there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    u, v = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    s, t = F.stddev_pop(u), F.stddev_pop(v)
    return F.when((s > 1e-9) & (t > 1e-9), F.covar_pop(u, v) / (s * t))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    if not (f >= 0 and d1 > 0 and d2 > 0):
        return math.nan
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return 1 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2) if df > 0 else math.nan


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Exact test of a 2 x 2 table: the sum of all tables as improbable as this one or more."""
    n, row, col = a + b + c + d, a + b, a + c
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    lp = lambda k: choose(col, k) + choose(n - col, row - k) - choose(n, row)
    own = lp(a)
    ks = range(max(0, row + col - n), min(row, col) + 1)
    return min(1.0, sum(math.exp(x) for x in map(lp, ks) if x <= own + 1e-7))
