"""Upper-tail probabilities of the normal, t and F distributions.

Small per-value math used only on final result rows (a handful per test).
Tails are computed as survival functions directly, never as ``1 - CDF``, so
p-values far below 1e-16 keep their magnitude; ``log_p`` gives the logarithm
of every tail in its own right, also where the p-value is below the least
double.
"""

from __future__ import annotations

import math

_EPS = 1e-300
_TOL = 1e-15
_MAX_ITER = 100000


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _EPS if abs(d) < _EPS else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER):
        m2 = 2 * m
        num = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + num * d
        d = _EPS if abs(d) < _EPS else d
        c = 1.0 + num / c
        c = _EPS if abs(c) < _EPS else c
        d = 1.0 / d
        h *= d * c
        num = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + num * d
        d = _EPS if abs(d) < _EPS else d
        c = 1.0 + num / c
        c = _EPS if abs(c) < _EPS else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < _TOL:
            break
    return h


def _stirling_corr(z: float) -> float:
    """lgamma(z) - [(z - 1/2) ln z - z + ln(2 pi) / 2] for large z."""
    z2 = z * z
    return 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z2) + 1.0 / (1260.0 * z * z2 * z2)


def _lgamma_shift(z: float, d: float) -> float:
    """lgamma(z + d) - lgamma(z) without cancellation when z >> d."""
    return (d * math.log(z) + (z + d - 0.5) * math.log1p(d / z) - d
            + _stirling_corr(z + d) - _stirling_corr(z))


def log_beta(a: float, b: float) -> float:
    """log B(a, b); stable when one argument is huge (t tests with ~1e11
    degrees of freedom) where lgamma differences would cancel."""
    big, small = max(a, b), min(a, b)
    if big < 1e6 or small > 1e3:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return math.lgamma(small) - _lgamma_shift(big, small)


def log_betainc(a: float, b: float, x: float, y: float, log_x: float, log_y: float) -> float:
    """log I_x(a, b), with y = 1 - x."""
    if x <= 0.0 and log_x == float("-inf"):
        return float("-inf")
    if y <= 0.0:
        return 0.0
    log_front = a * log_x + b * log_y - log_beta(a, b)
    if x < (a + 1.0) / (a + b + 2.0):
        return log_front + math.log(_beta_cf(a, b, x)) - math.log(a)
    return log_complement(log_front + math.log(_beta_cf(b, a, y)) - math.log(b))


def log_complement(log_p: float) -> float:
    """log(1 - exp(log_p))."""
    if log_p >= 0.0:
        return float("-inf")
    return math.log1p(-math.exp(log_p)) if log_p < -0.7 else math.log(-math.expm1(log_p))


# Above this many degrees of freedom the continued fraction loses accuracy
# (x is within ~1/df of 1); tails are integrated from the exact log density.
LARGE_DF = 1e5
_QUAD_N = 200_000


def _log_tail_quad(log_density, a: float, scale: float) -> float:
    """log P(X > a): the integral of exp(log_density) over x = a + scale *
    u / (1 - u), u in (0, 1), by the midpoint rule, summed around its greatest
    term (vectorised NumPy)."""
    import numpy as np
    u = (np.arange(_QUAD_N, dtype=float) + 0.5) / _QUAD_N
    terms = log_density(a + scale * u / (1.0 - u)) - 2.0 * np.log1p(-u)
    top = float(terms.max())
    return top + math.log(float(np.sum(np.exp(terms - top)))) + math.log(scale / _QUAD_N)


def _log_t_upper_large_df(t: float, df: float) -> float:
    """log P(T > t), t >= 0, for huge df."""
    import numpy as np
    log_c = _lgamma_shift(df / 2.0, 0.5) - 0.5 * math.log(df * math.pi)

    def ld(x):
        return log_c - (df + 1.0) / 2.0 * np.log1p(x * x / df)
    # the density falls off by this factor a unit at t
    rate = (df + 1.0) * t / (df + t * t)
    return _log_tail_quad(ld, t, 1.0 / rate if t > 1.0 else 1.0)


def _log_f_upper_large_d2(f: float, d1: float, d2: float) -> float:
    import numpy as np
    const = d1 / 2.0 * math.log(d1 / d2) - log_beta(d1 / 2.0, d2 / 2.0)

    def ld(x):
        return const + (d1 / 2.0 - 1.0) * np.log(x) - (d1 + d2) / 2.0 * np.log1p(d1 * x / d2)
    rate = (d1 + d2) / 2.0 * (d1 / d2) / (1.0 + d1 * f / d2) - (d1 / 2.0 - 1.0) / f
    return _log_tail_quad(ld, f, 1.0 / max(1.0, rate))


def norm_sf(z: float) -> float:
    """P(Z > z) for a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_sf_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))


def _log_t_two_sided(t: float, df: float) -> float:
    """log P(|T| > t), t > 0."""
    if df > LARGE_DF:
        return min(0.0, math.log(2.0) + _log_t_upper_large_df(t, df))
    r = t * t / df
    log_x = -math.log1p(r)
    return min(0.0, log_betainc(df / 2.0, 0.5, 1.0 / (1.0 + r), r / (1.0 + r), log_x, math.log(r) + log_x if r > 0 else float("-inf")))


def log_t_sf(t: float, df: float) -> float:
    """log P(T > t) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return float("-inf") if t > 0 else 0.0
    if t == 0:
        return math.log(0.5)
    tail = _log_t_two_sided(abs(t), df) - math.log(2.0)
    return tail if t > 0 else log_complement(tail)


def log_t_sf_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return float("-inf")
    return _log_t_two_sided(abs(t), df) if t else 0.0


def log_f_sf(f: float, d1: float, d2: float) -> float:
    """log P(F > f) for an F(d1, d2) variable."""
    if f is None or d1 is None or d2 is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return float("-inf")
    if f <= 0:
        return 0.0
    if d2 > LARGE_DF and d1 <= 1000:
        return min(0.0, _log_f_upper_large_d2(f, d1, d2))
    r = d1 * f / d2
    return min(0.0, log_betainc(d2 / 2.0, d1 / 2.0, 1.0 / (1.0 + r), r / (1.0 + r), -math.log1p(r), math.log(r) - math.log1p(r)))


def log_norm_sf(z: float) -> float:
    """log P(Z > z); beyond 30 by the tail's asymptotic series."""
    if z < 30.0:
        return math.log(norm_sf(z)) if z > -30.0 else log_complement(log_norm_sf(-z))
    v = 1.0 / (z * z)
    series = 1.0 - v * (1.0 - 3.0 * v * (1.0 - 5.0 * v * (1.0 - 7.0 * v)))
    return -z * z / 2.0 - math.log(z) - 0.5 * math.log(2.0 * math.pi) + math.log(series)


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    return math.exp(log_t_sf(t, df))


def t_sf_two_sided(t: float, df: float) -> float:
    return math.exp(log_t_sf_two_sided(t, df))


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F(d1, d2) variable."""
    return math.exp(log_f_sf(f, d1, d2))


def log_p(kind: str, stat: float, df1: float | None = None, df2: float | None = None) -> float:
    """log of the p-value, NaN without one; -inf for an infinite statistic."""
    if stat is None or math.isnan(stat):
        return float("nan")
    if kind == "t_greater":
        return log_t_sf(stat, df1)
    if kind == "t_less":
        return log_t_sf(-stat, df1)
    if kind == "t_two_sided":
        return log_t_sf_two_sided(stat, df1)
    if kind == "f_upper":
        return log_f_sf(stat, df1, df2)
    if kind == "norm_two_sided":
        return min(0.0, math.log(2.0) + log_norm_sf(abs(stat)))
    if kind == "norm_greater":
        return log_norm_sf(stat)
    raise ValueError(f"unknown tail kind {kind!r}")


def p_value(kind: str, stat: float, df1: float | None = None,
            df2: float | None = None) -> float:
    """The p-value of a statistic, NaN without one."""
    if kind.startswith("norm") and stat is not None and not math.isnan(stat):
        return norm_sf_two_sided(stat) if kind == "norm_two_sided" else norm_sf(stat)
    return math.exp(log_p(kind, stat, df1, df2))


def mwu_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) under H0 without ties, from the q-binomial generating
    function (depends only on n1, n2; no data needed)."""
    import numpy as np

    m, n = int(min(n1, n2)), int(max(n1, n2))
    size = m * n + 1
    poly = np.zeros(size)
    poly[0] = 1.0
    # prod_{i=1..m} (1 - q^(n+i)) / (1 - q^i), truncated to degree m*n
    for i in range(1, m + 1):
        up = poly.copy()
        up[n + i:] -= poly[: size - (n + i)]
        for k in range(i, size):  # divide by (1 - q^i): running sum with stride i
            up[k] += up[k - i]
        poly = up
    total = poly.sum()
    k = int(math.ceil(u - 1e-9))
    if k <= 0:
        return 1.0
    if k >= size:
        return 0.0
    return float(poly[k:].sum() / total)


def mwu_p_two_sided(u1: float, n1: float, n2: float, tie_term: float,
                    use_continuity: bool = True, exact_limit: int = 8) -> tuple[float, str]:
    """Two-sided Mann-Whitney p for U of the first sample.

    Exact when a sample has at most ``exact_limit`` rows and there are no
    ties; otherwise the tie-corrected normal approximation with continuity
    correction."""
    n1, n2 = float(n1), float(n2)
    if n1 <= 0 or n2 <= 0:
        return float("nan"), "none"
    big_u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= exact_limit and tie_term == 0:
        return min(1.0, 2.0 * mwu_exact_sf(big_u, int(n1), int(n2))), "exact"
    n = n1 + n2
    mu = n1 * n2 / 2.0
    var = n1 * n2 / 12.0 * ((n + 1.0) - tie_term / (n * (n - 1.0)))
    if var <= 0:
        return float("nan"), "asymptotic"
    z = (big_u - mu - (0.5 if use_continuity else 0.0)) / math.sqrt(var)
    return min(1.0, 2.0 * norm_sf(z)), "asymptotic"
