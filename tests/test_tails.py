import itertools
import math

import numpy as np
import pytest

from ratestat.functions import tails


def test_normal_two_sided():
    assert tails.norm_sf_two_sided(1.3851370514) == pytest.approx(0.1660105644, abs=1e-9)
    # far tail keeps its magnitude (never 1 - CDF)
    assert tails.norm_sf_two_sided(32.0) == pytest.approx(1.0904161207e-224, rel=1e-8)


def test_t_and_f_agree():
    t, df = -1.4193491448, 9.0
    p_t = tails.t_sf_two_sided(t, df)
    p_f = tails.f_sf(t * t, 1, df)
    assert p_t == pytest.approx(p_f, rel=1e-9)
    assert tails.t_sf(t, df) + tails.t_sf(-t, df) == pytest.approx(1.0, abs=1e-12)


def test_t_tail_against_quadrature():
    # independent numeric integration of the t density
    df, a = 7.0, 2.5
    x = np.linspace(a, 400, 2_000_001)
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    dens = np.exp(logc - (df + 1) / 2 * np.log1p(x * x / df))
    approx = np.trapezoid(dens, x)
    assert tails.t_sf(a, df) == pytest.approx(approx, rel=1e-6)


def test_f_tail_tiny_but_positive():
    p = tails.f_sf(1000.0, 1, 60000)
    assert 0 < p < 1e-200
    assert p == pytest.approx(tails.t_sf_two_sided(1000.0 ** 0.5, 60000), rel=1e-8)


def _exact_sf_bruteforce(u, n1, n2):
    pool = list(range(n1 + n2))
    count = total = 0
    for pick in itertools.combinations(pool, n1):
        s = set(pick)
        # U of the first sample: pairs (a > b)
        ua = sum(1 for a in pick for b in pool if b not in s and a > b)
        total += 1
        count += ua >= u
    return count / total


@pytest.mark.parametrize("n1,n2,u", [(3, 4, 9), (2, 5, 8), (4, 4, 12), (3, 3, 5)])
def test_mwu_exact_matches_enumeration(n1, n2, u):
    assert tails.mwu_exact_sf(u, n1, n2) == pytest.approx(_exact_sf_bruteforce(u, n1, n2), abs=1e-12)


def test_mwu_asymptotic_hand_value():
    # ties: three 2s (24) and two 5s (6) -> tie term 30
    p, method = tails.mwu_p_two_sided(7.0, 5, 6, 30.0)
    assert method == "asymptotic"
    assert p == pytest.approx(0.1660105644, abs=1e-9)


@pytest.mark.parametrize("df", [1e9, 1e11])
@pytest.mark.parametrize("t", [0.5, 2.0, 8.0, 20.0])
def test_t_tail_huge_df_is_normal(df, t):
    # the t law is normal to O(1/df): relative agreement must be ~1e-8 or better
    assert tails.t_sf(t, df) == pytest.approx(tails.norm_sf(t), rel=1e-7)
    assert tails.f_sf(t * t, 1, df) == pytest.approx(2 * tails.norm_sf(t), rel=1e-7)


def test_log_beta_branches_agree():
    for a, b in [(10.0, 0.5), (2e5, 0.5), (5e5, 3.0)]:
        assert tails.log_beta(a, b) == pytest.approx(
            math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b), abs=1e-9)
    z = 3e6
    assert tails._lgamma_shift(z, 0.5) == pytest.approx(math.lgamma(z + 0.5) - math.lgamma(z), abs=1e-6)


def _log_quadrature(log_density, a, rate, n=2_000_000):
    """ln of the integral of the density above ``a`` over 800 of its lengths."""
    x = a + (np.arange(n) + .5) * (800 / rate / n)
    v = log_density(x)
    return v.max() + math.log(np.exp(v - v.max()).sum() * 800 / rate / n)


@pytest.mark.parametrize("t,df", [(335.0, 2e5), (425.0, 6e4), (60.0, 1e9), (1000.0, 3e5)])
def test_log_t_tail_below_the_least_double(t, df):
    c = tails._lgamma_shift(df / 2, .5) - .5 * math.log(df * math.pi)
    want = _log_quadrature(lambda x: c - (df + 1) / 2 * np.log1p(x * x / df), t, (df + 1) * t / (df + t * t))
    assert tails.t_sf(t, df) == 0.0
    assert tails.log_t_sf(t, df) == pytest.approx(want, abs=2e-5)
    assert tails.log_t_sf_two_sided(-t, df) == pytest.approx(want + math.log(2), abs=2e-5)
    assert tails.log_f_sf(t * t, 1, df) == pytest.approx(want + math.log(2), abs=5e-4)


@pytest.mark.parametrize("f,d1,d2", [(1.1e5, 2, 6e4), (1.1e5, 5, 4e5), (9e3, 30, 9e4)])
def test_log_f_tail_below_the_least_double(f, d1, d2):
    c = d1 / 2 * math.log(d1 / d2) - tails.log_beta(d1 / 2, d2 / 2)
    rate = (d1 + d2) / 2 * (d1 / d2) / (1 + d1 * f / d2) - (d1 / 2 - 1) / f
    want = _log_quadrature(lambda x: c + (d1 / 2 - 1) * np.log(x) - (d1 + d2) / 2 * np.log1p(d1 * x / d2), f, rate)
    assert tails.f_sf(f, d1, d2) == 0.0
    assert tails.log_f_sf(f, d1, d2) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("kind,stat,df1,df2", [("t_greater", 2.5, 7, None), ("t_less", 2.5, 7, None), ("t_two_sided", -3.0, 2e6, None),
                                               ("f_upper", 3.0, 4, 50), ("f_upper", .2, 4, 2e6), ("norm_two_sided", 1.4, None, None),
                                               ("norm_greater", -2.0, None, None), ("norm_greater", 12.0, None, None)])
def test_log_tail_is_the_logarithm(kind, stat, df1, df2):
    assert tails.log_p(kind, stat, df1, df2) == pytest.approx(math.log(tails.p_value(kind, stat, df1, df2)), abs=1e-12)


def test_log_normal_tail_branches_meet():
    v = 1 / 30.0 ** 2
    series = 1 - v * (1 - 3 * v * (1 - 5 * v * (1 - 7 * v)))
    assert tails.log_norm_sf(29.999999) == pytest.approx(
        -29.999999 ** 2 / 2 - math.log(29.999999 * math.sqrt(2 * math.pi)) + math.log(series), abs=1e-9)
    assert tails.log_p("t_two_sided", float("inf"), 5.0) == float("-inf") and math.isnan(tails.log_p("t_greater", 1.0, 0.0))


def test_log10_p_orders_results_without_a_p_value(spark):
    from ratestat.functions.pvalues import with_p_value
    df = spark.createDataFrame([(1, 335.0, 2e5), (2, 400.0, 2e5), (3, 2.0, 9.0), (4, None, 9.0), (5, float("inf"), 9.0)],
                               "i int, t double, df double")
    got = {r["i"]: r for r in with_p_value(df, "t_two_sided", "t", "df").collect()}
    assert got[1]["p_value"] == got[2]["p_value"] == got[5]["p_value"] == 0
    assert got[2]["log10_p"] < got[1]["log10_p"] < -10000 and got[3]["log10_p"] == pytest.approx(math.log10(got[3]["p_value"]))
    assert got[4]["p_value"] is None and got[4]["log10_p"] is None and got[5]["log10_p"] is None
