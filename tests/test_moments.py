"""Block accumulators against plain numpy."""

import numpy as np
import pytest

from ratestat.operators import classify, describe, gram, moments


def gaps(rng, n, p):
    x = (rng.normal(size=(n, p)) + 10.0 ** rng.integers(0, 5, p)) * 10.0 ** rng.integers(-3, 6, p)
    x[rng.random((n, p)) < .2] = np.nan
    x[:, 0] = 5.0
    return x


def plain_corr(x):
    p = x.shape[1]
    out = np.full((p, p), np.nan)
    for i in range(p):
        for j in range(p):
            at = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[at, i], x[at, j]
            if len(a) and a.min() < a.max() and b.min() < b.max():
                a, b = a - a.mean(), b - b.mean()
                out[i, j] = a @ b / np.sqrt((a @ a) * (b @ b))
    return out


@pytest.mark.parametrize("cuts", [[], [1], [7, 8, 200], list(range(0, 300, 3))])
def test_merged_blocks_equal_the_whole(cuts):
    rng = np.random.default_rng(len(cuts))
    x = gaps(rng, 300, 5)
    state = None
    for part in np.split(x, cuts):
        one = moments.block_pairs(part)
        state = one if state is None else moments.merge_pairs(state, one)
    m = moments.unpack_pairs(state)
    for i in range(5):
        for j in range(5):
            at = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[at, i], x[at, j]
            assert m["n"][i, j] == len(a) and m["low"][i, j] == a.min() and m["high"][i, j] == a.max()
            assert m["mean"][i, j] == pytest.approx(a.mean(), rel=1e-12)
            assert m["spread"][i, j] == pytest.approx(len(a) * a.var(), rel=1e-9, abs=1e-300)
            assert m["cross"][i, j] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(),
                                                     rel=1e-9, abs=1e-9 * len(a) * a.std() * b.std())
    whole = x[~np.isnan(x).any(axis=1)]
    state = moments.block_moments(whole[:40])
    for part in (whole[40:41], whole[41:41], whole[41:]):
        state = moments.merge_moments(state, moments.block_moments(part))
    n, mean, cross = moments.unpack_moments(state)
    y = whole - whole.mean(axis=0)
    assert n == len(whole) and np.allclose(mean, whole.mean(axis=0), rtol=1e-12)
    assert np.allclose(cross, y.T @ y, rtol=1e-9, atol=1e-9 * np.outer(np.linalg.norm(y, axis=0), np.linalg.norm(y, axis=0)))
    assert cross[0, 0] == 0


def test_correlations_with_gaps(spark):
    x = gaps(np.random.default_rng(2), 400, 6)
    x[:, 5] = np.nan
    x[np.isnan(x[:, 1]), 2] = 1.0       # column 2 is no constant, but one where column 1 is missing
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"c{i} double" for i in range(6))).repartition(5)
    got = {(r["row"], r["col"]): r["r"] for r in describe.corr_matrix(df, [f"c{i}" for i in range(6)]).collect()}
    want = plain_corr(x)
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            r = got[f"c{i}", f"c{j}"]
            assert (r is None) == np.isnan(want[i, j]) and (r is None or r == pytest.approx(want[i, j], abs=1e-9))
    nothing = describe.corr_matrix(df.limit(0), ["c1", "c2"]).collect()
    assert len(nothing) == 4 and all(r["r"] is None for r in nothing)


def test_one_scan_and_no_row_of_products(spark):
    df = spark.range(500).selectExpr(*[f"cast((id * {k}) % 101 as double) as c{k}" for k in range(1, 30)])
    plan = describe.corr_matrix(df, df.columns)._jdf.queryExecution().toString()
    assert plan.count("Range (0, 500") <= plan.count("== ") and "MapInArrow" in plan


def test_wide_ridge_and_vif_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 20)) @ rng.normal(size=(20, 20)) + rng.normal(size=20) * 100
    y = x @ rng.normal(size=20) + rng.normal(size=600)
    names = [f"f{i}" for i in range(20)]
    df = spark.createDataFrame([(*map(float, r), float(t), i % 5 == 0) for i, (r, t) in enumerate(zip(x, y))],
                               ", ".join(f"{n} double" for n in names) + ", y double, t boolean").selectExpr(
        *names, "y", "cast(t as int) as s").repartition(4)
    train = np.arange(600) % 5 != 0
    fits = gram.ridge_sweep(df, names, "y", "s", gram.alpha_grid(spark, "logspace", 4, 0.0, 3.0)).collect()
    xt, xv = x[train], x[~train]
    for r in fits:
        c = xt - xt.mean(axis=0)
        beta = np.linalg.solve(c.T @ c + r["alpha"] * np.eye(20), c.T @ (y[train] - y[train].mean()))
        b0 = y[train].mean() - xt.mean(axis=0) @ beta
        assert np.allclose(r["coefs"], beta, rtol=1e-7) and r["intercept"] == pytest.approx(b0, rel=1e-7)
        assert r["val_rmse"] == pytest.approx(np.sqrt(np.mean((y[~train] - b0 - xv @ beta) ** 2)), rel=1e-7)
    got = {r["feature"]: r["vif"] for r in gram.vif(df, names).collect()}
    inverse = np.linalg.inv(np.corrcoef(x.T))
    assert [got[n] for n in names] == pytest.approx(list(np.diag(inverse)), rel=1e-6)
    with pytest.raises(ValueError):
        gram.ridge_sweep(df.where("s = 1"), names, "y", "s", gram.alpha_grid(spark, "arange", 2))
    assert gram.vif(df.limit(0), names).count() == 0


def test_logistic_gap_bounds_the_error(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 27)) * rng.uniform(.1, 3, 27)
    y = (x[:, 0] - x[:, 1] + rng.logistic(size=500) > 0).astype(float)
    w = rng.integers(1, 4, 500).astype(float)
    names = [f"f{i}" for i in range(27)]
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)],
                               ", ".join(f"{n} double" for n in names) + ", y double, w double").repartition(3)
    fit = classify.logistic_fit(df, names, "y", C=.5, weight="w").first()
    beta = np.zeros(28)
    design = np.column_stack([np.ones(500), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        g = .5 * design.T @ (w * (p - y)) + np.r_[0, beta[1:]]
        h = .5 * design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag([0] + [1] * 27)
        beta -= np.linalg.solve(h, g)
    assert [fit["intercept"], *fit["coefs"]] == pytest.approx(list(beta), abs=1e-9)
    assert 0 <= fit["gap"] < 1e-9 and fit["converged"]
