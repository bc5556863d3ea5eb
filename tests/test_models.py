import numpy as np
import pytest
from pyspark.sql import functions as F

from ratestat.operators import classify, derive, gram, modelprep

X = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
Y = [1.5, 1.8, 3.2, 3.9, 5.1, 6.3]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(i, x, y, 0) for i, (x, y) in enumerate(zip(X, Y))],
                                 "id long, x double, y double, split int")


@pytest.mark.parametrize("alpha,slope,icpt,rmse,r2", [
    (0.0, 0.9885714286, 0.1733333333, 0.2348927476, 0.9810106528),
    (1.0, 0.9351351351, 0.3603603604, 0.2519979413, 0.9781442959),
    (10.0, 0.6290909091, 1.4315151515, 0.6573313328, 0.8512902359),
])
def test_ridge_one_feature(spark, line, alpha, slope, icpt, rmse, r2):
    grid = spark.createDataFrame([(0, alpha)], "alpha_idx long, alpha double")
    r = gram.ridge_sweep(line, ["x"], "y", "split", grid).collect()[0]
    assert r["coefs"][0] == pytest.approx(slope, abs=1e-9)
    assert r["intercept"] == pytest.approx(icpt, abs=1e-9)
    assert r["train_rmse"] == pytest.approx(rmse, abs=1e-9)
    assert r["train_r2"] == pytest.approx(r2, abs=1e-9)


def test_ridge_large_alpha_shrinks(spark, line):
    grid = spark.createDataFrame([(0, 1e9)], "alpha_idx long, alpha double")
    r = gram.ridge_sweep(line, ["x"], "y", "split", grid).collect()[0]
    assert abs(r["coefs"][0]) < 1e-6


def test_ridge_matches_numpy_multifeature(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=300)
    split = (np.arange(300) % 5 == 0).astype(int)
    rows = [(i, *map(float, x[i]), float(y[i]), int(split[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, s int")
    grid = gram.alpha_grid(spark, "logspace", 5, 0.0, 3.0)
    got = {r["alpha_idx"]: r for r in gram.ridge_sweep(df, list("abcd"), "y", "s", grid).collect()}
    xt, yt = x[split == 0], y[split == 0]
    xv, yv = x[split == 1], y[split == 1]
    for k, alpha in enumerate(np.logspace(0, 3, 5)):
        xm, ym = xt.mean(0), yt.mean()
        beta = np.linalg.solve((xt - xm).T @ (xt - xm) + alpha * np.eye(4), (xt - xm).T @ (yt - ym))
        b0 = ym - xm @ beta
        pred = b0 + xv @ beta
        rmse = np.sqrt(np.mean((yv - pred) ** 2))
        r2 = 1 - np.sum((yv - pred) ** 2) / np.sum((yv - yv.mean()) ** 2)
        assert got[k]["alpha"] == pytest.approx(alpha, rel=1e-12)
        assert np.allclose(got[k]["coefs"], beta, atol=1e-9)
        assert got[k]["val_rmse"] == pytest.approx(rmse, abs=1e-9)
        assert got[k]["val_r2"] == pytest.approx(r2, abs=1e-9)


def test_vif_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    b = a + rng.normal(scale=0.5, size=200)
    c = rng.normal(loc=3, size=200)
    df = spark.createDataFrame([(float(a[i]), float(b[i]), float(c[i])) for i in range(200)], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in gram.vif(df, ["a", "b", "c"]).collect()}
    X = np.column_stack([np.ones(200), a, b, c])

    def vif(i):
        yi = X[:, i]
        xo = np.delete(X, i, axis=1)
        res = yi - xo @ np.linalg.lstsq(xo, yi, rcond=None)[0]
        tss = np.sum((yi - yi.mean()) ** 2) if i > 0 else np.sum(yi ** 2)
        return 1 / (np.sum(res ** 2) / tss)
    for i, name in enumerate(["Intercept", "a", "b", "c"]):
        assert got[name] == pytest.approx(vif(i), rel=1e-8)


def test_vif_identical_columns_no_raise(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "a double, b double")
    vals = [r["vif"] for r in gram.vif(df, ["a", "b"]).collect()]
    assert all(v is None or v > 1e6 or v != v for v in vals[1:])


def test_exact_split_size_and_invariance(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    a = modelprep.exact_split(df, "k", 11)
    b = modelprep.exact_split(df.repartition(7), "k", 11)
    ta = {r["k"] for r in a.filter("is_test = 1").collect()}
    tb = {r["k"] for r in b.filter("is_test = 1").collect()}
    assert len(ta) == 201  # ceil(0.2 * 1001)
    assert ta == tb
    assert a.count() == 1001


def test_standardize_population_sd_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 0), (3.0, 5.0, 0), (10.0, 5.0, 1)],
                               "x double, c double, is_test int")
    out = modelprep.standardize(df, ["x", "c"], F.col("is_test") == 0).orderBy("x").collect()
    sd = np.std([1.0, 2.0, 3.0])
    assert out[0]["x"] == pytest.approx((1 - 2) / sd)
    assert out[3]["x"] == pytest.approx((10 - 2) / sd)
    assert out[0]["c"] == 0.0  # zero variance -> scale 1


def test_logistic_matches_newton_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    p = 1 / (1 + np.exp(-(0.3 + x @ np.array([1.2, -0.7]))))
    y = (rng.uniform(size=400) < p).astype(int)
    df = spark.createDataFrame([(float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(400)],
                               "a double, b double, y int")
    fit = classify.logistic_fit(df, ["a", "b"], "y", C=1.0).collect()[0]
    beta = np.zeros(3)
    X = np.column_stack([np.ones(400), x])
    for _ in range(50):
        pr = 1 / (1 + np.exp(-X @ beta))
        g = X.T @ (pr - y) + np.r_[0, beta[1:]]
        H = X.T @ (X * (pr * (1 - pr))[:, None]) + np.diag([0, 1, 1])
        beta -= np.linalg.solve(H, g)
    assert fit["intercept"] == pytest.approx(beta[0], abs=1e-9)
    assert fit["coefs"] == pytest.approx(list(beta[1:]), abs=1e-9)
    assert fit["converged"]


def test_threshold_strict_default(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "p double")
    got = [r[0] for r in df.select(derive.threshold_labels("p", 0.5)).collect()]
    assert got == [0, 0, 1]
    got = [r[0] for r in df.select(derive.threshold_labels("p", 0.5, inclusive=True)).collect()]
    assert got == [0, 1, 1]


def test_exact_split_narrows_to_the_cut(spark, monkeypatch):
    df = spark.range(3001).selectExpr("case when id = 5 then null else id end as k")
    plain = modelprep.exact_split(df, "k", 3)
    monkeypatch.setattr(modelprep, "CUT_ROWS", 0)
    deep = modelprep.exact_split(df, "k", 3)
    assert plain.exceptAll(deep).count() == 0
    assert deep.where("is_test = 1").count() == 601
    assert modelprep.exact_split(df.limit(0), "k", 3).count() == 0


def test_unconverged_logistic_fit_is_an_error(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "a double, y int")
    with pytest.raises(RuntimeError):
        classify.logistic_fit(df, ["a"], "y", C=1e9, max_iter=5)
    with pytest.raises(ValueError):
        classify.logistic_fit(df.where("a > 5"), ["a"], "y")
