"""Linear models from one pass of moments.

Per split (train / validation) one Arrow pass of block accumulators
(:mod:`ratestat.operators.moments`) yields n, means and centred cross
products -- (p + 1)^2 numbers, independent of the row count, with no earlier
scan for the means.  Everything downstream (ridge solves for a whole alpha
grid, RMSE, R^2, VIF, coefficient tables) is p x p algebra, run inside Spark
tasks by ``mapInPandas`` over the small alpha / feature tables; no raw row
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ratestat.operators.common import col, with_one_row
from ratestat.operators.moments import complete_moments, unpack_moments
from ratestat.session import ship_package


def gram_table(df: DataFrame, features: Sequence[str], target: str, split_col: str | None = None) -> DataFrame:
    """(split, state): one row of moments of [features, target] per split
    value (0 = train), over the rows that have all of them.
    :func:`ratestat.operators.moments.unpack_moments` takes a state apart."""
    return complete_moments(df, [*features, target], split_col).withColumnRenamed("key", "split")


def ridge_solve(train_state, alpha: float):
    """Ridge with an unpenalised intercept from train moments: (b0, beta)."""
    _, mean, cross = unpack_moments(train_state)
    xx, xy = cross[:-1, :-1], cross[:-1, -1]
    a = xx + alpha * np.eye(len(xy))
    try:
        beta = np.linalg.solve(a, xy)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(a, xy, rcond=None)[0]
    return float(mean[-1] - mean[:-1] @ beta), beta


def fit_metrics(state, b0: float, beta):
    """RMSE and R^2 (against the set's own mean) of b0 + x.beta on a set."""
    n, mean, cross = unpack_moments(state)
    xx, xy, yy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    bias = mean[-1] - b0 - mean[:-1] @ beta
    sse = max(yy - 2 * beta @ xy + beta @ xx @ beta + n * bias * bias, 0.0)
    return float(np.sqrt(sse / n)), float(1 - sse / yy) if yy > 0 else float("nan")


SWEEP_SCHEMA = StructType([
    StructField("alpha_idx", LongType()), StructField("alpha", DoubleType()),
    StructField("train_rmse", DoubleType()), StructField("val_rmse", DoubleType()),
    StructField("train_r2", DoubleType()), StructField("val_r2", DoubleType()),
    StructField("intercept", DoubleType()), StructField("coefs", ArrayType(DoubleType())),
])


def _sweep_fn(train, val):
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                b0, beta = ridge_solve(train, float(r.alpha))
                tr = fit_metrics(train, b0, beta)
                va = fit_metrics(val, b0, beta) if val is not None else (float("nan"), float("nan"))
                rows.append((int(r.alpha_idx), float(r.alpha), tr[0], va[0], tr[1], va[1], b0, [float(b) for b in beta]))
            yield pd.DataFrame(rows, columns=[f.name for f in SWEEP_SCHEMA.fields])
    return run


def alpha_grid(spark: SparkSession, kind: str, num: int, start: float = 0.0,
               stop: float = 1.0) -> DataFrame:
    """``(alpha_idx, alpha)``: 'arange' gives start + i (step 1); 'logspace'
    gives 10 ** (start + i * (stop - start) / (num - 1))."""
    ids = spark.range(num).withColumnRenamed("id", "alpha_idx")
    if kind == "arange":
        a = F.lit(float(start)) + F.col("alpha_idx").cast("double")
    elif kind == "logspace":
        step = (stop - start) / (num - 1)
        e = F.when(F.col("alpha_idx") == num - 1, F.lit(float(stop))).otherwise(
            F.col("alpha_idx").cast("double") * F.lit(step) + F.lit(float(start)))
        a = F.pow(F.lit(10.0), e)
    else:
        raise ValueError(kind)
    return ids.select("alpha_idx", a.alias("alpha"))


def ridge_sweep(df: DataFrame, features: Sequence[str], target: str, split_col: str,
                alphas: DataFrame) -> DataFrame:
    """Ridge fit for every alpha of ``alphas`` (``alpha_idx``, ``alpha``)
    from ONE pass of train/validation moments.  Columns: alpha_idx, alpha,
    train/val RMSE and R^2, intercept, coefs (feature order).  Rows with a
    null in any column are left out; without a train row there is no fit and
    ``ValueError`` is raised; without a validation row its metrics are NaN."""
    # two states of (p + 1)^2 numbers reach the driver and ride in the closure
    found = gram_table(df, features, target, split_col).where("split in (0, 1)").toArrow()
    states = dict(zip(found.column("split").to_pylist(), found.column("state").to_pylist()))
    if 0 not in states:
        raise ValueError("no complete train row to fit")
    ship_package(df.sparkSession)
    return alphas.select("alpha_idx", "alpha").mapInPandas(_sweep_fn(states[0], states.get(1)), SWEEP_SCHEMA)


def best_alpha(sweep: DataFrame) -> DataFrame:
    """Row of the lowest validation RMSE; the first alpha wins ties."""
    return sweep.agg(F.min_by(F.struct(*[F.col(c) for c in sweep.columns]),
                              F.struct(F.col("val_rmse"), F.col("alpha_idx"))).alias("_b")
                     ).select("_b.*")


def coefficient_table(fit: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long (term, coef) table from a sweep/fit row (intercept first)."""
    terms = [F.struct(F.lit("Intercept").alias("term"), F.col("intercept").alias("coef"))]
    terms += [F.struct(F.lit(f).alias("term"), F.col("coefs")[i].alias("coef"))
              for i, f in enumerate(features)]
    return fit.select(F.explode(F.array(*terms)).alias("_t")).select("_t.*")


def strongest_predictor(fit: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature with the largest |coef| (first on ties): (feature, coef)."""
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                      F.col("coefs")[i].alias("coef")) for i, f in enumerate(features)]
    long = fit.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return long.agg(F.max_by(F.struct("feature", "coef"),
                             F.struct(F.abs("coef"), -F.col("pos"))).alias("_s")).select("_s.*")


def predict(df: DataFrame, fit: DataFrame, features: Sequence[str], out: str = "y_hat") -> DataFrame:
    """b0 + sum(beta_i * x_i) with the one-row fit attached by broadcast."""
    joined = with_one_row(df, fit.select("intercept", "coefs"))
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefs")[i] * col(f)
    return joined.select(*[col(c) for c in df.columns], pred.alias(out))


def regression_metrics(pred: DataFrame, y: str, y_hat: str, by: str | None = None) -> DataFrame:
    """RMSE and R^2 = 1 - SSE/SST (per ``by`` group)."""
    keys = [col(by)] if by else []
    e = col(y) - col(y_hat)
    s = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"),
                               F.var_pop(col(y)).alias("_vp"))
    return s.select(*keys, "n", F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))).alias("rmse"),
                    (1 - F.try_divide(F.col("_sse"), F.col("_vp") * F.col("n"))).alias("r2"))


VIF_SCHEMA = StructType([StructField("feature", StringType()), StructField("vif", DoubleType())])


SINGULAR = 1e-10  # share of a column's own variance that counts as none left


def inflation(cmat, mu, n):
    """(factor of each feature, factor of the intercept) from centred cross
    products, means and row count.  A column that the others determine (to
    ``SINGULAR`` of its variance) gets inf; a constant feature is the
    intercept again, and both get inf."""
    p = len(mu)
    size = np.sqrt(np.diag(cmat) / max(n, 1) + mu * mu)
    spread = np.sqrt(np.maximum(np.diag(cmat) / max(n, 1), 0))
    constant = spread <= 1e-9 * np.maximum(size, 1e-300)
    scale = np.where(constant, 1.0, spread * np.sqrt(max(n, 1)))
    corr = cmat / np.outer(scale, scale)

    def left_over(i, others):
        if not others:
            return 1.0
        c = corr[others, i]
        return float(1 - c @ np.linalg.pinv(corr[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ c)

    live = [i for i in range(p) if not constant[i]]
    factors = [float("inf")] * p
    for i in live:
        rest = left_over(i, [j for j in live if j != i])
        factors[i] = 1 / rest if rest > SINGULAR else float("inf")
    if any(constant[i] and size[i] > 0 for i in range(p)):
        return factors, float("inf")
    m = mu[live] / scale[live]
    inverse = np.linalg.pinv(corr[np.ix_(live, live)], rcond=1e-12, hermitian=True) if live else np.zeros((0, 0))
    return factors, float(1 + n * m @ inverse @ m)


def vif(df: DataFrame, features: Sequence[str], intercept_name: str = "Intercept") -> DataFrame:
    """Variance inflation factors of [Intercept, features] (least-squares
    definition): features from the inverse correlation matrix, the intercept
    as 1 + n * mu' C^-1 mu (uncentred R^2).  Singular designs give inf; a
    table without a complete row gives no row."""
    feats = list(features)

    def run(batches):
        for pdf in batches:
            out = []
            for state in pdf["state"]:
                n, mu, cmat = unpack_moments(state)
                vi, v0 = inflation(cmat, mu, n)
                out += [(intercept_name, v0), *zip(feats, vi)]
            yield pd.DataFrame(out, columns=["feature", "vif"])
    ship_package(df.sparkSession)
    return complete_moments(df, feats).mapInPandas(run, VIF_SCHEMA)
