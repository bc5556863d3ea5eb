"""The regressions, the classification and the correlations at their full
width -- 7 numeric columns, 20 tags, 27 features -- with DuckDB oracles that
solve the same systems by Gauss-Jordan elimination in SQL.

The 20 tags of a part are the shares of its line items with a line number, a
supplier class or a return flag (``WIDE_TAGS``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratestat.functions.constants import SEED
from ratestat.operators import classify, describe, gram, modelprep
from ratestat.plans import profiles as P
from ratestat.plans.common import sql_round
from ratestat.plans.q_clean import adjusted_profile, adjusted_sql, profile_inputs
from ratestat.plans.q_models import LOG_ALPHAS, N_ALPHAS, SWEEP_ALPHAS, TARGET, _h
from ratestat.session import shared_table
from ratestat.sources.tables import read_table

NUMERIC_7 = ["difficulty_adj", P.N, P.AGAIN, P.ONLINE, P.PEPPER, P.FLAG_A, P.FLAG_B]
_CONDITIONS = ([f"l_linenumber = {i}" for i in range(1, 7)] + [f"l_suppkey % 13 = {i}" for i in range(1, 13)]
               + ["l_returnflag = 'R'", "l_returnflag = 'A'"])
WIDE_TAGS = [f"w{i + 1:02d}" for i in range(len(_CONDITIONS))]
LOGIT_27 = [TARGET, "difficulty_adj", P.N, P.AGAIN, P.ONLINE, P.FLAG_A, P.FLAG_B, *WIDE_TAGS]
CORR_27 = [*NUMERIC_7, *WIDE_TAGS]
STEPS = 12            # Newton steps of the oracle


# ------------------------------------------------------------ Spark plans
def wide_profile(spark, d, also_require=()):
    """The adjusted profile with the shares of ``WIDE_TAGS``."""
    def build():
        li = read_table(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag")
        shares = li.groupBy("l_partkey").agg(
            *[F.try_divide(F.count_if(F.expr(c)), F.count(F.lit(1))).alias(t) for t, c in zip(WIDE_TAGS, _CONDITIONS)])
        a = adjusted_profile(spark, d, also_require).select(P.KEY, TARGET, *NUMERIC_7)
        return a.join(shares, a[P.KEY] == shares["l_partkey"]).drop("l_partkey")
    return shared_table(spark, ("wide_profile", d, tuple(also_require)), build, profile_inputs(d))


def split_frame(spark, d, features):
    """Split and train-scaled model frame of ``features``."""
    def build():
        rows = wide_profile(spark, d, [P.AGAIN]).select(P.KEY, TARGET, *features)
        return modelprep.standardize(modelprep.exact_split(rows, P.KEY, SEED), features, F.col("is_test") == 0)
    return shared_table(spark, ("wide_frame", d, tuple(features)), build, profile_inputs(d))


def _sweep_columns(sweep, features):
    return sweep.select("alpha_idx", "alpha", "train_rmse", "val_rmse", "train_r2", "val_r2", "intercept",
                        *[F.col("coefs")[i].alias(f"b_{f}") for i, f in enumerate(features)])


def q_corr_27(spark, d):
    return describe.corr_matrix(wide_profile(spark, d), CORR_27)


def q_vif_7(spark, d):
    return gram.vif(wide_profile(spark, d, [P.AGAIN]), NUMERIC_7)


def q_ridge_7(spark, d):
    grid = gram.alpha_grid(spark, "arange", N_ALPHAS, 0.0)
    return _sweep_columns(gram.ridge_sweep(split_frame(spark, d, NUMERIC_7), NUMERIC_7, TARGET, "is_test", grid), NUMERIC_7)


def q_ridge_20(spark, d):
    grid = gram.alpha_grid(spark, "arange", N_ALPHAS, 0.0)
    return _sweep_columns(gram.ridge_sweep(split_frame(spark, d, WIDE_TAGS), WIDE_TAGS, TARGET, "is_test", grid), WIDE_TAGS)


def q_ridge_20_log(spark, d):
    grid = gram.alpha_grid(spark, "logspace", 200, 0.0, 3.0)
    return _sweep_columns(gram.ridge_sweep(split_frame(spark, d, WIDE_TAGS), WIDE_TAGS, TARGET, "is_test", grid), WIDE_TAGS)


def q_logit_27(spark, d):
    """The classifier of all features, scaled, fitted on the train rows."""
    rows = wide_profile(spark, d, [P.AGAIN]).select(P.KEY, P.PEPPER, *LOGIT_27)
    frame = modelprep.standardize(modelprep.exact_split(rows, P.KEY, SEED), LOGIT_27, F.col("is_test") == 0)
    fit = classify.logistic_fit(frame.where("is_test = 0"), LOGIT_27, P.PEPPER)
    return gram.coefficient_table(fit, LOGIT_27)


QUERIES = {
    "corr_27": q_corr_27,
    "vif_7": q_vif_7,
    "ridge_7": q_ridge_7,
    "ridge_20": q_ridge_20,
    "ridge_20_log": q_ridge_20_log,
    "logit_27": q_logit_27,
}


# ------------------------------------------------------------ SQL oracles
def solved(matrix: str, p: int, width: int) -> str:
    """Gauss-Jordan elimination of a row-major p x ``width`` matrix (a list):
    afterwards the columns past p hold the solutions."""
    pivots = ", ".join(f"[CAST({k} AS DOUBLE)]" for k in range(p))
    row, column = f"(t // {width})", f"(t % {width})"
    at = "CAST(k[1] AS BIGINT)"
    cell = (f"CASE WHEN {row} = {at} THEN m[t + 1] / m[{at} * {width} + {at} + 1] ELSE m[t + 1] - m[{row} * {width} + {at} + 1] "
            f"* m[{at} * {width} + {column} + 1] / m[{at} * {width} + {at} + 1] END")
    return f"list_reduce([{pivots}], lambda m, k: list_transform(range({p * width}), lambda t: {cell}), {matrix})"


def wide_sql(also_require=()) -> str:
    shares = ", ".join(f"count(*) FILTER (WHERE {c}) / count(*) AS {t}" for t, c in zip(WIDE_TAGS, _CONDITIONS))
    return f"""(SELECT a.*, s.* EXCLUDE (l_partkey) FROM {adjusted_sql(also_require)} a
   JOIN (SELECT l_partkey, {shares} FROM lineitem GROUP BY l_partkey) s ON a.p_partkey = s.l_partkey)"""


def scaled_cte(features, target) -> str:
    """z(p_partkey, is_test, y, x): split, train-scaled feature lists."""
    xs = ", ".join(features)
    scaled = ", ".join(f"(sp.{f} - sc.m{i}) / sc.s{i}" for i, f in enumerate(features))
    stats = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s{i}"
                      for i, f in enumerate(features))
    return f"""wide AS MATERIALIZED {wide_sql([P.AGAIN])},
 hh AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) - 1 AS rk
        FROM (SELECT p_partkey, {target} AS target, {xs}, {_h(f"'{SEED}:' || CAST(p_partkey AS VARCHAR)")} AS h FROM wide) _x),
 sp AS (SELECT *, CAST(rk < (SELECT ceil(CAST(0.2 AS DOUBLE) * count(*)) FROM wide) AS INTEGER) AS is_test FROM hh),
 sc AS (SELECT {stats} FROM sp WHERE is_test = 0),
 z AS MATERIALIZED (SELECT p_partkey, is_test, CAST(target AS DOUBLE) AS y, [{scaled}] AS x FROM sp, sc)"""


def ridge_wide_sql(features, alphas) -> str:
    p = len(features)
    pairs = f"range(1, {p + 1}) ri(i), range(1, {p + 2}) rj(j)"
    coefs = ", ".join(f"beta[{i + 1}] AS b_{f}" for i, f in enumerate(features))
    return f"""WITH {scaled_cte(features, TARGET)},
 mu AS (SELECT avg(y) AS my, {", ".join(f"avg(x[{i + 1}]) AS m{i}" for i in range(p))} FROM z WHERE is_test = 0),
 mx AS (SELECT my, [{", ".join(f"m{i}" for i in range(p))}] AS m FROM mu),
 c AS (SELECT i, j, sum((z.x[i] - mx.m[i]) * CASE WHEN j = {p + 1} THEN z.y - mx.my ELSE z.x[j] - mx.m[j] END) AS v
       FROM z, mx, {pairs} WHERE is_test = 0 GROUP BY i, j),
 sys AS (SELECT alpha_idx, alpha, list(v + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY i, j) AS a
         FROM c, ({alphas}) _a GROUP BY alpha_idx, alpha),
 done AS MATERIALIZED (SELECT alpha_idx, alpha, {solved("a", p, p + 1)} AS r FROM sys),
 fit AS MATERIALIZED (SELECT alpha_idx, alpha, beta, my - list_dot_product(beta, m) AS b0 FROM
   (SELECT alpha_idx, alpha, list_transform(range({p}), lambda i: r[i * {p + 1} + {p + 1}]) AS beta FROM done), mx),
 e AS (SELECT alpha_idx, is_test, y, y - b0 - list_dot_product(beta, x) AS e FROM fit, z),
 met AS (SELECT alpha_idx, is_test, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2
         FROM e GROUP BY alpha_idx, is_test)
SELECT fit.alpha_idx, alpha, max(rmse) FILTER (WHERE is_test = 0) AS train_rmse, max(rmse) FILTER (WHERE is_test = 1) AS val_rmse,
  max(r2) FILTER (WHERE is_test = 0) AS train_r2, max(r2) FILTER (WHERE is_test = 1) AS val_r2, b0 AS intercept, {coefs}
FROM fit JOIN met ON fit.alpha_idx = met.alpha_idx GROUP BY ALL"""


def vif_wide_sql(features) -> str:
    p = len(features)
    xs = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    named = ", ".join(f"'{f}'" for f in features)
    return f"""WITH z AS (SELECT [{xs}] AS x FROM {wide_sql([P.AGAIN])} _w),
 s AS (SELECT count(*) AS n, [{", ".join(f"avg(x[{i + 1}])" for i in range(p))}] AS m FROM z),
 c AS (SELECT i, j, sum((x[i] - m[i]) * (x[j] - m[j])) AS v FROM z, s, range(1, {p + 1}) ri(i), range(1, {p + 1}) rj(j) GROUP BY i, j),
 a AS (SELECT list(v ORDER BY i, j) AS a FROM (SELECT i, j, v FROM c UNION ALL
        SELECT i, j + {p}, CAST(i = j AS DOUBLE) FROM c) _u),
 inv AS MATERIALIZED (SELECT {solved("a", p, 2 * p)} AS r FROM a),
 q AS (SELECT sum(m[i] * r[(i - 1) * {2 * p} + {p} + j] * m[j]) AS v FROM inv, s, range(1, {p + 1}) ri(i), range(1, {p + 1}) rj(j))
SELECT 'Intercept' AS feature, 1 + n * v AS vif FROM s, q
UNION ALL SELECT [{named}][i], r[(i - 1) * {2 * p} + {p} + i] * v FROM inv, c WHERE i = j"""


def corr_wide_sql(cols) -> str:
    table = "w"
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS col, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {table}"
        for a in cols for b in cols)
    return f"WITH {table} AS MATERIALIZED {wide_sql()} {cells}"


def logit_wide_sql(features, label) -> str:
    """Unrolled Newton steps; each solves its system in SQL."""
    p = len(features) + 1
    steps = [f"s0 AS (SELECT list_transform(range({p}), lambda i: CAST(0 AS DOUBLE)) AS beta)"]
    for k in range(1, STEPS + 1):
        steps.append(f""" g{k} AS (SELECT i, j, sum(CASE WHEN j = {p + 1} THEN r * d[i] ELSE h * d[i] * d[j] END)
     + max(CASE WHEN i > 1 AND j = {p + 1} THEN beta[i] WHEN i > 1 AND i = j THEN 1 ELSE 0 END) AS v
   FROM (SELECT d, beta, pr - y AS r, pr * (1 - pr) AS h FROM
     (SELECT d, beta, y, 1 / (1 + exp(-list_dot_product(d, beta))) AS pr FROM t, s{k - 1}) _p) _h,
     range(1, {p + 1}) ri(i), range(1, {p + 2}) rj(j) GROUP BY i, j),
 s{k} AS MATERIALIZED (SELECT list_transform(range({p}), lambda i: beta[i + 1] - r[i * {p + 1} + {p + 1}]) AS beta FROM
   (SELECT {solved("a", p, p + 1)} AS r FROM (SELECT list(v ORDER BY i, j) AS a FROM g{k}) _l) _s, s{k - 1})""")
    named = ", ".join(f"'{f}'" for f in ["Intercept", *features])
    return f"""WITH {scaled_cte(features, label)},
 t AS MATERIALIZED (SELECT y, list_concat([CAST(1 AS DOUBLE)], x) AS d FROM z WHERE is_test = 0),
 {", ".join(steps)}
SELECT [{named}][i] AS term, beta[i] AS coef FROM s{STEPS}, range(1, {p + 1}) ri(i)"""


_FITTED = ["alpha", "train_rmse", "val_rmse", "train_r2", "val_r2", "intercept"]

SQL = {
    "corr_27": sql_round(corr_wide_sql(CORR_27), ["r"]),
    "vif_7": sql_round(vif_wide_sql(NUMERIC_7), ["vif"]),
    "ridge_7": sql_round(ridge_wide_sql(NUMERIC_7, SWEEP_ALPHAS), [*_FITTED, *[f"b_{f}" for f in NUMERIC_7]]),
    "ridge_20": sql_round(ridge_wide_sql(WIDE_TAGS, SWEEP_ALPHAS), [*_FITTED, *[f"b_{f}" for f in WIDE_TAGS]]),
    "ridge_20_log": sql_round(ridge_wide_sql(WIDE_TAGS, LOG_ALPHAS), [*_FITTED, *[f"b_{f}" for f in WIDE_TAGS]]),
    "logit_27": sql_round(logit_wide_sql(LOGIT_27, P.PEPPER), ["coef"]),
}
