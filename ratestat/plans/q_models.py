"""Driver queries for the regression and classification questions, with
DuckDB oracles (two features: every solve is a 2 x 2 closed form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratestat.functions.constants import SEED
from ratestat.operators import classify, gram, modelprep
from ratestat.plans import profiles as P
from ratestat.plans.common import sql_round
from ratestat.plans.q_clean import profile_inputs, adjusted_profile, adjusted_sql
from ratestat.session import materialize, shared_table
from ratestat.sources.tables import read_table
from ratestat.operators.common import with_one_row

FEATURES = ["difficulty_adj", "again"]
TARGET = "rating_adj"
FIXED_ALPHA = 10.0
N_ALPHAS = 100
LOGIT_STEPS = 12


# ------------------------------------------------------------ Spark plans
def reg_frame(spark, d):
    a = adjusted_profile(spark, d, also_require=[P.AGAIN])
    return modelprep.exact_split(a.select(P.KEY, TARGET, *FEATURES), P.KEY, SEED)


def scaled_frame(spark, d):
    """Split + train-scaled model frame, materialised: the Gram pass, the
    means and the predictions all read it."""
    return shared_table(spark, ("model_frame", d), lambda: modelprep.standardize(
        reg_frame(spark, d), FEATURES, F.col("is_test") == 0), profile_inputs(d))


def sweep(spark, d, n_alphas=N_ALPHAS):
    grid = gram.alpha_grid(spark, "arange", n_alphas, 0.0)
    return gram.ridge_sweep(scaled_frame(spark, d), FEATURES, TARGET, "is_test", grid)


def fixed_fit(spark, d):
    grid = spark.range(1).select(F.lit(0).cast("long").alias("alpha_idx"),
                                 F.lit(FIXED_ALPHA).alias("alpha"))
    return gram.ridge_sweep(scaled_frame(spark, d), FEATURES, TARGET, "is_test", grid)


def q_split_exact(spark, d):
    return reg_frame(spark, d).select(P.KEY, "is_test")


def q_standardize(spark, d):
    return scaled_frame(spark, d).select(P.KEY, "is_test", *FEATURES)


def q_vif(spark, d):
    return gram.vif(adjusted_profile(spark, d, also_require=[P.AGAIN]), FEATURES)


def q_ridge_2f(spark, d):
    return gram.coefficient_table(fixed_fit(spark, d), FEATURES)


def q_ridge_sweep(spark, d):
    return sweep(spark, d).select("alpha", "train_rmse", "val_rmse", "train_r2", "val_r2")


def q_argbest(spark, d):
    return gram.best_alpha(sweep(spark, d)).select("alpha_idx", "alpha", "val_rmse")


def q_strongest_predictor(spark, d):
    return gram.strongest_predictor(gram.best_alpha(sweep(spark, d)), FEATURES)


def q_ridge_predict(spark, d):
    val = scaled_frame(spark, d).filter(F.col("is_test") == 1)
    return gram.predict(val, fixed_fit(spark, d), FEATURES).select(P.KEY, TARGET, "y_hat")


def q_reg_metrics(spark, d):
    pred = gram.predict(scaled_frame(spark, d), fixed_fit(spark, d), FEATURES)
    m = gram.regression_metrics(pred, TARGET, "y_hat", by="is_test")
    return m.select(F.when(F.col("is_test") == 1, "val").otherwise("train").alias("split"),
                    "n", "rmse", "r2")


def _scored(spark, d):
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


def _logit_fit(spark, d):
    li = read_table(spark, d, "lineitem", "l_quantity", "l_returnflag")
    z = modelprep.standardize(li, ["l_quantity"])
    # identical (x, y) rows collapse to one weighted row before the Newton loop
    collapsed = z.groupBy(F.col("l_quantity").alias("x"),
                          (F.col("l_returnflag") == "R").cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("w"))
    return classify.logistic_fit(collapsed, ["x"], "y", C=1.0, weight="w")


def q_logit_1f(spark, d):
    return _logit_fit(spark, d).select(F.col("intercept"), F.col("coefs")[0].alias("coef_x"))


def q_logit_predict(spark, d):
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    z = modelprep.standardize(li, ["l_quantity"]).withColumnRenamed("l_quantity", "x")
    scored = classify.logistic_proba(z, _logit_fit(spark, d), ["x"])
    from ratestat.operators.derive import threshold_labels
    return scored.select("l_orderkey", "l_linenumber", "proba",
                         threshold_labels(F.col("proba"), 0.5).alias("pred"))


def q_ridge_sweep_log(spark, d):
    grid = gram.alpha_grid(spark, "logspace", 200, 0.0, 3.0)
    sw = gram.ridge_sweep(scaled_frame(spark, d), FEATURES, TARGET, "is_test", grid)
    return sw.select("alpha", "train_rmse", "val_rmse", "train_r2", "val_r2")


def q_threshold_labels(spark, d):
    from ratestat.operators.derive import threshold_labels
    s = _scored(spark, d)
    return s.select("l_orderkey", "l_linenumber", "score", "label",
                    threshold_labels(F.col("score"), 0.5).alias("pred"))


def q_roc_points(spark, d):
    return classify.roc_points(_scored(spark, d), "score", "label")


def q_roc_auc(spark, d):
    return classify.roc_auc(_scored(spark, d), "score", "label")


def q_youden(spark, d):
    return classify.youden(classify.roc_points(_scored(spark, d), "score", "label"))


def _confusion(spark, d):
    counts = materialize(classify.score_counts(_scored(spark, d), "score", "label"))
    best = classify.youden(classify.roc_points_from(counts)).select(
        F.coalesce(F.col("threshold"), F.lit(float("inf"))).alias("_t"))
    return classify.confusion_at(with_one_row(counts, best), F.col("_t"))


def q_confusion(spark, d):
    return _confusion(spark, d)


def q_class_report(spark, d):
    return classify.class_report(_confusion(spark, d))


QUERIES = {
    "split_exact": q_split_exact,
    "standardize": q_standardize,
    "vif": q_vif,
    "ridge_2f": q_ridge_2f,
    "ridge_sweep": q_ridge_sweep,
    "argbest": q_argbest,
    "strongest_predictor": q_strongest_predictor,
    "ridge_predict": q_ridge_predict,
    "reg_metrics": q_reg_metrics,
    "logit_1f": q_logit_1f,
    "logit_predict": q_logit_predict,
    "ridge_sweep_log": q_ridge_sweep_log,
    "threshold_labels": q_threshold_labels,
    "roc_points": q_roc_points,
    "roc_auc": q_roc_auc,
    "youden": q_youden,
    "confusion": q_confusion,
    "class_report": q_class_report,
}


# ------------------------------------------------------------ SQL oracles
def _h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


REG_CTE = f"""reg AS (SELECT p_partkey, rating_adj AS y, difficulty_adj AS x1, again AS x2
              FROM {adjusted_sql(["again"])} _a),
 hh AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) - 1 AS rk
        FROM (SELECT *, {_h(f"'{SEED}:' || CAST(p_partkey AS VARCHAR)")} AS h FROM reg) _x),
 sp AS (SELECT p_partkey, y, x1, x2,
          CAST(rk < (SELECT ceil(CAST(0.2 AS DOUBLE) * count(*)) FROM reg) AS INTEGER) AS is_test FROM hh),
 sc AS (SELECT avg(x1) AS m1, CASE WHEN stddev_pop(x1) = 0 THEN 1 ELSE stddev_pop(x1) END AS s1,
               avg(x2) AS m2, CASE WHEN stddev_pop(x2) = 0 THEN 1 ELSE stddev_pop(x2) END AS s2
        FROM sp WHERE is_test = 0),
 z AS (SELECT p_partkey, is_test, y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM sp, sc),
 tr AS (SELECT count(*) AS n, avg(z1) AS mz1, avg(z2) AS mz2, avg(y) AS my,
          covar_pop(z1, z1) * count(*) AS c11, covar_pop(z2, z2) * count(*) AS c22,
          covar_pop(z1, z2) * count(*) AS c12, covar_pop(z1, y) * count(*) AS c1y,
          covar_pop(z2, y) * count(*) AS c2y FROM z WHERE is_test = 0)"""


def fit_cte(alphas: str) -> str:
    return f"""fit AS (SELECT alpha_idx, alpha, b1, b2, my - b1 * mz1 - b2 * mz2 AS b0 FROM (
   SELECT a.alpha_idx, a.alpha, tr.my, tr.mz1, tr.mz2,
     ((tr.c22 + a.alpha) * tr.c1y - tr.c12 * tr.c2y) / ((tr.c11 + a.alpha) * (tr.c22 + a.alpha) - tr.c12 * tr.c12) AS b1,
     ((tr.c11 + a.alpha) * tr.c2y - tr.c12 * tr.c1y) / ((tr.c11 + a.alpha) * (tr.c22 + a.alpha) - tr.c12 * tr.c12) AS b2
   FROM ({alphas}) a, tr) _f)"""


SWEEP_ALPHAS = f"SELECT i AS alpha_idx, CAST(i AS DOUBLE) AS alpha FROM range({N_ALPHAS}) r(i)"
FIXED_ALPHAS = f"SELECT 0 AS alpha_idx, CAST({FIXED_ALPHA} AS DOUBLE) AS alpha"

METRICS_CTE = """met AS (SELECT fit.alpha_idx, fit.alpha, z.is_test,
    sqrt(avg((z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)) * (z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)))) AS rmse,
    1 - sum((z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)) * (z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)))
        / (var_pop(z.y) * count(*)) AS r2
  FROM fit, z GROUP BY fit.alpha_idx, fit.alpha, z.is_test),
 sw AS (SELECT alpha_idx, alpha,
    max(rmse) FILTER (WHERE is_test = 0) AS train_rmse, max(rmse) FILTER (WHERE is_test = 1) AS val_rmse,
    max(r2) FILTER (WHERE is_test = 0) AS train_r2, max(r2) FILTER (WHERE is_test = 1) AS val_r2
  FROM met GROUP BY alpha_idx, alpha)"""

BEST = "(SELECT * FROM sw ORDER BY val_rmse, alpha_idx LIMIT 1)"


def vif_sql() -> str:
    return f"""WITH r AS (SELECT difficulty_adj AS x1, again AS x2 FROM {adjusted_sql(["again"])} _a
            WHERE difficulty_adj IS NOT NULL AND again IS NOT NULL),
 s AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) * count(*) AS c11,
         covar_pop(x2, x2) * count(*) AS c22, covar_pop(x1, x2) * count(*) AS c12 FROM r),
 v AS (SELECT *, c11 * c22 - c12 * c12 AS det FROM s)
SELECT 'Intercept' AS feature,
  1 + n * (m1 * m1 * c22 - 2 * m1 * m2 * c12 + m2 * m2 * c11) / det AS vif FROM v
UNION ALL SELECT 'difficulty_adj', c22 / det * c11 FROM v
UNION ALL SELECT 'again', c11 / det * c22 FROM v"""


LOG_ALPHAS = ("SELECT i AS alpha_idx, CASE WHEN i = 199 THEN pow(10, CAST(3 AS DOUBLE)) "
              f"ELSE pow(10, i * {3.0 / 199!r} + CAST(0 AS DOUBLE)) END AS alpha FROM range(200) r(i)")


def logit_sql(final: str | None = None) -> str:
    steps = ["s0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]
    for k in range(1, LOGIT_STEPS + 1):
        prev = f"s{k - 1}"
        steps.append(f"""g{k} AS (SELECT {prev}.a, {prev}.b,
      sum(c.w * (1 / (1 + exp(-({prev}.a + {prev}.b * c.x))) - c.y)) AS g0,
      sum(c.w * (1 / (1 + exp(-({prev}.a + {prev}.b * c.x))) - c.y) * c.x) + {prev}.b AS g1,
      sum(c.w * (1 / (1 + exp(-({prev}.a + {prev}.b * c.x)))) * (1 - 1 / (1 + exp(-({prev}.a + {prev}.b * c.x))))) AS h00,
      sum(c.w * (1 / (1 + exp(-({prev}.a + {prev}.b * c.x)))) * (1 - 1 / (1 + exp(-({prev}.a + {prev}.b * c.x)))) * c.x) AS h01,
      sum(c.w * (1 / (1 + exp(-({prev}.a + {prev}.b * c.x)))) * (1 - 1 / (1 + exp(-({prev}.a + {prev}.b * c.x)))) * c.x * c.x) + 1 AS h11
    FROM c, {prev} GROUP BY {prev}.a, {prev}.b),
 s{k} AS (SELECT a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
                 b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM g{k})""")
    return f"""WITH st AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem),
 c AS (SELECT (l_quantity - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS x,
         CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(count(*) AS DOUBLE) AS w
       FROM lineitem, st GROUP BY 1, 2),
 {", ".join(steps)}
{final or f"SELECT a AS intercept, b AS coef_x FROM s{LOGIT_STEPS}"}"""


SCORED = """(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score,
   CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""

ROC_CTE = f"""c AS (SELECT score AS v, count(*) FILTER (WHERE label = 1) AS pos,
                 count(*) FILTER (WHERE label = 0) AS neg FROM {SCORED} _s WHERE score IS NOT NULL GROUP BY score),
 cu AS (SELECT *, sum(pos) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
          sum(neg) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
          lead(pos) OVER (ORDER BY v DESC) AS npos, lead(neg) OVER (ORDER BY v DESC) AS nneg,
          row_number() OVER (ORDER BY v DESC) AS rn FROM c),
 tot AS (SELECT sum(pos) AS pp, sum(neg) AS nn FROM c),
 pts AS (SELECT v AS threshold, CAST(fps AS BIGINT) AS fps, CAST(tps AS BIGINT) AS tps,
            fps / nn AS fpr, tps / pp AS tpr FROM cu, tot
          WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
          UNION ALL SELECT NULL, 0, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)),
 yj AS (SELECT threshold, tpr - fpr AS j, tpr, fpr FROM pts
        ORDER BY tpr - fpr DESC, coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1),
 cf AS (SELECT s.label AS actual, CAST(s.score > coalesce(yj.threshold, 'inf'::DOUBLE) AS INTEGER) AS predicted
        FROM {SCORED} s, yj),
 cm AS (SELECT a.actual, b.predicted, (SELECT count(*) FROM cf WHERE cf.actual = a.actual
          AND cf.predicted = b.predicted) AS count
        FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted))"""


def _report_sql() -> str:
    return f"""WITH {ROC_CTE},
 m AS (SELECT CAST(sum(count) FILTER (WHERE actual = 0 AND predicted = 0) AS DOUBLE) AS tn,
              CAST(sum(count) FILTER (WHERE actual = 0 AND predicted = 1) AS DOUBLE) AS fp,
              CAST(sum(count) FILTER (WHERE actual = 1 AND predicted = 0) AS DOUBLE) AS fn,
              CAST(sum(count) FILTER (WHERE actual = 1 AND predicted = 1) AS DOUBLE) AS tp FROM cm),
 k AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1,
          CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
          CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
          CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0 FROM m),
 f AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
          CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
          tp + fn AS s1, tn + fp AS s0 FROM k)
SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (s0 + s1), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
  (f0 * s0 + f1 * s1) / (s0 + s1), CAST(s0 + s1 AS BIGINT) FROM f"""


_SW = ["alpha", "train_rmse", "val_rmse", "train_r2", "val_r2"]

SQL = {
    "split_exact": f"WITH {REG_CTE} SELECT p_partkey, is_test FROM sp",
    "standardize": sql_round(f"WITH {REG_CTE} SELECT p_partkey, is_test, z1 AS difficulty_adj, z2 AS again FROM z",
                             ["difficulty_adj", "again"]),
    "vif": sql_round(vif_sql(), ["vif"]),
    "ridge_2f": sql_round(f"""WITH {REG_CTE}, {fit_cte(FIXED_ALPHAS)},
 orig AS (SELECT fit.*, sc.* FROM fit, sc)
SELECT 'Intercept' AS term, b0 AS coef FROM orig
UNION ALL SELECT 'difficulty_adj', b1 FROM orig UNION ALL SELECT 'again', b2 FROM orig""", ["coef"]),
    "ridge_sweep": sql_round(f"WITH {REG_CTE}, {fit_cte(SWEEP_ALPHAS)}, {METRICS_CTE} SELECT {', '.join(_SW)} FROM sw", _SW),
    "argbest": sql_round(f"WITH {REG_CTE}, {fit_cte(SWEEP_ALPHAS)}, {METRICS_CTE} SELECT alpha_idx, alpha, val_rmse FROM {BEST} _b",
                         ["alpha", "val_rmse"]),
    "strongest_predictor": sql_round(f"""WITH {REG_CTE}, {fit_cte(SWEEP_ALPHAS)}, {METRICS_CTE},
 bf AS (SELECT fit.* FROM fit JOIN {BEST} b ON fit.alpha_idx = b.alpha_idx)
SELECT CASE WHEN abs(b1) >= abs(b2) THEN 'difficulty_adj' ELSE 'again' END AS feature,
       CASE WHEN abs(b1) >= abs(b2) THEN b1 ELSE b2 END AS coef FROM bf""", ["coef"]),
    "ridge_predict": sql_round(f"""WITH {REG_CTE}, {fit_cte(FIXED_ALPHAS)}
SELECT z.p_partkey, z.y AS rating_adj, fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2 AS y_hat
FROM z, fit WHERE z.is_test = 1""", ["rating_adj", "y_hat"]),
    "reg_metrics": sql_round(f"""WITH {REG_CTE}, {fit_cte(FIXED_ALPHAS)}
SELECT CASE WHEN z.is_test = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n,
  sqrt(avg((z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)) * (z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)))) AS rmse,
  1 - sum((z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)) * (z.y - (fit.b0 + fit.b1 * z.z1 + fit.b2 * z.z2)))
      / (var_pop(z.y) * count(*)) AS r2
FROM z, fit GROUP BY z.is_test""", ["rmse", "r2"]),
    "logit_1f": sql_round(logit_sql(), ["intercept", "coef_x"]),
    "logit_predict": sql_round(logit_sql(f"""SELECT l.l_orderkey, l.l_linenumber,
  1 / (1 + exp(-(s.a + s.b * ((l.l_quantity - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END)))) AS proba,
  CAST(1 / (1 + exp(-(s.a + s.b * ((l.l_quantity - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END)))) > 0.5 AS INTEGER) AS pred
FROM lineitem l, st, s{LOGIT_STEPS} s"""), ["proba"]),
    "ridge_sweep_log": sql_round(
        f"WITH {REG_CTE}, {fit_cte(LOG_ALPHAS)}, {METRICS_CTE} SELECT {', '.join(_SW)} FROM sw", _SW),
    "threshold_labels": sql_round(f"SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM {SCORED} _s", ["score"]),
    "roc_points": sql_round(f"WITH {ROC_CTE} SELECT * FROM pts", ["threshold", "fpr", "tpr"]),
    "roc_auc": sql_round(f"""WITH {ROC_CTE}
SELECT sum(neg * (tps - pos + pos * 0.5)) / (max(pp) * max(nn)) AS auc FROM cu, tot""", ["auc"]),
    "youden": sql_round(f"WITH {ROC_CTE} SELECT * FROM yj", ["threshold", "j", "tpr", "fpr"]),
    "confusion": f"WITH {ROC_CTE} SELECT actual, predicted, count FROM cm",
    "class_report": sql_round(_report_sql(), ["precision", "recall", "f1"]),
}
