"""Logistic classification and exact threshold analysis.

* ``logistic_fit``: L2-penalised logistic regression (scikit-learn's C
  objective, unpenalised intercept) by Newton/IRLS.  Each iteration is ONE
  Arrow pass whose tasks add up gradient and Hessian ((p+1)^2 numbers) as
  numpy products of row blocks; the driver only updates a (p+1)-vector.  A
  ``weight`` column lets callers pre-collapse identical rows.
* ROC / AUC / Youden: scores collapse to (score, pos, neg) counts and use
  the distributed prefix sums of :mod:`ratestat.operators.ranks` -- exact
  at every distinct score, no binning.
* Confusion matrix and per-class report from one 2x2 count table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.operators import ranks
from ratestat.operators.common import col, with_one_row
from ratestat.operators.moments import newton_sums, unpack_moments
from ratestat.session import materialize


# ------------------------------------------------------------- logistic
def logistic_fit(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
                 weight: str | None = None, max_iter: int = 50, tol: float = 1e-12) -> DataFrame:
    """Minimise 0.5*||w||^2 + C * sum(weight * logloss); intercept free.

    A Newton step that does not lower the objective is halved until it does.
    The fitted probabilities are a point of the dual problem, and its distance
    to the objective, the duality gap, is half the squared norm of the
    weights' gradient (and the intercept's gradient times the intercept): the
    fit ends when that is at most ``tol`` of the objective, with one more
    step.  Raises ``RuntimeError`` when ``max_iter`` passes end before,
    ``ValueError`` when there is no complete row; rows with a null are left
    out.  Returns a one-row frame: intercept, coefs (array), n_iter,
    converged, gap (before the last step)."""
    spark: SparkSession = df.sparkSession
    p = len(features)
    names = [*[f"_x{i}" for i in range(p)], "_y", "_w"]
    source = [*[col(f) for f in features], col(label), col(weight) if weight else F.lit(1.0)]
    # every Newton step re-reads the training rows: materialise them once
    rows = materialize(df.select(*[c.cast("double").alias(n) for c, n in zip(source, names)]).dropna())
    beta, step, objective, gap = np.zeros(p + 1), np.zeros(p + 1), np.inf, np.inf
    penalty = np.array([0.0] + [1.0] * p)
    converged, it = False, 0
    for it in range(1, max_iter + 1):
        sums = newton_sums(rows, names, beta).first()  # 1 + (p + 1) + (p + 1)^2 numbers
        if sums is None:
            raise ValueError("no complete row to fit")
        loss, grad, hess = unpack_moments(sums["state"])
        now = C * loss + 0.5 * float(beta[1:] @ beta[1:])
        if now > objective + 1e-9 * abs(objective):
            step = step / 2
            beta = beta + step
            continue
        objective = now
        grad = C * grad + penalty * beta
        gap = 0.5 * float(grad[1:] @ grad[1:]) + abs(float(beta[0] * grad[0]))
        step = np.linalg.solve(C * hess + np.diag(penalty), grad)
        beta = beta - step
        if gap <= tol * max(1.0, objective) and abs(grad[0]) <= tol ** 0.5 * max(1.0, objective):
            converged = True
            break
    if not converged:
        raise RuntimeError(f"logistic fit did not converge in {max_iter} passes")
    return spark.createDataFrame(
        [(float(beta[0]), [float(b) for b in beta[1:]], it, converged, float(gap))],
        "intercept double, coefs array<double>, n_iter int, converged boolean, gap double")


def logistic_proba(df: DataFrame, fit: DataFrame, features: Sequence[str],
                   out: str = "proba") -> DataFrame:
    joined = with_one_row(df, fit.select("intercept", "coefs"))
    eta = F.col("intercept")
    for i, f in enumerate(features):
        eta = eta + F.col("coefs")[i] * col(f)
    return joined.select(*[col(c) for c in df.columns], (1 / (1 + F.exp(-eta))).alias(out))


# ------------------------------------------------------------------ ROC
def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value=score, pos, neg) per distinct score."""
    yl = col(label)
    return ranks.collapse_counts(df, by, score, {"pos": F.count_if(yl == 1).cast("long"),
                                                 "neg": F.count_if(yl == 0).cast("long")})


def roc_table(counts: DataFrame, n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """All distinct thresholds (descending) of a written ``score_counts``
    table, with cumulative tps/fps and the next threshold's counts; plus
    totals P and N."""
    cum = ranks.prefix_sums(counts, [], "value", ["pos", "neg"], descending=True,
                            n_buckets=n_buckets, with_next=True, materialize_input=False)
    return with_one_row(cum, _totals(counts))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))


def roc_points(df: DataFrame, score: str, label: str, drop_intermediate: bool = True,
               n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """ROC points as scikit-learn's ``roc_curve``: a point per distinct score
    (``score >= threshold``), collinear interior points dropped, and a
    leading (0, 0) point whose threshold is null (= +infinity).  The rows
    are read once, for their counts per score."""
    return roc_points_from(materialize(score_counts(df, score, label)), drop_intermediate, n_buckets)


def roc_points_from(counts: DataFrame, drop_intermediate: bool = True,
                    n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """:func:`roc_points` of a written ``score_counts`` table."""
    t = roc_table(counts, n_buckets)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = t.filter(first | last | bend) if drop_intermediate else t
    pts = kept.select(F.col("value").alias("threshold"), F.col("cum_neg").alias("fps"),
                      F.col("cum_pos").alias("tps"), "P", "N")
    start = _totals(counts).where("P + N > 0").select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("fps"),
        F.lit(0).cast("long").alias("tps"), "P", "N")
    both = pts.unionByName(start)
    return both.select("threshold", "fps", "tps",
                       F.try_divide(F.col("fps"), F.col("N")).alias("fpr"),
                       F.try_divide(F.col("tps"), F.col("P")).alias("tpr"))


def roc_auc(df: DataFrame, score: str, label: str, n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """Trapezoidal AUC over the exact ROC (ties count one half)."""
    t = roc_table(materialize(score_counts(df, score, label)), n_buckets)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") * 0.5)
    return t.agg(F.try_divide(F.sum(area), F.first("P") * F.first("N")).alias("auc"))


def youden(points: DataFrame) -> DataFrame:
    """Threshold maximising tpr - fpr; the first point (highest threshold)
    wins ties.  A null threshold means +infinity (nothing predicted 1)."""
    j = F.col("tpr") - F.col("fpr")
    order = F.struct(j, F.coalesce(F.col("threshold"), F.lit(float("inf"))))
    best = points.agg(F.max_by(F.struct(F.col("threshold"), j.alias("j"), F.col("tpr"), F.col("fpr")),
                               order).alias("_b"))
    return best.select("_b.*")


# ------------------------------------------------- confusion and report
def confusion_at(counts: DataFrame, threshold: Column) -> DataFrame:
    """:func:`confusion` of the labels ``value > threshold``, from a
    ``score_counts`` table that carries the threshold."""
    above = F.col("value") > threshold
    n = {(a, b): F.coalesce(F.sum(F.when(above if b else ~above, F.col("pos" if a else "neg"))), F.lit(0))
         for a in (0, 1) for b in (0, 1)}
    sums = counts.agg(*[e.alias(f"c{a}{b}") for (a, b), e in n.items()])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("count"))
             for a, b in n]
    return sums.select(F.inline(F.array(*cells)))


def confusion(df: DataFrame, actual: str, predicted: str | Column) -> DataFrame:
    """2x2 confusion counts (actual, predicted, count), zeros included."""
    pred = col(predicted) if isinstance(predicted, str) else predicted
    counts = df.select(col(actual).cast("int").alias("actual"), pred.cast("int").alias("predicted"))
    agg = counts.agg(*[F.count_if((F.col("actual") == a) & (F.col("predicted") == b)).alias(f"c{a}{b}")
                       for a in (0, 1) for b in (0, 1)])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                      F.col(f"c{a}{b}").alias("count")) for a in (0, 1) for b in (0, 1)]
    return agg.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def class_report(conf: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages (0/0 -> 0), from the 2x2 confusion table."""
    def cnt(a, b):
        return F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == b), F.col("count"))
                     .otherwise(0))
    m = conf.agg(cnt(0, 0).alias("tn"), cnt(0, 1).alias("fp"), cnt(1, 0).alias("fn"),
                 cnt(1, 1).alias("tp"))

    def safe(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    f1 = safe(2 * p1 * r1, p1 + r1)
    f0 = safe(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), safe(tp + tn, tot), tot),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        ("weighted avg", safe(p0 * s0 + p1 * s1, tot), safe(r0 * s0 + r1 * s1, tot),
         safe(f0 * s0 + f1 * s1, tot), tot),
    ]
    cells = [F.struct(F.lit(n).alias("label"), a.alias("precision"), b.alias("recall"),
                      c.alias("f1"), d.cast("long").alias("support")) for n, a, b, c, d in rows]
    return m.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")
