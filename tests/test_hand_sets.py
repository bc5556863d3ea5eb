"""Hand-checkable two-sample set A = 1,2,2,4,7 ; B = 2,3,5,5,9,10."""

import pytest
from pyspark.sql import functions as F

from ratestat.operators import chartdata, classify, effects, hypothesis


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_moments(two_samples):
    rows = {r["grp"]: r for r in hypothesis.group_moments(two_samples, "grp", "x").collect()}
    assert rows["A"]["mean"] == pytest.approx(3.2)
    assert rows["B"]["mean"] == pytest.approx(5.6666667, abs=1e-7)
    assert rows["A"]["var"] == pytest.approx(5.7)
    assert rows["B"]["var"] == pytest.approx(10.2666667, abs=1e-7)


def test_student_and_welch(two_samples):
    s = one(hypothesis.ttest(two_samples, "grp", "x", "A", "B", equal_var=True))
    assert s["t"] == pytest.approx(-1.4193491448, abs=1e-9)
    assert s["df"] == pytest.approx(9)
    w = one(hypothesis.ttest(two_samples, "grp", "x", "A", "B", equal_var=False))
    assert w["t"] == pytest.approx(-1.4608424949, abs=1e-9)
    assert w["df"] == pytest.approx(8.9280735035, abs=1e-9)
    g = one(hypothesis.ttest(two_samples, "grp", "x", "A", "B", equal_var=True, alternative="greater"))
    assert g["p_value"] == pytest.approx(1 - s["p_value"] / 2, abs=1e-12)


def test_levene_and_anova(two_samples):
    lev = one(hypothesis.levene(two_samples, "grp", "x"))
    assert lev["w_stat"] == pytest.approx(0.3425605536, abs=1e-9)
    an = one(hypothesis.anova(two_samples, "grp", "x"))
    assert an["f_stat"] == pytest.approx(2.0145519948, abs=1e-9)
    assert an["f_stat"] == pytest.approx(1.4193491448 ** 2, abs=1e-8)


def test_levene_shift_invariant(two_samples):
    shifted = two_samples.withColumn("x", F.when(F.col("grp") == "B", F.col("x") + 100).otherwise(F.col("x")))
    a = one(hypothesis.levene(two_samples, "grp", "x"))["w_stat"]
    b = one(hypothesis.levene(shifted, "grp", "x"))["w_stat"]
    assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("buckets", [1, 4])
def test_mann_whitney(two_samples, buckets):
    r = one(hypothesis.mannwhitney(two_samples, "grp", "x", "A", "B", n_buckets=buckets))
    assert r["u1"] == pytest.approx(7.0)
    assert r["tie_term"] == pytest.approx(30.0)
    assert r["z"] == pytest.approx(1.3851370514, abs=1e-9)
    assert r["p_value"] == pytest.approx(0.1660105644, abs=1e-9)
    assert r["method"] == "asymptotic"


def test_mann_whitney_u_symmetry(two_samples):
    a = one(hypothesis.mannwhitney(two_samples, "grp", "x", "A", "B"))["u1"]
    b = one(hypothesis.mannwhitney(two_samples, "grp", "x", "B", "A"))["u1"]
    assert a + b == pytest.approx(5 * 6)


def test_effects(two_samples):
    d = one(effects.cohens_d(two_samples, "grp", "x", "A", "B"))
    assert d["d_pooled"] == pytest.approx(-0.8594585882, abs=1e-9)
    assert d["d_average"] == pytest.approx(-0.8730082212, abs=1e-9)
    v = one(effects.variance_ratio(two_samples, "grp", "x", "A", "B"))
    assert v["var_ratio"] == pytest.approx(0.5551948052, abs=1e-9)


def test_box_quartiles(two_samples):
    rows = {r["grp"]: r for r in chartdata.box_stats(two_samples, "grp", "x").collect()}
    b = rows["B"]
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((3.5, 5.0, 8.0))
    assert b["n_outliers"] == 0


def _scored(two_samples):
    return two_samples.select(F.col("x").alias("score"), (F.col("grp") == "B").cast("int").alias("label"))


def test_auc_and_youden(two_samples):
    s = _scored(two_samples)
    auc = one(classify.roc_auc(s, "score", "label", n_buckets=2))["auc"]
    assert auc == pytest.approx(0.7666666667, abs=1e-9)
    y = one(classify.youden(classify.roc_points(s, "score", "label", n_buckets=2)))
    assert y["threshold"] == pytest.approx(5.0)
    assert y["j"] == pytest.approx(0.4666667, abs=1e-7)
    assert y["tpr"] == pytest.approx(0.6666667, abs=1e-7)
    assert y["fpr"] == pytest.approx(0.2)


def test_roc_points_match_sklearn_rule(two_samples):
    pts = classify.roc_points(_scored(two_samples), "score", "label").collect()
    got = sorted((r["fps"], r["tps"]) for r in pts)
    # distinct scores descending: 10,9,7,5,4,3,2,1 -> keep bends only
    assert got[0] == (0, 0)
    assert (5, 6) in got
    assert len(got) <= 9


def _conf(df):
    return {(r["actual"], r["predicted"]): r["count"] for r in df.collect()}


def test_confusion_strict_and_inclusive(two_samples):
    s = _scored(two_samples)
    strict = _conf(classify.confusion(s, "label", (F.col("score") > 5).cast("int")))
    assert (strict[(0, 0)], strict[(0, 1)], strict[(1, 0)], strict[(1, 1)]) == (4, 1, 4, 2)
    incl = _conf(classify.confusion(s, "label", (F.col("score") >= 5).cast("int")))
    assert (incl[(0, 0)], incl[(0, 1)], incl[(1, 0)], incl[(1, 1)]) == (4, 1, 2, 4)


def test_class_report(two_samples):
    s = _scored(two_samples)
    rep = {r["label"]: r for r in classify.class_report(
        classify.confusion(s, "label", (F.col("score") > 5).cast("int"))).collect()}
    assert rep["1"]["precision"] == pytest.approx(2 / 3)
    assert rep["1"]["recall"] == pytest.approx(2 / 6)
    assert rep["accuracy"]["f1"] == pytest.approx(6 / 11)
    assert rep["macro avg"]["support"] == 11
