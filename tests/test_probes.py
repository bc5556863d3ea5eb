"""Inputs on which an earlier version gave wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from ratestat.functions.pvalues import log10_normal_two_sided
from ratestat.operators import chartdata, describe, gram, quantiles
from ratestat.plans.questions import row_key
from ratestat.sources import positional, survey


def test_ridge_ignores_rows_with_a_null_feature(spark):
    rows = [(float(i), 2.0 * i + 1, 0) for i in range(6)] + [(None, 5.0, 0), (3.0, None, 0), (10.0, 21.0, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, split int")
    fit = gram.ridge_sweep(df, ["x"], "y", "split", gram.alpha_grid(spark, "arange", 1)).first()
    assert fit["intercept"] == pytest.approx(1.0) and fit["coefs"][0] == pytest.approx(2.0)
    assert fit["train_rmse"] == pytest.approx(0.0, abs=1e-9) and fit["val_rmse"] == pytest.approx(0.0, abs=1e-9)


def test_row_key_keeps_the_place_of_nulls(spark):
    rows = [(1, None, "z"), (None, 1, "z"), (None, None, "z"), (1, 1, None), (1, 1, "z"), (None, 1, None)]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    assert row_key(df).select("_key").distinct().count() == 6


@pytest.mark.parametrize("tail", [[], [(None, None)]])
def test_constant_column_has_no_correlation(spark, tail):
    df = spark.createDataFrame([(0.1, float(i * i)) for i in range(7)] + tail, "k double, y double")
    got = {(r["row"], r["col"]): r["r"] for r in describe.corr_matrix(df, ["k", "y"]).collect()}
    assert got["k", "k"] is None and got["k", "y"] is None and got["y", "y"] == pytest.approx(1.0)


def test_vif_of_singular_designs(spark):
    df = spark.createDataFrame([(float(v), 3.1 * v, float(v * v % 7), 4.0) for v in range(1, 30)],
                               "v double, w double, u double, c double")
    got = {r["feature"]: r["vif"] for r in gram.vif(df, ["v", "w", "u"]).collect()}
    assert math.isinf(got["v"]) and math.isinf(got["w"]) and got["u"] < 10 and 1 < got["Intercept"] < 100
    got = {r["feature"]: r["vif"] for r in gram.vif(df, ["v", "u", "c"]).collect()}
    assert math.isinf(got["c"]) and math.isinf(got["Intercept"]) and got["v"] < 10


def test_histogram_of_unequal_edges(spark):
    df = spark.createDataFrame([(x,) for x in (2.5, 0.0, 3.0, 99.0, 100.0, 100.1, -1.0)], "x double")
    got = {r["bin"]: r["count"] for r in chartdata.histogram_fixed(df, None, "x", [0, 1, 2, 3, 100]).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        chartdata.histogram_fixed(df, None, "x", [0, 2, 1])


def test_histogram_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.5), (None, 0.5)], "g string, x double")
    got = {(r["grp"], r["bin"]): r["count"] for r in chartdata.histogram_fixed(df, "g", "x", [0, 1, 2]).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, (None, 0): 1, (None, 1): 1}


def test_automatic_histogram_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), (None, 1.0), (None, 1.5), (None, 3.0)], "g string, x double")
    rows = chartdata.histogram_auto(df, "g", "x", 2, density=True).collect()
    got = {(r["grp"], r["bin"]): (r["lo"], r["hi"], r["count"]) for r in rows}
    assert got == {("a", 0): (0.0, 2.0, 1), ("a", 1): (2.0, 4.0, 1), (None, 0): (1.0, 2.0, 2), (None, 1): (2.0, 3.0, 1)}
    assert sum(r["density"] * (r["hi"] - r["lo"]) for r in rows if r["grp"] is None) == pytest.approx(1)


def test_quantile_methods_agree_on_a_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 2.0), (None, 9.0)], "g string, x double")
    for method in (None, "exact"):
        rows = quantiles.group_quantiles(df, ["g"], "x", [0.5], ["m"], method=method).collect()
        assert {(r["g"], r["m"]) for r in rows} == {("a", 2.0), (None, 2.0)}


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,"Univ ""X"", main",NY\nb,"two\nlines",CA\n')
    rows = survey.read_csv_columns(spark, str(tmp_path / "q.csv"), ["f", "u", "s"]).collect()
    assert [tuple(r) for r in rows] == [("a", 'Univ "X", main', "NY"), ("b", "two\nlines", "CA")]
    df = spark.createDataFrame([(' pad ', 'say "hi", you')], "f string, u string")
    survey.write_csv(df, str(tmp_path / "out"))
    back = survey.read_csv_columns(spark, str(tmp_path / "out"), ["f", "u"], header=True).first()
    assert tuple(back) == (' pad ', 'say "hi", you')


def test_positional_bind_wants_single_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    with pytest.raises(ValueError):
        positional.positional_bind(many, spark.range(100).withColumnRenamed("id", "k"))


def test_log_p_does_not_underflow(spark):
    df = spark.createDataFrame([(45.0, 0.0), (2.0, math.erfc(2 / 2 ** .5)), (37.0, math.erfc(37 / 2 ** .5))], "z double, p double")
    got = [r[0] for r in df.select(log10_normal_two_sided(F.col("z"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(-441.4746, abs=1e-3)
    assert got[1] == pytest.approx(math.log10(0.0455002639), abs=1e-8)
    assert got[2] == pytest.approx(math.log10(math.erfc(37 / 2 ** .5)), abs=1e-8)
