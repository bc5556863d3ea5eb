import numpy as np
import pytest

from ratestat.operators import quantiles


def test_matches_numpy_linear(spark):
    rng = np.random.default_rng(9)
    groups = {"a": np.round(rng.normal(size=301), 2), "b": rng.integers(0, 5, 50).astype(float),
              "c": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = {r["g"]: r for r in quantiles.group_quantiles(df, ["g"], "x", probs, names).collect()}
    for g, vs in groups.items():
        exp = np.percentile(vs, [p * 100 for p in probs])
        assert [got[g][n] for n in names] == pytest.approx(list(exp), abs=1e-12)


def test_global_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    r = quantiles.group_quantiles(df, [], "x", [0.5], ["m"]).collect()
    assert len(r) == 1 and r[0]["m"] == 3.0


def test_approx_is_close(spark):
    df = spark.range(10000).selectExpr("cast(id as double) as x")
    r = quantiles.group_quantiles(df, [], "x", [0.5], ["m"], "approx").first()["m"]
    assert abs(r - 4999.5) < 20


def test_large_near_distinct_column_in_few_rows(spark):
    """Ranks far beyond the sketch's exact range, a hot group, a null group."""
    n = 400_000
    df = spark.range(n).selectExpr("case when id % 3 = 0 then 'hot' when id % 1000 = 1 then null else 'b' end as g",
                                   "cast(pmod(id * 7919, 399989) as double) / 7 as x")
    probs = [0.9, 0.001, 0.5]
    got = {r["g"]: list(r)[1:] for r in quantiles.group_quantiles(df, ["g"], "x", probs, ["a", "b", "c"]).collect()}
    pdf = df.toPandas()
    for g, vs in pdf.groupby(pdf.g.fillna("null")).x:
        assert got[None if g == "null" else g] == pytest.approx(list(np.percentile(vs, [90, 0.1, 50])), abs=1e-9)


def test_small_groups_at_awkward_ranks(spark):
    rows = [(n, float(v * v)) for n in range(1, 12) for v in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.9, 0.1, 0.5, 0.99]
    for r in quantiles.group_quantiles(df, ["g"], "x", probs, ["a", "b", "c", "d"]).collect():
        expected = np.percentile([v * v for v in range(r["g"])], [90, 10, 50, 99])
        assert [r["a"], r["b"], r["c"], r["d"]] == pytest.approx(list(expected), abs=1e-12)


def test_no_values_at_all(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles.group_quantiles(df, ["g"], "x", [0.5], ["m"]).collect() == []
    assert [r["m"] for r in quantiles.group_quantiles(df, [], "x", [0.5], ["m"]).collect()] == [None]


@pytest.mark.parametrize("where,gap_rows", [("below", 40), ("apart", 1), ("above", 10_000)])
def test_wrong_brackets_are_refined(spark, where, gap_rows):
    """Brackets that miss every rank cost scans, never the exact value."""
    from pyspark.sql import functions as F

    from ratestat.operators.common import col

    def wrong(rows, gnames, probs):
        lo, hi = {"below": (-1e9, -1e8), "above": (1e8, 1e9), "apart": (3.25, 3.25)}[where]
        out = rows.groupBy(*[col(g) for g in gnames]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
        return out.select(*[col(g) for g in gnames], "_n", F.array(*[F.lit(lo)] * len(probs)).alias("_lo"),
                          F.array(*[F.lit(hi)] * len(probs)).alias("_hi"))
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": np.round(rng.normal(3, 2, 900), 1), None: rng.lognormal(0, 6, 500), "c": np.full(80, 2.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "rank string, c double")
    probs = [0.5, 0.01, 0.9, 0.5]
    got = {r["rank"]: list(r)[1:] for r in quantiles.group_quantiles(
        df, ["rank"], "c", probs, ["m", "lo", "hi", "again"], brackets=wrong, gap_rows=gap_rows).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.percentile(vs, [50, 1, 90, 50])), rel=1e-12, abs=1e-12)
    one = quantiles.group_quantiles(df.where("rank = 'b'"), [], "c", [0.3, 0.7], ["p", "q"], brackets=wrong, gap_rows=gap_rows).first()
    assert list(one) == pytest.approx(list(np.percentile(groups["b"], [30, 70])), rel=1e-12)
    if gap_rows == 40:
        check_median_moments({g: v for g, v in groups.items() if g}, quantiles.median_moments(df, "rank", "c", brackets=wrong))


def check_median_moments(groups, frame):
    got = {r["grp"]: r for r in frame.collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        z = np.abs(x - np.median(x))
        r = got[g]
        assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["z_mean"] == pytest.approx(z.mean(), rel=1e-11)
        if len(x) > 1:
            assert r["var"] == pytest.approx(x.var(ddof=1), rel=1e-10) and r["z_var"] == pytest.approx(z.var(ddof=1), rel=1e-9)


def test_median_moments_match_numpy(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(1e6, 1, 20_001), "b": np.round(rng.normal(5, 3, 3000), 1), "c": np.array([1.0, 4.0]), "d": np.array([7.0]),
              "e": np.array([0.0, 0.0, 9.0, 9.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("a", None)], "g string, x double")
    check_median_moments(groups, quantiles.median_moments(df.repartition(4), "g", "x"))


def test_levene_reads_the_rows_twice(spark, monkeypatch):
    from ratestat.operators import hypothesis
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'A', 'B') as g", "cast(id * id % 997 as double) as x")
    plain = hypothesis.levene(df, "g", "x").first()
    rows = {r["g"]: [] for r in df.select("g").distinct().collect()}
    for r in df.collect():
        rows[r["g"]].append(r["x"])
    z = [np.abs(np.array(v) - np.median(v)) for _, v in sorted(rows.items())]
    n = sum(map(len, z))
    grand = np.concatenate(z).mean()
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in z)
    ssw = sum(((v - v.mean()) ** 2).sum() for v in z)
    assert plain["w_stat"] == pytest.approx(ssb / (ssw / (n - 2)), rel=1e-9)
    scans = []
    before = quantiles._placed
    monkeypatch.setattr(quantiles, "_placed", lambda *a: scans.append(1) or before(*a))
    hypothesis.ttest_gated(df, "g", "x", "A", "B").collect()
    assert len(scans) == 1
