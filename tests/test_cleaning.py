import math

import pytest
from pyspark.sql import functions as F

from ratestat.operators import clean, derive, describe

SCHEMA = "rating double, n double, t1 double, t2 double, a int, b int, st string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (4.0, 5.0, 1.0, 2.0, 1, 0, "NY"),
        (4.0, 5.0, 1.0, 2.0, 1, 0, "NY"),          # full duplicate
        (3.0, 2.0, None, 1.0, 0, 1, None),
        (3.0, 2.0, None, 1.0, 0, 1, None),         # duplicate with nulls
        (None, 3.0, 1.0, 1.0, 1, 0, "CA"),         # null rating
        (2.0, 1.0, 5.0, 0.0, 0, 1, "DC"),          # tag above n
        (2.5, 4.0, None, None, 1, 1, "TX"),        # all tags null; both flags
        (3.5, None, 1.0, 1.0, 0, 0, "XX"),         # n null; no flag
        (4.5, 0.0, 0.0, 0.0, 1, 0, "NA"),          # n = 0
        (float("nan"), 2.0, 1.0, 1.0, 0, 1, "WA"),  # NaN rating
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_dropna_dedupe_bound_order(edge):
    no_nan = clean.nan_to_null(edge)
    c = clean.clean_survey(no_nan, "rating", "n", ["t1", "t2"])
    got = sorted((r["rating"], r["n"]) for r in c.collect())
    # kept: (4,5) once, (3,2) once, (4.5, 0)   dropped: null/NaN rating, tag>n, all-null tags, n null
    assert got == [(3.0, 2.0), (4.0, 5.0), (4.5, 0.0)]


def test_duplicate_count_null_equals_null(edge):
    assert clean.count_duplicate_rows(edge).collect()[0][0] == 2


def test_exclusive_groups_and_overlap(edge):
    g = {r["grp"] for r in clean.exclusive_groups(edge, "a", "b").collect()}
    assert g == {"A", "B"}
    o = clean.flag_overlap(edge, "a", "b").collect()[0]
    assert (o["n_both"], o["n_neither"], o["n_either"]) == (1, 1, 9)


def test_null_counts(edge):
    got = {r["column"]: r["n_null"] for r in clean.null_counts(edge).collect()}
    assert got["rating"] == 1 and got["t1"] == 3 and got["st"] == 2


def test_whitelist_list_and_frame(spark, edge):
    allowed = ["NY", "CA", "TX", "WA"]
    a = clean.whitelist_filter(edge, "st", allowed).count()
    frame = spark.createDataFrame([(s,) for s in allowed], "code string")
    b = clean.whitelist_filter(edge, "st", frame).count()
    assert a == b == 5  # NY x2, CA, TX, WA


def test_shrinkage_hand_values(spark):
    df = spark.createDataFrame([(4.5, 10.0), (3.0, 4.0), (5.0, 1.0), (2.0, 25.0)], "r double, n double")
    out = derive.bayes_adjust(df, ["r"], "n", names=["adj"]).orderBy("n").collect()
    expected = {10.0: 4.13970588, 4.0: 3.39772727, 1.0: 3.796875, 25.0: 2.35546875}
    for row in out:
        assert row["adj"] == pytest.approx(expected[row["n"]], abs=1e-8)
        lo, hi = sorted([row["r"], 3.625])
        assert lo - 1e-12 <= row["adj"] <= hi + 1e-12


def test_normalise_zero_division_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0)], "t double, n double")
    got = [r["t (Normalized)"] for r in derive.normalize_by(df, ["t"], "n").orderBy("n").collect()]
    assert got[0] is None and got[1] == 0.5


def test_row_total_all_null_is_zero(spark):
    df = spark.createDataFrame([(None, None), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(derive.row_total(["a", "b"])).collect()]
    assert got == [0.0, 1.0]


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    got = {(r["row"], r["col"]): r["r"] for r in describe.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == got[("b", "a")]
    assert got[("a", "c")] is None or math.isnan(got[("a", "c")])


def test_strip_suffix_all_occurrences(spark):
    df = spark.createDataFrame([("Caring (Normalized)",)], "t string")
    assert df.select(derive.strip_suffix("t", " (Normalized)")).first()[0] == "Caring"


def test_verdict_boundaries(spark):
    df = spark.createDataFrame([(0.005,)], "p double")
    assert df.select(derive.verdict("p", 0.005, "le")).first()[0] == "significant"
    assert df.select(derive.verdict("p", 0.005, "lt")).first()[0] == "not significant"


ODD_ROWS = [(1, None, 0.0, "a"), (1, None, -0.0, "a"), (None, 1, 0.0, "a"), (1, 1, float("nan"), None), (1, 1, float("nan"), None),
            (2, 2, 2.0, ""), (2, 2, 2.0, None), (2, 2, 2.0, None), (3, 3, 3.0, "x"), (None, None, None, None), (None, None, None, None)]


def test_digest_dedupe_equals_a_whole_row_comparison(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ratestat.operators import clean
    df = spark.createDataFrame(ODD_ROWS, "a int, b int, c double, _met string").repartition(4)
    for collide in (False, True):
        if collide:  # every row has one digest: the comparison alone decides
            monkeypatch.setattr(clean, "_digests", lambda keys: [F.lit(7).cast("long").alias(f"_d{i}") for i in (1, 2)])
        renamed = df.withColumnRenamed("_met", "s")
        got = clean.drop_duplicate_rows(renamed)
        assert got.columns == ["a", "b", "c", "s"]
        assert sorted(map(str, got.collect())) == sorted(map(str, renamed.dropDuplicates().collect()))
        assert clean.count_duplicate_rows(renamed).first()[0] == 4
        assert clean.drop_duplicate_rows(renamed, ["a", "b"]).count() == renamed.select("a", "b").distinct().count()
        assert clean.count_duplicate_rows(renamed, ["a"]).first()[0] == 7
    assert clean.drop_duplicate_rows(renamed.limit(0)).count() == 0
    assert clean.count_duplicate_rows(renamed.limit(0)).first()[0] == 0


def test_rows_that_repeat_nothing_are_not_shuffled_whole(spark):
    from ratestat.operators import clean
    df = spark.range(2000).selectExpr("id", "repeat(cast(id as string), 50) as wide")
    plan = clean.drop_duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert clean.drop_duplicate_rows(df.unionByName(df.where("id < 10"))).count() == 2000


def test_many_repeats_are_compared_in_one_shuffle(spark, monkeypatch):
    """Where much repeats, no digests are joined to the whole rows, whose
    sorts made the query slow; every way gives the same rows."""
    from pyspark.sql import functions as F

    from ratestat.operators import clean
    df = spark.range(1000).selectExpr("id", "if(id % 5 = 0, null, repeat(cast(id as string), 20)) as wide", "cast(id as double) as x")
    for extra in (df.where("id % 3 = 0"), df.where("id % 40 = 0")):
        both = df.unionByName(extra)
        for many, rows in ((0.1, 1 << 20), (1.0, 1 << 20), (1.0, 0)):
            monkeypatch.setattr(clean, "MANY", many)
            monkeypatch.setattr(clean, "BROADCAST_DIGESTS", rows)
            got = clean.drop_duplicate_rows(both)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("Join" in plan) == (rows > 0 and (many == 1.0 or extra.count() < 100))
            assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
            assert clean.count_duplicate_rows(both).first()[0] == extra.count()
            assert clean.drop_duplicate_rows(both, ["x"]).count() == 1000
    odd = spark.createDataFrame(ODD_ROWS, "a int, b int, c double, s string")
    monkeypatch.setattr(clean, "MANY", 1.0)
    monkeypatch.setattr(clean, "BROADCAST_DIGESTS", 1 << 20)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(clean, "_digests", lambda keys: [F.lit(7).cast("long").alias(f"_d{i}") for i in (1, 2)])
        assert sorted(map(str, clean.drop_duplicate_rows(odd).collect())) == sorted(map(str, odd.dropDuplicates().collect()))
        assert clean.count_duplicate_rows(odd).first()[0] == 4
        assert clean.count_duplicate_rows(odd, ["a", "b"]).first()[0] == len(ODD_ROWS) - odd.select("a", "b").distinct().count()
