"""Plan-level properties: determinism under repartitioning and no
single-partition funnel over raw rows."""

import pytest
from pyspark.sql import functions as F

from ratestat.operators import effects, hypothesis, indexing, ranks


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_sums_partitioned_not_single(spark):
    raw = spark.range(5000).select((F.col("id") % 97).cast("double").alias("v"),
                                   (F.col("id") % 3 == 0).cast("long").alias("c"))
    coll = ranks.collapse_counts(raw, [], "v", {"c": F.sum("c"), "n": F.count(F.lit(1))})
    out = ranks.prefix_sums(coll, [], "value", ["c", "n"], n_buckets=8)
    rows = sorted(out.collect(), key=lambda r: r["value"])
    assert rows[-1]["cum_n"] == 5000
    running = 0
    for r in rows:
        running += r["n"]
        assert r["cum_n"] == running
    plan = _plan(out)
    # windows are partitioned by bucket: the window input never goes through SinglePartition
    assert "Window" in plan
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            assert "Window" not in line


def test_hash_rank_dense_and_partition_invariant(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    a = indexing.hash_rank(df, ["g"], ["k"], 5, bucket_bits=0).select("k", "idx")
    b = indexing.hash_rank(df.repartition(13), ["g"], ["k"], 5, bucket_bits=4).select("k", "idx")
    ra = dict(a.collect())
    rb = dict(b.collect())
    assert ra == rb
    for g in (0, 1):
        assert sorted(ra[k] for k in ra if k % 2 == g) == list(range(1500))


def test_bootstrap_partition_invariant(spark, two_samples):
    r1 = effects.bootstrap_replicates(two_samples, "grp", "x", "id", ["A", "B"], 20, 7, 99)
    r2 = effects.bootstrap_replicates(two_samples.repartition(5), "grp", "x", "id", ["A", "B"], 20, 7, 99)
    a = sorted(tuple(r) for r in r1.collect())
    b = sorted(tuple(r) for r in r2.collect())
    assert a == b
    assert len(a) == 20 and all(r[1] == 7 for r in a)


def test_bootstrap_ci_midpoint(spark):
    reps = spark.range(101).select(F.col("id").alias("rep"), F.col("id").cast("double").alias("s"))
    r = effects.bootstrap_ci(reps, ["s"]).collect()[0]
    assert r["ci_lo"] == pytest.approx(2.5) and r["ci_hi"] == pytest.approx(97.5)
    assert r["ci_mid"] == pytest.approx(50.0) and r["boot_mean"] == pytest.approx(50.0)


def test_pvalue_udf_only_on_final_rows(spark):
    raw = spark.range(2000).select((F.col("id") % 2).cast("string").alias("g"),
                                   (F.col("id") % 17).cast("double").alias("x"))
    plan = _plan(hypothesis.ttest(raw, "g", "x", "0", "1"))
    # the Arrow UDF sits above the aggregation, never below it
    lines = plan.splitlines()
    udf_at = [i for i, l in enumerate(lines) if "ArrowEvalPython" in l]
    agg_at = [i for i, l in enumerate(lines) if "HashAggregate" in l]
    assert udf_at and agg_at and max(udf_at) < min(agg_at)


def test_scan_pruning_and_pushdown(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(100).select("id", (F.col("id") * 2).alias("a"), F.lit("x").alias("b")).write.parquet(p)
    df = spark.read.parquet(p).select("id", "a").filter(F.col("a") > 10)
    plan = _plan(df)
    assert "GreaterThan(a,10)" in plan.split("PushedFilters:")[1].split("]")[0]
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan


@pytest.mark.parametrize("buckets", [None, 1, 5, 100, 300])
def test_prefix_sums_bucket_levels(spark, buckets):
    raw = spark.range(20000).select(((F.col("id") * 7919) % 4001).cast("double").alias("v"),
                                    (F.col("id") % 2).alias("g"))
    coll = ranks.collapse_counts(raw, ["g"], "v", {"n": F.count(F.lit(1))})
    out = ranks.prefix_sums(coll, ["g"], "value", ["n"], n_buckets=buckets, descending=True,
                            with_next=True)
    for g in (0, 1):
        rows = sorted((r for r in out.collect() if r["g"] == g), key=lambda r: -r["value"])
        running = 0
        for i, r in enumerate(rows):
            running += r["n"]
            assert r["cum_n"] == running
            nxt = rows[i + 1]["n"] if i + 1 < len(rows) else None
            assert r["next_n"] == nxt
