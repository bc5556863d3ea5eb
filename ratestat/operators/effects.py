"""Effect sizes and the hash-keyed two-group bootstrap.

No draw is ever a row.  ``bootstrap_replicates`` deals the rows to hash
buckets; a replicate's draws are split over the buckets down a binary tree by
keyed binomial draws, which is an exact multinomial split, and a bucket's task
resamples its own count from its own rows in numpy.  ``poisson_replicates``
multiplies blocks of rows with blocks of replicates' weights.  Both shuffle
one row of sums per (task, group, replicate).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.functions.hashing import DRAW_BITS, DRAWS, HASH_BITS, hash60, mix_keys, mix_numbers, stir
from ratestat.operators import hypothesis, indexing
from ratestat.operators.common import col
from ratestat.session import materialize, ship_package

BUCKET_ROWS = 1 << 18      # rows that a bucket is aimed at
MOST_BITS = 20             # buckets a group, as a power of two; their sizes ride in the closure
BATCH = 1 << 20            # draws made at once
TASK_DRAWS = 1 << 22       # draws below which replicates are not dealt further
SUMS = "g int, rep long, n double, s1 double, s2 double"


def _d_columns(n1, m1, v1, n2, m2, v2):
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    average = F.sqrt((v1 + v2) / 2)
    return F.try_divide(m1 - m2, pooled), F.try_divide(m1 - m2, average)


def cohens_d(df: DataFrame, grp: str, value: str, first, second) -> DataFrame:
    """Cohen's d with df-weighted pooled SD and with the averaged SD."""
    pm = hypothesis.pair_moments(hypothesis.group_moments(df, grp, value), first, second)
    c = [F.col(x) for x in ("n1", "m1", "v1", "n2", "m2", "v2")]
    d_pooled, d_avg = _d_columns(*c)
    return pm.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                     (F.col("m1") - F.col("m2")).alias("mean_diff"),
                     d_pooled.alias("d_pooled"), d_avg.alias("d_average"))


def variance_ratio(df: DataFrame, grp: str, value: str, first, second) -> DataFrame:
    pm = hypothesis.pair_moments(hypothesis.group_moments(df, grp, value), first, second)
    return pm.select(F.col("v1").alias("var1"), F.col("v2").alias("var2"),
                     F.try_divide(F.col("v1"), F.col("v2")).alias("var_ratio"))


def _pick_groups(stats: DataFrame) -> DataFrame:
    """(rep, g, n, mean, var) to one row per replicate of groups 0 and 1."""
    def pick(g, c):
        return F.max(F.when(F.col("g") == g, F.col(c)))
    return stats.groupBy("rep").agg(
        *[pick(g, c).alias(f"{c}{g + 1}") for g in (0, 1) for c in ("n", "mean", "var")])


def _group_number(grp: str, groups: Sequence) -> Column:
    label = col(grp)
    return F.when(label == F.lit(groups[0]), F.lit(0)).when(label == F.lit(groups[1]), F.lit(1))


def _two_groups(df: DataFrame, grp: str, value: str, key: str, groups: Sequence) -> DataFrame:
    return df.filter(col(grp).isin(list(groups)) & col(value).isNotNull()).select(
        _group_number(grp, groups).alias("g"), col(key).alias("_key"), col(value).cast("double").alias("x"))


def _replicate_rows(sums: DataFrame, centers: Sequence[float | None]) -> DataFrame:
    """(rep, g, n, s1, s2) around each group's center to one row a replicate;
    a group that weighs 0 has no mean."""
    total = sums.groupBy("rep", "g").agg(F.sum("n").alias("n"), F.sum("s1").alias("_s1"), F.sum("s2").alias("_s2"))
    center = F.when(F.col("g") == 0, F.lit(centers[0])).otherwise(F.lit(centers[1])).cast("double")
    shift = F.try_divide(F.col("_s1"), F.col("n"))
    return _pick_groups(total.select("rep", "g", "n", (center + shift).alias("mean"), F.try_divide(
        F.col("_s2") - F.col("_s1") * shift, F.col("n") - 1).alias("var")))


def tree_counts(draws: int, replicates: int, before: np.ndarray, bucket: int, seed, group: int) -> np.ndarray:
    """How many of each replicate's ``draws`` fall into ``bucket``.

    ``before`` counts the rows ahead of each bucket (and all rows at its end).
    At each node of the binary tree over the buckets the draws are split by a
    binomial draw with the left half's share of rows, keyed by seed, group and
    node, so every task that passes the node makes the same split and the
    buckets' counts add up to ``draws``."""
    counts = np.full(replicates, draws, dtype=np.int64)
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid, rows = (lo + hi) // 2, int(before[hi] - before[lo])
        share = float(before[mid] - before[lo]) / rows if rows else 0.0
        digest = hashlib.md5(f"{seed}:{group}:{lo}:{hi}".encode()).hexdigest()
        left = np.random.Generator(np.random.Philox(key=int(digest, 16))).binomial(counts, share)
        if bucket < mid:
            counts, hi = left, mid
        else:
            counts, lo = counts - left, mid
    return counts


def _resampled(before, draws, replicates, pieces, firsts, centers, seed):
    """A bucket's rows to sums per replicate of one piece of the replicates."""
    def run(table: pa.Table) -> pa.Table:
        g, bucket, piece = (int(table.column(c)[0].as_py()) for c in ("g", "_b", "piece"))
        x = np.empty(table.num_rows)
        x[table.column("idx").to_numpy()] = table.column("x").to_numpy() - centers[g]
        buckets = len(before[g]) - 1
        where = () if buckets == 1 else (buckets, bucket)
        lanes = [mix_keys(seed, lane, *where) for lane in ("high", "low")]
        reps = np.arange(piece * replicates // pieces, (piece + 1) * replicates // pieces)
        counts = tree_counts(draws[g], replicates, before[g], bucket, seed, g)[reps]
        s1, s2 = np.zeros(len(reps)), np.zeros(len(reps))
        a = 0
        while a < len(reps):
            b = max(a + 1, int(np.searchsorted(np.cumsum(counts[a:]), BATCH, side="right")) + a)
            ends = np.cumsum(counts[a:b])
            start = np.repeat(firsts[g] + reps[a:b] * draws[g] - (ends - counts[a:b]), counts[a:b])
            number = start + np.arange(len(start))
            wide = (mix_numbers(number, lanes[0]) << DRAW_BITS) + mix_numbers(number, lanes[1])
            drawn = x[(wide.view(np.uint64) % np.uint64(len(x))).view(np.int64)]
            some = np.flatnonzero(counts[a:b])
            if len(some):
                edges = (ends - counts[a:b])[some]
                s1[a + some] = np.add.reduceat(drawn, edges)
                s2[a + some] = np.add.reduceat(drawn * drawn, edges)
            a = b
        return pa.table({"g": pa.array(np.full(len(reps), g), pa.int32()), "rep": reps, "n": counts.astype(float),
                         "s1": s1, "s2": s2})
    return run


def bootstrap_replicates(df: DataFrame, grp: str, value: str, key: str, groups: Sequence,
                         replicates: int, draws: int | None, seed, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per replicate with per-group mean/var of the resample of the
    two ``groups``.

    ``draws=None`` resamples n_g rows per group (n-out-of-n); an integer
    draws that many per group (m-out-of-n).  Rows are ranked by (hash, key)
    in buckets of the hash's high bits, about ``bucket_rows`` each; draw j of
    a replicate in a bucket picks the row whose rank is a mix of (replicate,
    j) modulo the bucket's rows.  Results depend on keys and seed alone.
    Rows with a null value are left out; an empty group is an error."""
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    groups = list(groups)
    rows = _two_groups(df, grp, value, key, groups)
    known = {r["g"]: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("c")).collect()}
    n_by = [known[g]["n"] if g in known else 0 for g in range(len(groups))]
    if min(n_by) == 0:
        raise ValueError(f"empty bootstrap group among {groups}: sizes {n_by}")
    bits = min(MOST_BITS, indexing.bucket_bits_for(max(n_by), bucket_rows))
    bucket = F.shiftright(hash60(F.lit(str(seed)), F.col("_key")), HASH_BITS - bits) if bits else F.lit(0).cast("long")
    ranked = materialize(indexing.hash_rank(rows.withColumn("_b", bucket), ["g", "_b"], ["_key"], seed)
                         .select("g", "_b", "idx", "x"))
    # one number a (group, bucket), at most 2 * 2**MOST_BITS
    sizes = np.zeros((len(groups), 1 << bits), dtype=np.int64)
    counted = ranked.groupBy("g", "_b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes[counted.column("g").to_numpy(), counted.column("_b").to_numpy()] = counted.column("n").to_numpy()
    before = np.concatenate([np.zeros((len(groups), 1), dtype=np.int64), sizes.cumsum(axis=1)], axis=1)

    per_rep = [draws if draws else n for n in n_by]
    firsts = [0, replicates * per_rep[0]]  # one numbering of the draws for both groups
    wanted = -(-4 * spark.sparkContext.defaultParallelism // (2 << bits))
    pieces = max(1, min(wanted, replicates, replicates * max(per_rep) // TASK_DRAWS + 1))
    dealt = ranked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    sums = dealt.groupBy("g", "_b", "piece").applyInArrow(
        _resampled(before, per_rep, replicates, pieces, firsts, [known[g]["c"] for g in (0, 1)], seed), SUMS)
    return _replicate_rows(sums, [known[g]["c"] for g in (0, 1)])


POISSON_LIMITS = [math.floor(DRAWS * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
ROW_BLOCK, REP_BLOCK = 512, 512


def poisson_weights(row_draws: np.ndarray, reps: np.ndarray, keys: Sequence[int]) -> np.ndarray:
    """Poisson(1) weights, one row a data row and one column a replicate: k
    where the mixed draw lies between the shares of at most k - 1 and k."""
    u = stir(row_draws[:, None] * keys[0] + (reps * keys[1] & (DRAWS - 1))[None, :], keys)
    out = np.zeros(u.shape, dtype=np.int8)
    for limit in POISSON_LIMITS:
        more = u >= limit
        if not more.any():
            break
        out += more
    return out


def _weighted(replicates, row_keys, draw_keys, centers):
    """Rows to sums per (group, replicate) by products of weight blocks."""
    def emit(batches):
        total = np.zeros((2, replicates, 3))
        some = False
        for batch in batches:
            g = batch.column("g").to_numpy()
            number = mix_numbers(batch.column("_k").to_numpy(), row_keys)
            x = batch.column("x").to_numpy()
            some = some or len(x) > 0
            for group in (0, 1):
                at = np.flatnonzero(g == group)
                for a in range(0, len(at), ROW_BLOCK):
                    mine = at[a:a + ROW_BLOCK]
                    z = x[mine] - centers[group]
                    powers = np.stack([np.ones(len(z)), z, z * z])
                    for r in range(0, replicates, REP_BLOCK):
                        reps = np.arange(r, min(r + REP_BLOCK, replicates))
                        weights = poisson_weights(number[mine], reps, draw_keys)
                        total[group, r:r + len(reps)] += (powers @ weights.astype(float)).T
        for group in (0, 1) if some else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(replicates, group), pa.int32()), pa.array(np.arange(replicates)),
                 *[pa.array(np.ascontiguousarray(total[group, :, k])) for k in range(3)]], names=["g", "rep", "n", "s1", "s2"])
    return emit


def poisson_replicates(df: DataFrame, grp: str, value: str, key: str, groups: Sequence,
                       replicates: int, seed) -> DataFrame:
    """:func:`bootstrap_replicates` for large groups: every row weighs
    Poisson(1) in every replicate, fixed by (seed, key, replicate).  One scan;
    a task multiplies blocks of rows with blocks of weights and keeps three
    sums a (replicate, group).  The columns are the same; n1 and n2 are the
    weights in the replicate, and a group that weighs 0 has no mean."""
    ship_package(df.sparkSession)
    rows = _two_groups(df, grp, value, key, groups)
    means = rows.agg(*[F.avg(F.when(F.col("g") == i, F.col("x"))).alias(f"c{i}") for i in (0, 1)]).first()
    centers = [means["c0"] or 0.0, means["c1"] or 0.0]
    sums = rows.select("g", hash60(F.lit(str(seed)), F.col("_key")).alias("_k"), "x").mapInArrow(
        _weighted(replicates, mix_keys(seed, "row"), mix_keys(seed, "poisson"), centers), SUMS)
    return _replicate_rows(sums, centers)


def bootstrap_effects(reps: DataFrame) -> DataFrame:
    """Per replicate: Cohen's d (pooled and averaged SD) and variance ratio."""
    c = [F.col(x) for x in ("n1", "mean1", "var1", "n2", "mean2", "var2")]
    d_pooled, d_avg = _d_columns(*c)
    return reps.select("rep", d_pooled.alias("d_pooled"), d_avg.alias("d_average"),
                       F.try_divide(F.col("var1"), F.col("var2")).alias("var_ratio"))


def bootstrap_ci(reps: DataFrame, stats: Sequence[str], level: float = 0.95) -> DataFrame:
    """Long table (statistic, boot_mean, ci_lo, ci_hi, ci_mid) with
    linear-interpolation percentile bounds over the replicates."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    aggs = []
    for i, s in enumerate(stats):
        aggs += [F.avg(col(s)).alias(f"_m{i}"),
                 F.percentile(col(s), F.array(F.lit(lo), F.lit(hi))).alias(f"_q{i}")]
    wide = reps.agg(*aggs)
    rows = [F.struct(F.lit(s).alias("statistic"), F.col(f"_m{i}").alias("boot_mean"),
                     F.col(f"_q{i}")[0].alias("ci_lo"), F.col(f"_q{i}")[1].alias("ci_hi"))
            for i, s in enumerate(stats)]
    out = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return out.withColumn("ci_mid", (F.col("ci_lo") + F.col("ci_hi")) / 2)
