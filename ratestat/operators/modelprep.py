"""Exact seeded train/test split and train-only standardisation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.functions.hashing import HASH_BITS, hash60
from ratestat.operators.common import col, with_one_row


LEVEL_BITS = 12          # hash bits settled per counting pass
CUT_ROWS = 10_000        # a cut bucket of at most this many rows is ordered


def exact_split(df: DataFrame, key: str, seed, test_fraction: float = 0.2, flag: str = "is_test") -> DataFrame:
    """Mark exactly ceil(test_fraction * n) rows as test: the rows with the
    smallest (hash60(seed, key), key), a null key coming first.  ``key`` must
    be unique; equal keys get the same mark, so that the count may be missed
    by their number.  The set does not depend on partitioning.

    The cut is narrowed by counting passes over the key: each pass counts
    2**LEVEL_BITS buckets of the bucket where the cut falls, and the last
    bucket, of a few rows, is ordered.  The mark is then a plain projection."""
    keyed = df.select(col(key).alias("_k"), hash60(F.lit(str(seed)), col(key)).alias("_h"))
    need, prefix, shift = None, None, HASH_BITS
    while True:
        inside = keyed if prefix is None else keyed.where(F.shiftright("_h", shift) == prefix)
        shift -= LEVEL_BITS
        # at most 2**LEVEL_BITS rows reach the driver
        buckets = inside.groupBy(F.shiftright("_h", shift).alias("b"))
        counts = sorted((r["b"], r["n"]) for r in buckets.agg(F.count(F.lit(1)).alias("n")).collect())
        if need is None:
            need = math.ceil(sum(n for _, n in counts) * float(test_fraction))
        if need <= 0:
            return df.withColumn(flag, F.lit(0))
        for prefix, n in counts:
            if need <= n:
                break
            need -= n
        if n <= CUT_ROWS or shift == 0:
            break
    last = (keyed.where(F.shiftright("_h", shift) == prefix).orderBy("_h", F.col("_k").asc_nulls_first())
            .limit(need).agg(F.max_by(F.struct("_h", "_k"), F.struct("_h", "_k")).alias("c")).first()["c"])
    h, k = hash60(F.lit(str(seed)), col(key)), col(key)
    below = k.isNull() if last["_k"] is None else k.isNull() | (k <= F.lit(last["_k"]))
    return df.withColumn(flag, ((h < last["_h"]) | ((h == last["_h"]) & below)).cast("int"))


def fit_scaler(df: DataFrame, cols: Sequence[str], train_filter=None) -> DataFrame:
    """One-row frame of train means and population SDs (ddof 0); a zero SD
    is replaced by 1, as scikit-learn's StandardScaler does."""
    src = df.filter(train_filter) if train_filter is not None else df
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(col(c)).alias(f"_mu{i}"), F.stddev_pop(col(c)).alias(f"_sd{i}")]
    stats = src.agg(*aggs)
    return stats.select(*[F.col(f"_mu{i}") for i in range(len(cols))],
                        *[F.when(F.col(f"_sd{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd{i}"))
                          .alias(f"_sd{i}") for i in range(len(cols))])


def standardize(df: DataFrame, cols: Sequence[str], train_filter=None,
                prefix: str = "") -> DataFrame:
    """Scale ``cols`` with statistics fitted on the train rows only (all rows
    when no filter); other columns pass through.  With an empty prefix the
    columns are replaced in place."""
    cols = list(cols)
    scaler = fit_scaler(df, cols, train_filter)
    joined = with_one_row(df, scaler)
    scaled = {c: ((col(c) - F.col(f"_mu{i}")) / F.col(f"_sd{i}")).alias(prefix + c)
              for i, c in enumerate(cols)}
    if prefix:
        return joined.select(*[col(c) for c in df.columns], *scaled.values())
    return joined.select(*[scaled.get(c, col(c)) for c in df.columns])
