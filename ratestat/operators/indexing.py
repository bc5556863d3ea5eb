"""Dense row numbers without funnelling a group into one task.

``hash_rank`` gives each row its 0-based rank by (hash(seed, key), key)
inside its partition group.  Because the hash is uniform, its high bits cut
every group into equal buckets; rows are numbered inside (group, bucket)
with a partitioned window, and bucket offsets come from a bucket-count table
(groups x buckets rows, joined by its size).  The result depends only on the
keys and the seed - never on partitioning, retries or executor loss.

``scan_row_index`` numbers rows in file order for positional binding.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratestat.functions.hashing import HASH_BITS, hash60
from ratestat.operators.common import col, join_null_safe

ROWS_PER_BUCKET = 2_000_000


def bucket_bits_for(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bits of hash prefix giving buckets of about ``rows_per_bucket`` rows."""
    if n_rows <= rows_per_bucket:
        return 0
    return int(math.ceil(math.log2(n_rows / rows_per_bucket)))


def hash_rank(df: DataFrame, partition_cols: Sequence[str], key_cols: Sequence[str], seed,
              bucket_bits: int = 0, idx: str = "idx", hash_col: str = "_h") -> DataFrame:
    """Add ``hash_col`` = hash60(seed, keys) and ``idx`` = 0-based rank of
    (hash, keys) within ``partition_cols``.  ``keys`` must be unique inside a
    partition group for the ranks to be dense and unique."""
    parts = [col(c) for c in partition_cols]
    keys = [col(c) for c in key_cols]
    out = df.withColumn(hash_col, hash60(F.lit(str(seed)), *keys))
    out = out.withColumn("_bkt", F.shiftright(F.col(hash_col), HASH_BITS - bucket_bits)
                         if bucket_bits > 0 else F.lit(0).cast("long"))
    w = Window.partitionBy(*parts, F.col("_bkt")).orderBy(F.col(hash_col), *keys)
    out = out.withColumn("_rn", F.row_number().over(w))
    if bucket_bits == 0:
        return out.withColumn(idx, F.col("_rn") - 1).drop("_bkt", "_rn")
    counts = out.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, "_bkt", F.coalesce(F.sum("_cnt").over(wo), F.lit(0))
                            .alias("_off"))
    out = join_null_safe(out, offsets, [*partition_cols, "_bkt"], small=True)
    return out.withColumn(idx, F.col("_off") + F.col("_rn") - 1).drop("_bkt", "_rn", "_off")


def scan_row_index(df: DataFrame, idx: str = "row_idx") -> DataFrame:
    """0-based row number in scan order for a DataFrame read straight from
    one file (no shuffle above the scan).

    Within a scan task ``monotonically_increasing_id`` counts rows in file
    order; per-task row counts (one row per input split, broadcast) turn the
    local counter into a global, dense position."""
    tagged = df.select("*", F.spark_partition_id().alias("_pid"),
                       F.monotonically_increasing_id().alias("_mid"))
    tagged = tagged.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.select(*[col(c) for c in df.columns],
                      (F.col("_off") + F.col("_local")).alias(idx))
