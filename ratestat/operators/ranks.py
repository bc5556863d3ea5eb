"""Distributed prefix sums over ordered distinct values.

Rank statistics (Mann-Whitney U, tie terms) and exact ROC curves all reduce
to cumulative counts over the *distinct* values of a score.  A plain
``Window.orderBy`` without a partition key would pull every distinct value
into a single task, so the order axis is cut into quantile buckets instead:

1. bucket bounds per group from ``percentile_approx`` over the distinct
   values (a bounded table: groups x buckets, broadcast);
2. running sums inside each (group, bucket) with a partitioned window;
3. per-bucket totals (a bounded table) turned into bucket offsets;
4. cumulative = bucket offset + running sum.

Each step is a Spark shuffle or a broadcast of a size-bounded table; no
task ever holds more than one bucket of one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratestat.operators.common import col, join_null_safe
from ratestat.session import materialize

DEFAULT_BUCKETS = None      # None: sized from the distinct-value count
ROWS_PER_BUCKET = 1_000_000  # target rows per (group, bucket) window task
FANOUT = 64                  # quantile bounds per level of bucketing


def collapse_counts(df: DataFrame, group_cols: Sequence[str], value: str,
                    count_exprs: dict[str, Column]) -> DataFrame:
    """``(group..., value, counts...)``: one row per distinct value; rows with
    a null value are dropped.  Partial aggregation collapses hot values
    map-side before the shuffle."""
    keys = [col(g) for g in group_cols] + [col(value).alias("value")]
    return (df.filter(col(value).isNotNull()).groupBy(*keys)
            .agg(*[e.alias(name) for name, e in count_exprs.items()]))


def bucket_count(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-int(n_rows) // rows_per_bucket))


def _assign_buckets(base: DataFrame, groups, gnames, n_buckets: int) -> DataFrame:
    """Add ``_bucket``: contiguous ranges of ``_ord`` per group.  Levels of
    FANOUT quantile bounds nest (64, 4096, ... buckets), each level computed
    per (group, parent bucket) with ``percentile_approx`` and broadcast
    (groups x parents rows of FANOUT - 1 bounds)."""
    base = base.withColumn("_bucket", F.lit(0).cast("long"))
    if n_buckets <= 1:
        return base
    levels, cap = 1, FANOUT
    while cap < n_buckets:
        levels += 1
        cap *= FANOUT
    for level in range(levels):
        fan = FANOUT if level < levels - 1 else max(2, -(-n_buckets // (cap // FANOUT)))
        probs = [i / fan for i in range(1, fan)]
        keys = [*gnames, "_bucket"]
        bounds = base.groupBy(*groups, "_bucket").agg(
            F.percentile_approx("_ord", F.array(*[F.lit(p) for p in probs]), 10000).alias("_bounds"))
        # bounds: groups x parent buckets rows
        base = join_null_safe(base, bounds, keys, small=True)
        sub = F.size(F.filter(F.array_distinct("_bounds"), lambda b: b < F.col("_ord")))
        base = base.withColumn("_bucket", F.col("_bucket") * fan + sub).drop("_bounds")
    return base


def _running(base, groups, columns, sum_cols, with_next: bool) -> DataFrame:
    """Cumulative sums of groups that are one bucket each."""
    w = Window.partitionBy(*groups, F.col("_bucket")).orderBy("_ord")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    out = [col(c) for c in columns] + [F.sum(col(c)).over(up_to).alias(f"cum_{c}") for c in sum_cols]
    if with_next:
        out += [F.lead(col(c)).over(w).alias(f"next_{c}") for c in sum_cols]
    return base.select(*out)


def prefix_sums(collapsed: DataFrame, group_cols: Sequence[str], order_col: str,
                sum_cols: Sequence[str], descending: bool = False,
                n_buckets: int | None = DEFAULT_BUCKETS, with_next: bool = False,
                materialize_input: bool = True, n_rows: int | None = None) -> DataFrame:
    """Add inclusive cumulative sums ``cum_<c>`` along ``order_col`` within
    each group.  ``order_col`` must be unique within a group (collapse
    first).  With ``with_next`` also add ``next_<c>``: the counts of the next
    distinct value in order (null for the last).

    ``n_buckets=None`` sizes the buckets from the row count of the
    (materialised) collapsed table: about ROWS_PER_BUCKET distinct values
    per window task; a table that fits one bucket skips the bounds pass."""
    if materialize_input:
        # read several times below (bounds, running sums, bucket totals)
        collapsed = materialize(collapsed)
    if n_buckets is None:
        n_buckets = bucket_count(n_rows if n_rows is not None else collapsed.count())
    groups = [col(g) for g in group_cols]
    gnames = list(group_cols)
    ordv = -col(order_col) if descending else col(order_col)
    base = collapsed.withColumn("_ord", ordv.cast("double"))
    base = _assign_buckets(base, groups, gnames, n_buckets)
    if n_buckets > 1:
        # percentile_approx bounds may differ between two evaluations (merge
        # order); the running sums and the bucket totals below must see the
        # SAME bucket of every value, also after a task retry: fix it once.
        base = materialize(base)
    if n_buckets == 1:
        return _running(base, groups, collapsed.columns, sum_cols, with_next)
    part = [*groups, F.col("_bucket")]
    w_run = Window.partitionBy(*part).orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    running = base.select("*", *[F.sum(col(c)).over(w_run).alias(f"_run_{c}") for c in sum_cols])
    if with_next:
        w_ord = Window.partitionBy(*part).orderBy("_ord")
        running = running.select("*", *[F.lead(col(c)).over(w_ord).alias(f"_lead_{c}")
                                        for c in sum_cols])

    totals = base.groupBy(*groups, "_bucket").agg(
        *[F.sum(col(c)).alias(f"_tot_{c}") for c in sum_cols],
        F.min_by(F.struct(*[col(c).alias(c) for c in sum_cols]), F.col("_ord")).alias("_first"))
    w_off = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = totals.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_tot_{c}").over(
            w_off.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{c}")
          for c in sum_cols],
        *[F.lead(F.col("_first")[c]).over(w_off).alias(f"_nextb_{c}") for c in sum_cols])
    # offsets has one row per (group, bucket): bounded by groups x n_buckets.
    out = join_null_safe(running, offsets, [*gnames, "_bucket"], small=True)
    cols = [F.col(c) for c in collapsed.columns]
    cols += [(F.col(f"_off_{c}") + F.col(f"_run_{c}")).alias(f"cum_{c}") for c in sum_cols]
    if with_next:
        cols += [F.coalesce(F.col(f"_lead_{c}"), F.col(f"_nextb_{c}")).alias(f"next_{c}")
                 for c in sum_cols]
    return out.select(*cols)
