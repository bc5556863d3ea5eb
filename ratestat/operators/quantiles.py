"""Exact quantiles (NumPy 'linear' interpolation) in two pruned scans.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and collapsing a near-distinct column to (value, count)
shuffles a copy of it.  Instead:

1. the first scan takes, per group, the row count and a sketched bracket
   around each quantile (``percentile_approx`` just below and just above it);
2. the second scan counts the rows of the gaps between the brackets and
   collapses only the few rows inside them to (value, count);
3. running counts over that small table give the value at each exact rank.

The table of step 2 holds about 0.1 % of the rows per quantile and goes
through the bucketed prefix sums of :mod:`ratestat.operators.ranks`, so no
task holds a whole group.  The sketch only chooses where to look.  Should a
rank miss its bracket, the counts say in which gap it lies and at which place:
only that gap's rows are read again, cut into finer gaps, until the rank's gap
is small enough to be collapsed as a whole.

Null values are ignored, a null group is a group like any other.
``method="approx"`` is ``percentile_approx`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratestat.operators import ranks
from ratestat.operators.common import col, join_null_safe, with_one_row
from ratestat.session import materialize

APPROX_ACCURACY = 100000
SKETCH_ACCURACY = 10000        # rank error of the sketch: n / SKETCH_ACCURACY
MARGIN = 4 / SKETCH_ACCURACY   # bracket reach on either side of a quantile
GAP_ROWS = 200_000             # a missed rank's gap of at most this many rows is collapsed
CUTS = 64                      # finer gaps that a larger one is cut into


def _brackets(rows: DataFrame, gnames: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Per group: row count ``_n`` and the sorted bracket ends ``_lo``,
    ``_hi``.  Written once: a sketch may differ between two evaluations, and
    both readers must see the same ends.  The file's size tells the planner
    whether it can be broadcast."""
    ends = [max(0.0, p - MARGIN) for p in probs] + [min(1.0, p + MARGIN) for p in probs]
    k = len(probs)
    out = rows.groupBy(*[col(g) for g in gnames]).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", F.array(*[F.lit(e) for e in ends]), SKETCH_ACCURACY).alias("_e"))
    return materialize(out.where("_n > 0").select(
        *[col(g) for g in gnames], "_n", F.slice("_e", 1, k).alias("_lo"), F.slice("_e", k + 1, k).alias("_hi")))


def _placed(rows: DataFrame, gnames: Sequence[str], ends: DataFrame) -> DataFrame:
    """The rows with their group's brackets and the number of brackets below
    them; brackets ascend, so the rows of one gap lie between two neighbours."""
    placed = join_null_safe(rows, ends, gnames) if gnames else with_one_row(rows, ends)
    gap = F.aggregate("_hi", F.lit(0), lambda n, hi: n + (F.col("_x") > hi).cast("int"))
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda b: F.col("_x").between(b["_lo"], b["_hi"]))
    return placed.select(*[col(g) for g in gnames], "_n", "_lo", "_x", gap.alias("_gap"), F.when(inside, F.col("_x")).alias("_v"))


def _slot(rank) -> Column:
    """What the running counts know of a rank: its value ``x``, or the piece
    [lo, hi] of ``c`` rows in which it has the place ``rank``."""
    first, past = F.col("cum_c") - F.col("c"), F.col("cum_c")
    found = (F.when(F.col("value") == F.col("_top"), F.col("value"))
             .when(rank == first, F.col("value")).when(rank == past - 1, F.col("_top")))
    piece = F.struct(found.alias("x"), F.col("value").alias("lo"), F.col("_top").alias("hi"),
                     (rank - first).alias("rank"), F.col("c").alias("c"))
    return F.max(F.when((first <= rank) & (rank < past), piece))


def _ranks(p: float):
    """(rank below, rank above, share of the way) of a quantile of ``_n`` rows."""
    pos = F.lit(p) * (F.col("_n") - 1)
    low = F.floor(pos).cast("long")
    return low, F.least(low + 1, F.col("_n") - 1), pos - low


def _refined(rows: DataFrame, gnames: Sequence[str], targets: DataFrame, gap_rows: int) -> DataFrame:
    """(group, _i, x) of targets (group, _i, lo, hi, rank, c): the value at
    place ``rank`` among the group's ``c`` rows within [lo, hi]."""
    keys = [*gnames, "_i"]
    found = None

    def within(t: DataFrame, *more: str) -> DataFrame:
        t = t.select(*[col(k) for k in keys], *[F.col(c).alias(f"_t_{c}") for c in ("lo", "hi", "rank", *more)])
        inside = F.col("_x").between(F.col("_t_lo"), F.col("_t_hi"))
        # without groups there are at most two targets a quantile
        return join_null_safe(rows, t, gnames).where(inside) if gnames else rows.join(F.broadcast(t), inside)

    while True:
        targets = materialize(targets)  # one row a missed rank
        most = targets.agg(F.max("c")).first()[0]
        if most is None:
            return found
        small = within(targets.where(F.col("c") <= gap_rows))
        counts = small.groupBy(*[col(k) for k in keys], "_t_rank", "_x").agg(F.count(F.lit(1)).alias("_k"))
        run = Window.partitionBy(*[col(k) for k in keys]).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        reached = counts.withColumn("_past", F.sum("_k").over(run)).where(F.col("_past") > F.col("_t_rank"))
        done = reached.groupBy(*[col(k) for k in keys]).agg(F.min("_x").alias("x"))
        found = done if found is None else found.unionByName(done)
        large = targets.where(F.col("c") > gap_rows)
        if most <= gap_rows:
            return found
        grid = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
        bounds = within(large).groupBy(*[col(k) for k in keys]).agg(F.percentile_approx("_x", grid, SKETCH_ACCURACY).alias("_b"))
        cut = materialize(join_null_safe(large, bounds, keys).withColumn(
            "bounds", F.array_sort(F.array_distinct(F.concat("_b", F.array(F.col("lo") / 2 + F.col("hi") / 2))))).drop("_b"))
        part = F.size(F.filter("_t_bounds", lambda b: b < F.col("_x")))
        parts = within(cut, "bounds").groupBy(*[col(k) for k in keys], "_t_rank", part.alias("_part")).agg(
            F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("c"))
        run = Window.partitionBy(*[col(k) for k in keys]).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_past", F.sum("c").over(run))
        rank = F.col("_t_rank") - (F.col("_past") - F.col("c"))
        targets = parts.where((rank >= 0) & (rank < F.col("c"))).select(
            *[col(k) for k in keys], "lo", "hi", rank.alias("rank"), F.when(F.col("lo") < F.col("hi"), F.col("c")).otherwise(
                F.least(F.col("c"), F.lit(gap_rows))).alias("c"))


def group_quantiles(df: DataFrame, group_cols: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str],
                    method: str | None = None, brackets=_brackets, gap_rows: int = GAP_ROWS) -> DataFrame:
    """One row per group: ``group_cols`` + one column per probability.
    Groups with no value are absent; without ``group_cols`` there is always
    one row, of nulls if there is no value.  ``brackets`` chooses where to
    look first; the result doesn't depend on it."""
    gnames = [f"_g{i}" for i in range(len(group_cols))]
    gcols = [F.col(g) for g in gnames]
    named = [F.col(g).alias(c) for g, c in zip(gnames, group_cols)]
    x = col(value)
    rows = df.filter(x.isNotNull()).select(*[col(c).alias(g) for g, c in zip(gnames, group_cols)], x.cast("double").alias("_x"))
    if method == "approx":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        out = rows.groupBy(*gcols).agg(F.percentile_approx("_x", arr, APPROX_ACCURACY).alias("_q"))
        return out.select(*named, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method not in (None, "exact"):
        raise ValueError(f"unknown quantile method {method!r}")

    ascending = sorted({float(p) for p in probs})
    ends = brackets(rows, gnames, ascending)
    if not gnames and ends.isEmpty():
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    pieces = _placed(rows, gnames, ends).groupBy(*gcols, "_n", "_gap", "_v").agg(
        F.min("_x").alias("value"), F.max("_x").alias("_top"), F.count(F.lit(1)).alias("c"))
    cum = ranks.prefix_sums(pieces.select(*gcols, "_n", "value", "_top", "c"), gnames, "value", ["c"])
    slots = {}
    for i, p in enumerate(ascending):
        low, high, share = _ranks(p)
        slots |= {f"_s{2 * i}": _slot(low), f"_s{2 * i + 1}": _slot(high), f"_f{i}": F.max(share)}
    known = materialize(cum.groupBy(*gcols).agg(*[c.alias(n) for n, c in slots.items()]))  # one row a group

    k = 2 * len(ascending)
    found = [F.col(f"_s{i}.x") for i in range(k)]
    missed = known.select(*gcols, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_s{i}").alias("_s")) for i in range(k)])).alias("_m"))
    missed = missed.select(*gcols, "_m._i", "_m._s.*").where("x is null").drop("x")
    if not missed.isEmpty():
        late = _refined(rows, gnames, missed, gap_rows).groupBy(*gcols).agg(
            *[F.max(F.when(F.col("_i") == i, F.col("x"))).alias(f"_x{i}") for i in range(k)])
        known = join_null_safe(known, late, gnames, "left", small=True) if gnames else with_one_row(known, late)
        found = [F.coalesce(c, F.col(f"_x{i}")) for i, c in enumerate(found)]
    at = {p: found[2 * i] + F.col(f"_f{i}") * (found[2 * i + 1] - found[2 * i]) for i, p in enumerate(ascending)}
    return known.select(*named, *[at[float(p)].alias(n) for p, n in zip(probs, names)])


def median_moments(df: DataFrame, grp: str, value: str, brackets=_brackets) -> DataFrame:
    """(grp, n, mean, var, z_mean, z_var): moments of the values and of their
    distances from the group's median, in the two scans that find the median.

    The second scan also takes each piece's sums of x - a and (x - a)^2, a
    being the bracket's lower end, next to the median.  Every piece lies on
    one side of the median, so the sums around it follow from those.  Rows
    with a null group or value are left out.  Should a median miss its
    bracket, a third scan reads them from the refined medians."""
    rows = df.where(col(grp).isNotNull() & col(value).isNotNull()).select(
        col(grp).alias("grp"), col(value).cast("double").alias("_x"))
    d = F.col("_x") - F.col("_lo")[0]
    pieces = _placed(rows, ["grp"], brackets(rows, ["grp"], [0.5])).groupBy("grp", "_n", "_gap", "_v").agg(
        F.min("_x").alias("value"), F.max("_x").alias("_top"), F.count(F.lit(1)).alias("c"), F.max(F.col("_lo")[0]).alias("_a"),
        F.sum(d).alias("_s1"), F.sum(d * d).alias("_s2"))
    cum = materialize(ranks.prefix_sums(pieces.select("grp", "_n", "value", "_top", "c", "_a", "_s1", "_s2"), ["grp"], "value", ["c"]))
    low, high, share = _ranks(0.5)
    medians = materialize(cum.groupBy("grp").agg(_slot(low).alias("_l"), _slot(high).alias("_h"), F.max(share).alias("_f")))
    if not medians.where("_l.x is null or _h.x is null").isEmpty():
        medians = materialize(group_quantiles(rows, ["grp"], "_x", [0.5], ["_m"], brackets=brackets))
        x, z = F.col("_x"), F.abs(F.col("_x") - F.col("_m"))
        return rows.join(medians, "grp").groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.avg(z).alias("z_mean"),
            F.var_samp(z).alias("z_var"))
    medians = medians.select("grp", (F.col("_l.x") + F.col("_f") * (F.col("_h.x") - F.col("_l.x"))).alias("_m"))
    n, s1, s2, m = F.col("_n"), F.col("_s1"), F.col("_s2"), F.col("_m") - F.col("_a")
    j = cum.join(medians, "grp")
    away = (F.when(F.col("_top") <= F.col("_m"), F.col("c") * m - s1).when(F.col("value") >= F.col("_m"), s1 - F.col("c") * m)
            .otherwise(F.col("_top") - F.col("value")))  # two rows around the median
    sums = j.groupBy("grp", "_n", "_a").agg(F.sum(s1).alias("_s1"), F.sum(s2).alias("_s2"), F.sum(away).alias("_z1"),
                                           F.sum(s2 - 2 * m * s1 + F.col("c") * m * m).alias("_z2"))
    return sums.select("grp", n.alias("n"), (F.col("_a") + s1 / n).alias("mean"), F.try_divide(s2 - s1 * s1 / n, n - 1).alias("var"),
                       (F.col("_z1") / n).alias("z_mean"), F.try_divide(F.col("_z2") - F.col("_z1") * F.col("_z1") / n, n - 1).alias("z_var"))
