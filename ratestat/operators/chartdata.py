"""Chart-ready tables: the original analysis draws figures; we return the
numbers behind them (histogram counts, box summaries, KDE curves,
choropleth values) as DataFrames.

Bin assignment follows NumPy exactly: explicit edges are left-closed with
the last bin closed, out-of-range values are dropped; equal-width bins use
linspace edges with NumPy's one-step index correction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratestat.operators import quantiles
from ratestat.operators.common import col
from ratestat.operators.common import join_null_safe, with_one_row
from ratestat.session import materialize, ship_package


def arange_edges(start: float, stop: float, step: float) -> list[float]:
    """NumPy ``arange`` values: start + k * ((start + step) - start)."""
    return [float(v) for v in np.arange(start, stop, step)]


def _bin_of(x: Column, first: Column, delta: Column, nb: Column, edge) -> Column:
    """Bin index with one correction step against the exact edge values;
    null when x is outside [edge(0), edge(nb)]."""
    k0 = F.floor((x - first) / delta).cast("int")
    k0 = F.least(F.greatest(k0, F.lit(0)), nb - 1)
    k1 = F.when(x < edge(k0), k0 - 1).otherwise(k0)
    k2 = F.when((k1 < nb - 1) & (x >= edge(k1 + 1)), k1 + 1).otherwise(k1)
    inside = (x >= edge(F.lit(0))) & (x <= edge(nb))
    return F.when(inside, k2)


def histogram_fixed(df: DataFrame, grp: str | None, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per (group, bin) for explicit ascending ``edges`` (one row per
    bin and group, zeros included): grp, bin, lo, hi, count."""
    edges = [float(e) for e in edges]
    nb = len(edges) - 1
    arr = F.array(*[F.lit(e) for e in edges])

    def edge(k):
        return F.element_at(arr, k + 1)
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must ascend")
    keys = [col(grp).alias("grp")] if grp else [F.lit("all").alias("grp")]
    x = col(value)
    # edges at or below x, for equal and unequal widths alike; the last bin is closed
    below = F.size(F.filter(arr, lambda e: e <= x))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    binned = df.filter(x.isNotNull()).select(*keys, F.when(inside, F.least(below, F.lit(nb)) - 1).alias("bin"))
    counts = binned.filter(F.col("bin").isNotNull()).groupBy("grp", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    groups = df.select(*keys).distinct()
    grid = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bin"))
    out = join_null_safe(grid, counts, ["grp", "bin"], "left")
    return out.select("grp", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def histogram_auto(df: DataFrame, grp: str | None, value: str, bins: int,
                   density: bool = False) -> DataFrame:
    """``bins`` equal-width bins from each group's min to max (NumPy
    ``histogram(x, bins=int)``); with ``density`` also count / (N * width)."""
    keys = [col(grp).alias("grp")] if grp else [F.lit("all").alias("grp")]
    x = col(value)
    rows = df.filter(x.isNotNull()).select(*keys, x.cast("double").alias("_x"))
    rng = rows.groupBy("grp").agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
                                  F.count(F.lit(1)).alias("_n"))
    same = F.col("_mn") == F.col("_mx")
    rng = rng.select("grp", "_n",
                     F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    rng = rng.withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    nb = F.lit(bins)

    def edge(k):
        return F.when(k >= nb, F.col("_hi")).otherwise(k.cast("double") * F.col("_step") + F.col("_lo"))
    rng = materialize(rng)  # one row per group, read twice; joined by its size
    joined = join_null_safe(rows, rng, ["grp"])
    f = ((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int")
    f = F.when(f == nb, nb - 1).otherwise(f)
    k1 = F.when(F.col("_x") < edge(f), f - 1).otherwise(f)
    k2 = F.when((k1 != nb - 1) & (F.col("_x") >= edge(k1 + 1)), k1 + 1).otherwise(k1)
    counts = joined.select("grp", k2.alias("bin")).groupBy("grp", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    grid = rng.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = join_null_safe(grid, counts, ["grp", "bin"], "left").select(
        "grp", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"), "_n")
    if density:
        out = out.withColumn("density", F.try_divide(F.col("count"),
                                                     F.col("_n") * (F.col("hi") - F.col("lo"))))
    return out.drop("_n")


def box_stats(df: DataFrame, grp: str, value: str, whis: float = 1.5,
              quantile_method: str | None = None) -> DataFrame:
    """Per group: n, mean, q1, median, q3 (linear), whiskers at the furthest
    points within whis * IQR, and the outlier count."""
    x = col(value)
    rows = df.filter(x.isNotNull() & col(grp).isNotNull()).select(col(grp).alias("grp"),
                                                                   x.alias("_x"))
    q = quantiles.group_quantiles(rows, ["grp"], "_x", [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                                  quantile_method)
    q = q.withColumn("_lo", F.col("q1") - whis * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + whis * (F.col("q3") - F.col("q1")))
    j = rows.join(materialize(q), "grp")  # one row per group
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return j.groupBy("grp", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def box_outliers(df: DataFrame, grp: str, value: str, whis: float = 1.5,
                 quantile_method: str | None = None) -> DataFrame:
    """The rows drawn as outlier points (beyond q1 - whis*IQR, q3 + whis*IQR);
    the quartile table is joined back to the rows by its size."""
    rows = df.filter(col(value).isNotNull() & col(grp).isNotNull())
    q = quantiles.group_quantiles(rows.select(col(grp).alias("_g"), col(value).alias("_x")),
                                  ["_g"], "_x", [0.25, 0.75], ["_q1", "_q3"], quantile_method)
    limits = q.select("_g", (F.col("_q1") - whis * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
                      (F.col("_q3") + whis * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
    j = rows.join(materialize(limits), col(grp) == F.col("_g"))  # one row per group
    out = j.filter((col(value) < F.col("_lo")) | (col(value) > F.col("_hi")))
    return out.select(*[col(c) for c in df.columns])


KDE_REACH = 40.0  # exp(-39 ** 2 / 2) is 0 as a double, and a value lies within half a bandwidth of its cell's centre
KDE_TERMS = 20


def _hermite_sums(gridsize: int):
    """Moments of a cell to its contribution to every grid point."""
    @F.pandas_udf("array<double>")
    def spread(moments: pd.Series, centre: pd.Series, bw: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        if not len(moments):
            return pd.Series([], dtype=object)
        m = np.stack(moments.to_numpy())
        lo, hi, centre, bw = (c.to_numpy(float)[:, None] for c in (lo, hi, centre, bw))
        x = np.arange(gridsize) * ((hi - lo) / (gridsize - 1)) + lo
        x[:, -1:] = hi
        u = (x - centre) / bw
        far = np.abs(u) > KDE_REACH
        u = np.where(far, 0, u)
        last, here = np.zeros_like(u), np.ones_like(u)   # Hermite polynomials by their recursion
        total = m[:, :1] * here
        for k in range(1, KDE_TERMS):
            last, here = here, u * here - (k - 1) * last
            total += m[:, k:k + 1] * here
        return pd.Series(list(np.where(far, 0, total * np.exp(-0.5 * u * u))))
    return spread


def kde_cells(df: DataFrame, grp: str, value: str, gridsize: int, cut: float) -> tuple[DataFrame, DataFrame]:
    """(one row of scales per group, one row of moments per occupied cell)."""
    x = col(value)
    rows = df.filter(x.isNotNull() & col(grp).isNotNull()).select(col(grp).alias("grp"),
                                                                   x.cast("double").alias("_x"))
    stats = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
                                    F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    stats = materialize(stats)  # one row per group, read three times; joined by its size
    stats = with_one_row(stats, stats.agg(F.sum("_n").alias("_ntot")))
    stats = stats.filter((F.col("_n") > 1) & (F.col("_sd") > 0))
    stats = stats.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumn("_lo", F.col("_mn") - cut * F.col("_bw")).withColumn(
        "_hi", F.col("_mx") + cut * F.col("_bw"))
    placed = rows.join(stats, "grp")
    cell = F.floor((F.col("_x") - F.col("_mn")) / F.col("_bw"))
    placed = placed.select("grp", "_x", "_bw", "_mn", cell.alias("_cell"))
    centre = F.col("_mn") + (F.col("_cell") + 0.5) * F.col("_bw")
    # powers t^1, t^2, t^4, ... and their products
    placed = placed.select("grp", "_cell", ((F.col("_x") - centre) / F.col("_bw")).alias("_t1"))
    for k in (2, 4, 8, 16):
        placed = placed.withColumn(f"_t{k}", F.col(f"_t{k // 2}") * F.col(f"_t{k // 2}"))
    sums = []
    for k in range(KDE_TERMS):
        term = F.lit(1.0 / math.factorial(k))
        for b in (1, 2, 4, 8, 16):
            term = term * F.col(f"_t{b}") if k & b else term
        sums.append(F.sum(term).alias(f"_m{k}"))
    return stats, placed.groupBy("grp", "_cell").agg(*sums)


def kde_grid(df: DataFrame, grp: str, value: str, gridsize: int = 200, cut: float = 3.0,
             common_norm: bool = True) -> DataFrame:
    """Gaussian KDE per group on its own grid (Scott bandwidth sigma*n^-1/5,
    grid from min - cut*bw to max + cut*bw); with ``common_norm`` each curve
    is scaled by its group's share of all rows.

    A fast Gauss transform: the values' range is cut into cells of one
    bandwidth, a cell keeps the sums of t^k / k! of its values' distances t
    from its centre (in bandwidths, at most 1/2), and the kernel around a grid
    point u bandwidths away is sum t^k / k! He_k(u) exp(-u^2 / 2).  The rows
    are aggregated once, map-side, to at most ``KDE_TERMS`` numbers a cell.

    Error: |He_k(u)| exp(-u^2 / 4) <= 1.09 sqrt(k!), so the terms left out of
    one value's kernel (whose peak is 1) are at most 1.09 sum over k >= 20 of
    (1/2)^k / sqrt(k!) < 8e-16: an absolute error of 8e-16 / (bw sqrt(2 pi))
    of a density, below the rounding of the sums."""
    stats, cells = kde_cells(df, grp, value, gridsize, cut)
    ship_package(df.sparkSession)
    last = gridsize - 1
    stats = stats.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (gridsize - 1))

    def gx(i):
        return F.when(i == last, F.col("_hi")).otherwise(i.cast("double") * F.col("_step") + F.col("_lo"))
    d = cells.join(stats, "grp")
    centre = F.col("_mn") + (F.col("_cell") + 0.5) * F.col("_bw")
    moments = F.array(*[F.col(f"_m{k}") for k in range(KDE_TERMS)])
    parts = d.select("grp", F.posexplode(_hermite_sums(gridsize)(moments, centre, "_bw", "_lo", "_hi")).alias("i", "_v"))
    sums = parts.groupBy("grp", "i").agg(F.sum("_v").alias("_s"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i"))
    out = grid.join(sums, ["grp", "i"], "left")
    scale = F.col("_ntot") if common_norm else F.col("_n")
    dens = F.greatest(F.coalesce(F.col("_s"), F.lit(0.0)), F.lit(0.0)) / (scale * F.col("_bw") * math.sqrt(2 * math.pi))
    return out.select("grp", F.col("i").cast("int").alias("i"), gx(F.col("i")).alias("x"),
                      dens.alias("density"))


def histogram_columns(df: DataFrame, grp: str, values: Sequence[str], edges: Sequence[float], name: str = "column") -> DataFrame:
    """:func:`histogram_fixed` of several columns in one pass: one row per
    column, group and bin, zeros included.  A column without a value in a
    group has its bins there too, a null group is a group."""
    long = df.select(col(grp).alias("_grp"), *[col(c).cast("double").alias(c) for c in values]).unpivot(
        ["_grp"], [col(c) for c in values], "_name", "_value")
    # one key of both, kept apart again below
    both = long.select(F.struct(F.col("_name").alias("name"), F.col("_grp").alias("grp")).alias("_key"), "_value")
    return histogram_fixed(both, "_key", "_value", edges).select(
        F.col("grp.name").alias(name), F.col("grp.grp").alias("grp"), "bin", "lo", "hi", "count")
