"""Descriptive aggregates: group describe, group means, percentiles, class
balance, pairwise-complete correlation matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.operators import quantiles
from ratestat.operators.common import col
from ratestat.operators.moments import pairwise_moments, unpack_pairs


def group_describe(df: DataFrame, grp: str, value: str, quantile_method: str | None = None) -> DataFrame:
    """Per group: n, mean, sample variance (ddof 1) and exact median.

    Moments come from one partial+final aggregation; the median from
    :func:`ratestat.operators.quantiles.group_quantiles` (distributed exact by
    default); the two k-row results are joined on the group."""
    v = col(value)
    rows = df.filter(v.isNotNull() & col(grp).isNotNull())
    moments = rows.groupBy(col(grp).alias("_g")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    med = quantiles.group_quantiles(rows.select(col(grp).alias("_g"), v.alias("_v")), ["_g"], "_v",
                                    [0.5], ["median"], quantile_method)
    return moments.join(med, "_g", "left").withColumnRenamed("_g", grp)


def group_mean(df: DataFrame, key: str, value: str, out: str = "mean") -> DataFrame:
    """Mean by key; null keys are dropped (pandas groupby)."""
    return (df.filter(col(key).isNotNull()).groupBy(col(key))
            .agg(F.avg(col(value)).alias(out)))


def group_percentiles(df: DataFrame, grp: str | None, value: str,
                      probs: Sequence[float], names: Sequence[str],
                      quantile_method: str | None = None) -> DataFrame:
    """Linear-interpolation percentiles (NumPy default) per group, exact."""
    return quantiles.group_quantiles(df, [grp] if grp else [], value, probs, names, quantile_method)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).filter(col(column).isNotNull()).distinct()


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations, pairwise complete, long form ``(row, col, r)``:
    each pair over the rows where both values exist, all pairs from one pass
    of block accumulators.  A column constant over a pair's rows, or a pair
    without rows, gives null."""
    cols = list(cols)

    def run(batches):
        for batch in batches:
            for state in batch.column("state"):
                m = unpack_pairs(state.values)
                live = (m["low"] < m["high"]) & (m["low"] < m["high"]).T
                size = np.sqrt(np.where(live, m["spread"] * m["spread"].T, 1))
                r = np.where(live & (size > 0), m["cross"] / np.where(size > 0, size, 1), np.nan).ravel()
                p = len(cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(p * p)), pa.array(r, mask=np.isnan(r))], names=["cell", "r"])
    found = pairwise_moments(df, cols).mapInArrow(run, "cell long, r double")
    cells = df.sparkSession.createDataFrame([(i * len(cols) + j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                                            "cell long, row string, col string")
    return cells.join(found, "cell", "left").select("row", "col", "r")


def min_max(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(col(value)).alias("vmin"), F.max(col(value)).alias("vmax"))
