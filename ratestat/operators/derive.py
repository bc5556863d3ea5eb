"""Derived columns: Bayesian shrinkage, ratio normalisation, row totals,
suffix stripping, dictionary lookup, thresholding and verdict text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratestat.operators import quantiles
from ratestat.operators.common import broadcast_if_small, col, sum_columns, with_one_row


def shrinkage_priors(df: DataFrame, value_cols: Sequence[str], n_col: str,
                     quantile_method: str | None = None) -> DataFrame:
    """One-row frame: unweighted mean of each value column (``_mu_i``) and the
    exact median of ``n`` (``_m``), the prior strength."""
    means = df.agg(*[F.avg(col(c)).alias(f"_mu{i}") for i, c in enumerate(value_cols)])
    med = quantiles.group_quantiles(df, [], n_col, [0.5], ["_m"], quantile_method)
    return with_one_row(means, med)


def bayes_adjust(df: DataFrame, value_cols: Sequence[str], n_col: str,
                 names: Sequence[str] | None = None,
                 quantile_method: str | None = None) -> DataFrame:
    """Shrink each value toward its global mean: ``(m*mu + n*x) / (m + n)``
    with ``mu`` the unweighted row mean and ``m`` the median of ``n``.

    The priors are a one-row aggregate attached by broadcast; no value is
    collected to the driver.  Division by zero yields null.
    """
    names = list(names or [f"{c} (Adjusted)" for c in value_cols])
    priors = shrinkage_priors(df, value_cols, n_col, quantile_method)
    joined = with_one_row(df, priors)
    n = col(n_col)
    m = F.col("_m")
    adjusted = [F.try_divide(m * F.col(f"_mu{i}") + n * col(c), m + n).alias(name)
                for i, (c, name) in enumerate(zip(value_cols, names))]
    return joined.select(*[col(c) for c in df.columns], *adjusted)


def normalize_by(df: DataFrame, cols: Sequence[str], denom: str,
                 suffix: str = " (Normalized)") -> DataFrame:
    """``c / denom`` for every column in one projection (null on zero)."""
    d = col(denom)
    return df.select("*", *[F.try_divide(col(c), d).alias(f"{c}{suffix}") for c in cols])


def row_total(cols: Sequence[str]) -> Column:
    """Null-skipping row sum; all-null gives 0 (pandas ``sum(axis=1)``)."""
    return sum_columns([F.coalesce(col(c), F.lit(0.0)) for c in cols])


def tag_totals(df: DataFrame, tag_cols: Sequence[str], n_col: str,
               total: str = "Total Number of Tags",
               per_rating: str = "Average Tags per Rating") -> DataFrame:
    t = row_total(tag_cols)
    return df.select("*", t.alias(total), F.try_divide(t, col(n_col)).alias(per_rating))


def strip_suffix(c: Column | str, suffix: str) -> Column:
    """Remove every literal occurrence of ``suffix``."""
    return F.replace(col(c) if isinstance(c, str) else c, F.lit(suffix), F.lit(""))


def lookup(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str,
           out: str | None = None, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Dictionary lookup as a left join; unmapped keys give null.  The map is
    broadcast only after its size is checked."""
    small = broadcast_if_small(
        mapping.select(col(map_key).alias("_k"), col(map_value).alias(out or map_value)),
        max_broadcast_rows)
    return df.join(small, col(key) == F.col("_k"), "left").drop("_k")


def map_literal(mapping: dict[str, str]) -> Column:
    """A Python dict as a MapType literal (for fixed, small dictionaries)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def threshold_labels(score: Column | str, threshold: float | Column,
                     inclusive: bool = False) -> Column:
    """0/1 label: strictly ``score > t`` by default, ``>=`` if inclusive."""
    s = col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (s >= t if inclusive else s > t).cast("int")


def verdict(p: Column | str, alpha: float, boundary: str = "le",
            yes: str = "significant", no: str = "not significant") -> Column:
    """Decision text; ``boundary`` is 'le' (p <= alpha) or 'lt' (p < alpha),
    the two conventions used by the original analysis."""
    pc = col(p) if isinstance(p, str) else p
    hit = pc <= alpha if boundary == "le" else pc < alpha
    return F.when(hit, F.lit(yes)).otherwise(F.lit(no))
