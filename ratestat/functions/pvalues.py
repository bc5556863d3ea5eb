"""Vectorised (Arrow) wrapper that turns statistic columns into p-values.

Neither Spark SQL nor its JVM helpers offer an accurate tiny tail, so this
pandas UDF runs the math of :mod:`ratestat.functions.tails`.  It is only
applied to final result rows (one per test), never below an aggregate.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ratestat.functions import tails
from ratestat.session import ship_package


@pandas_udf(StructType([StructField("p_value", DoubleType()), StructField("log10_p", DoubleType())]))
def _p_value_udf(kind: pd.Series, stat: pd.Series, df1: pd.Series,
                 df2: pd.Series) -> pd.DataFrame:
    out = []
    for k, s, a, b in zip(kind, stat, df1, df2):
        if s is None or pd.isna(s):
            out.append((None, None))
            continue
        a = None if a is None or pd.isna(a) else float(a)
        b = None if b is None or pd.isna(b) else float(b)
        log = tails.log_p(k, float(s), a, b)
        out.append((tails.p_value(k, float(s), a, b), log / math.log(10) if math.isfinite(log) else None))
    return pd.DataFrame(out, columns=["p_value", "log10_p"], dtype="float64")


def with_p_value(df: DataFrame, kind: str, stat: str, df1: str | None = None, df2: str | None = None) -> DataFrame:
    """``df`` with the columns p_value and log10_p of the statistic, for
    ``kind`` in {t_greater, t_less, t_two_sided, f_upper, norm_two_sided,
    norm_greater}.  The logarithm is the tail's own, so it exists where the
    p-value is below the least double; it is null where the statistic is null
    or infinite."""
    ship_package()
    values = [F.col(c).cast("double") if c else F.lit(None).cast("double") for c in (stat, df1, df2)]
    out = df.withColumn("_p", _p_value_udf(F.lit(kind), *values))
    return out.select(*[c for c in out.columns if c != "_p"], F.col("_p.p_value").alias("p_value"), F.col("_p.log10_p").alias("log10_p"))


def log10_normal_two_sided(z: Column, p: Column) -> Column:
    """log10 of a two-sided normal p-value, also where ``p`` has lost its
    digits or become 0: there the tail's asymptotic series at ``z``."""
    x = F.abs(z)
    v = 1 / (x * x)
    series = 1 - v * (1 - 3 * v * (1 - 5 * v * (1 - 7 * v)))
    log = -x * x / 2 - F.log(x) - F.lit(0.5 * math.log(2 * math.pi)) + F.log(series) + F.lit(math.log(2))
    return F.when(p > 1e-290, F.log10(p)).when(x > 30, log / F.lit(math.log(10)))


@pandas_udf(StructType([StructField("p_value", DoubleType()), StructField("method", StringType())]))
def _mwu_udf(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.DataFrame:
    ps, methods = [], []
    for a, b, c, d in zip(u1, n1, n2, ties):
        if any(x is None or pd.isna(x) for x in (a, b, c, d)):
            ps.append(None)
            methods.append(None)
            continue
        p, m = tails.mwu_p_two_sided(float(a), float(b), float(c), float(d))
        ps.append(p)
        methods.append(m)
    return pd.DataFrame({"p_value": pd.Series(ps, dtype="float64"), "method": methods})


def mwu_p_value(u1, n1, n2, tie_term) -> Column:
    """struct(p_value, method) for a two-sided Mann-Whitney test."""
    ship_package()
    return _mwu_udf(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
                      for c in (u1, n1, n2, tie_term)])
