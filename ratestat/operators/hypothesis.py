"""Two-group and k-group hypothesis tests from group sufficient statistics.

Every test is: one (or two) grouped aggregations over the rows -> a frame
with one row per group -> a closed-form statistic on a one-row frame -> a
tail probability computed on that final row.  The per-group frames
are written and joined back by the size of their files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratestat.functions.pvalues import log10_normal_two_sided, mwu_p_value, with_p_value
from ratestat.operators import quantiles, ranks
from ratestat.operators.common import col
from ratestat.operators.common import with_one_row
from ratestat.session import materialize


# ---------------------------------------------------------------- moments
def group_moments(df: DataFrame, grp: str, value: str) -> DataFrame:
    """Per group: n, mean, var (ddof 1) of the non-null values."""
    v = col(value)
    return (df.filter(v.isNotNull() & col(grp).isNotNull()).groupBy(col(grp).alias("grp"))
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")))


def pair_moments(moments: DataFrame, first, second) -> DataFrame:
    """Pivot two groups' moments into one row (n1, m1, v1, n2, m2, v2)."""
    def pick(label, c):
        return F.max(F.when(F.col("grp") == F.lit(label), F.col(c)))
    return moments.agg(
        pick(first, "n").cast("double").alias("n1"), pick(first, "mean").alias("m1"),
        pick(first, "var").alias("v1"),
        pick(second, "n").cast("double").alias("n2"), pick(second, "mean").alias("m2"),
        pick(second, "var").alias("v2"))


def _student(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    dfree = n1 + n2 - 2
    sp2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dfree)
    t = F.try_divide(m1 - m2, F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    return t, dfree


def _welch(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    dfree = F.try_divide((a + b) * (a + b),
                         F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    return t, dfree


_T_KIND = {"greater": "t_greater", "less": "t_less", "two-sided": "t_two_sided"}


def _cols(row_cols=("n1", "m1", "v1", "n2", "m2", "v2")):
    return [F.col(c) for c in row_cols]


def ttest(df: DataFrame, grp: str, value: str, first, second, equal_var: bool = True,
          alternative: str = "two-sided") -> DataFrame:
    """Student (pooled) or Welch t-test of ``first`` vs ``second``.

    One row: n1, n2, mean1, mean2, var1, var2, t, df, p_value, log10_p."""
    pm = pair_moments(group_moments(df, grp, value), first, second)
    t, dfree = (_student if equal_var else _welch)(*_cols())
    out = pm.select("*", t.alias("t"), dfree.cast("double").alias("df"))
    out = with_p_value(out, _T_KIND[alternative], "t", "df")
    return out.select(
        F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
        F.col("m1").alias("mean1"), F.col("m2").alias("mean2"),
        F.col("v1").alias("var1"), F.col("v2").alias("var2"),
        "t", "df", "p_value", "log10_p")


# ------------------------------------------------------------------ ANOVA
def anova_from_moments(moments: DataFrame) -> DataFrame:
    """One-way ANOVA from per-group (n, mean, var): F, df_between,
    df_within.  A group of one row contributes no within variance."""
    # one row per group, read twice (grand mean, then the sums around it)
    w = materialize(moments.select(
        F.col("n").cast("double").alias("n"), "mean",
        F.when(F.col("n") > 1, F.col("var")).otherwise(F.lit(0.0)).alias("var")))
    totals = w.agg(F.count(F.lit(1)).cast("double").alias("_k"), F.sum("n").alias("_ntot"),
                   F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_grand"))
    parts = with_one_row(w, totals).agg(
        F.first("_k").alias("_k"), F.first("_ntot").alias("_ntot"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    k, nt = F.col("_k"), F.col("_ntot")
    return parts.select(
        k.cast("long").alias("k"), nt.cast("long").alias("n_total"),
        "ssb", "ssw",
        F.try_divide(F.try_divide(F.col("ssb"), k - 1),
                     F.try_divide(F.col("ssw"), nt - k)).alias("f_stat"),
        (k - 1).alias("df_between"), (nt - k).alias("df_within"))


def _with_f_p(stats: DataFrame) -> DataFrame:
    return with_p_value(stats, "f_upper", "f_stat", "df_between", "df_within")


def anova(df: DataFrame, grp: str, value: str) -> DataFrame:
    """One-way ANOVA of ``value`` across the groups of ``grp`` (one pass)."""
    return _with_f_p(anova_from_moments(group_moments(df, grp, value)))


def levene(df: DataFrame, grp: str, value: str, center: str = "median",
           quantile_method: str | None = None) -> DataFrame:
    """Levene / Brown-Forsythe test: ANOVA on |x - center_g|.

    Around the exact median (the default) the moments of the distances come
    out of the two scans that find it; around the mean, or a sketched median
    (``quantile_method="approx"``), the centres are joined to the rows."""
    if center == "median" and quantile_method in (None, "exact"):
        return _levene_from(quantiles.median_moments(df, grp, value))
    v = col(value)
    rows = df.filter(v.isNotNull() & col(grp).isNotNull()).select(
        col(grp).alias("_g"), v.alias("_x"))
    if center == "median":
        centers = quantiles.group_quantiles(rows, ["_g"], "_x", [0.5], ["_c"], quantile_method)
    elif center == "mean":
        centers = rows.groupBy("_g").agg(F.avg("_x").alias("_c"))
    else:
        raise ValueError("center must be 'median' or 'mean'")
    z = rows.join(materialize(centers), "_g").select(
        "_g", F.abs(F.col("_x") - F.col("_c")).alias("_z"))
    stats = anova_from_moments(group_moments(z, "_g", "_z"))
    return _with_f_p(stats).withColumnRenamed("f_stat", "w_stat")


def _levene_from(moments: DataFrame) -> DataFrame:
    z = moments.select("grp", "n", F.col("z_mean").alias("mean"), F.col("z_var").alias("var"))
    return _with_f_p(anova_from_moments(z)).withColumnRenamed("f_stat", "w_stat")


def ttest_gated(df: DataFrame, grp: str, value: str, first, second, alpha: float = 0.005,
                alternative: str = "greater") -> DataFrame:
    """Levene first; pooled t if its p > alpha, else Welch.  One row with
    the Levene result, the chosen method and the t-test result.  Both tests
    use the moments of the same two scans."""
    moments = materialize(quantiles.median_moments(df, grp, value))  # one row a group
    lev = _levene_from(moments).select(F.col("w_stat").alias("levene_w"),
                                       F.col("p_value").alias("levene_p"))
    pm = pair_moments(moments, first, second)
    ts, dfs = _student(*_cols())
    tw, dfw = _welch(*_cols())
    both = with_one_row(pm, lev)
    pooled = F.col("levene_p") > alpha
    out = both.select(
        "levene_w", "levene_p",
        F.when(pooled, F.lit("student")).otherwise(F.lit("welch")).alias("method"),
        F.when(pooled, ts).otherwise(tw).alias("t"),
        F.when(pooled, dfs).otherwise(dfw).cast("double").alias("df"))
    return with_p_value(out, _T_KIND[alternative], "t", "df")


# ------------------------------------------------------------ Mann-Whitney
def mwu_stats(df: DataFrame, grp: str, value: str, first, second,
              by: Sequence[str] = (), n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """Mann-Whitney U of ``first`` vs ``second`` (per ``by`` group).

    Rows collapse to (by, value, n_first, n_second); U of the first sample
    is sum(n_first * (second-count below + n_second / 2)) from distributed
    prefix sums; the tie term sum(t^3 - t) comes from the same table."""
    g = col(grp)
    counts = ranks.collapse_counts(
        df.filter(g.isin(first, second)), list(by), value,
        {"c1": F.count_if(g == F.lit(first)).cast("double"),
         "c2": F.count_if(g == F.lit(second)).cast("double")})
    cum = ranks.prefix_sums(counts, list(by), "value", ["c2"], n_buckets=n_buckets)
    t = F.col("c1") + F.col("c2")
    per = cum.groupBy(*[col(b) for b in by]).agg(
        F.sum(F.col("c1") * (F.col("cum_c2") - F.col("c2") * 0.5)).alias("u1"),
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
        F.sum(t * t * t - t).alias("tie_term"))
    n = F.col("n1") + F.col("n2")
    mu = F.col("n1") * F.col("n2") / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12
                   * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    big_u = F.greatest(F.col("u1"), F.col("n1") * F.col("n2") - F.col("u1"))
    return per.select(
        *[col(b) for b in by], "u1", F.col("n1").cast("long").alias("n1"),
        F.col("n2").cast("long").alias("n2"), "tie_term",
        F.try_divide(big_u - mu - 0.5, sigma).alias("z"))


def mannwhitney(df: DataFrame, grp: str, value: str, first, second,
                by: Sequence[str] = (), n_buckets: int = ranks.DEFAULT_BUCKETS) -> DataFrame:
    """Two-sided Mann-Whitney test; exact for tiny tie-free samples,
    tie-corrected normal with continuity correction otherwise."""
    st = mwu_stats(df, grp, value, first, second, by, n_buckets)
    st = st.withColumn("_p", mwu_p_value("u1", "n1", "n2", "tie_term"))
    return st.select(*[c for c in st.columns if c != "_p"],
                     F.col("_p.p_value").alias("p_value"), F.col("_p.method").alias("method"),
                     log10_normal_two_sided(F.col("z"), F.col("_p.p_value")).alias("log10_p"))


def mannwhitney_columns(df: DataFrame, grp: str, value_cols: Sequence[str], first, second,
                        n_buckets: int = ranks.DEFAULT_BUCKETS, name_col: str = "tag") -> DataFrame:
    """The rank test repeated over many columns as ONE job: unpivot to
    (name, value) and run :func:`mannwhitney` grouped by name."""
    long = df.select(col(grp).alias("_grp"), *[col(c) for c in value_cols]).unpivot(
        ["_grp"], [col(c) for c in value_cols], name_col, "_value")
    return mannwhitney(long, "_grp", "_value", first, second, by=[name_col], n_buckets=n_buckets)
