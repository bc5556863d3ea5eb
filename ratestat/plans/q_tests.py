"""Driver queries for hypothesis tests, rank tests, effect sizes and the
bootstrap, with DuckDB oracles (p-values by quadrature in SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratestat.functions.constants import ALPHA, SEED
from ratestat.functions.hashing import DRAW_BITS, mix_keys, mix_sql
from ratestat.operators import derive, effects, hypothesis
from ratestat.plans import profiles as P
from ratestat.plans.common import log_tail_sql, qi, sql_round, tail_sql
from ratestat.plans.q_clean import (NORM, NORM_TAGS, STUDENT_DF, STUDENT_T, WELCH_DF, WELCH_T,
                                    _t_p, grouped_profile, grouped_sql, levene_sql,
                                    moments_pair_sql, profile_inputs, qi_spark)
from ratestat.session import shared_table
from ratestat.sources.tables import read_table
from ratestat.operators.common import with_one_row
from ratestat.operators.effects import POISSON_LIMITS

BOOT_B = 5000         # replicates
BOOT_M = 10000        # draws per group for the m-out-of-n bootstrap


def _lineitem(spark, d, *cols):
    return read_table(spark, d, "lineitem", "l_returnflag", *cols)


def q_levene(spark, d):
    return hypothesis.levene(_lineitem(spark, d, "l_extendedprice"), "l_returnflag",
                             "l_extendedprice")


def q_ttest_pooled(spark, d):
    return hypothesis.ttest(_lineitem(spark, d, "l_extendedprice"), "l_returnflag",
                            "l_extendedprice", "A", "R", equal_var=True, alternative="greater")


def q_ttest_welch(spark, d):
    return hypothesis.ttest(_lineitem(spark, d, "l_extendedprice"), "l_returnflag",
                            "l_extendedprice", "A", "R", equal_var=False, alternative="two-sided")


def _halves(spark, d):
    """Line items by a group that the value itself decides: statistics whose
    p-values are below the least double."""
    return read_table(spark, d, "lineitem", "l_quantity").select(
        "l_quantity", F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("half"),
        F.floor(F.col("l_quantity") / 10).alias("tenth"))


def q_ttest_underflow(spark, d):
    return hypothesis.ttest(_halves(spark, d), "half", "l_quantity", "high", "low", equal_var=True)


def q_welch_underflow(spark, d):
    return hypothesis.ttest(_halves(spark, d), "half", "l_quantity", "high", "low", equal_var=False, alternative="greater")


def q_anova_underflow(spark, d):
    return hypothesis.anova(_halves(spark, d), "tenth", "l_quantity")


def q_mwu_single(spark, d):
    return hypothesis.mannwhitney(_lineitem(spark, d, "l_quantity"), "l_returnflag",
                                  "l_quantity", "A", "R")


def mwu_tags_frame(spark, d):
    g = grouped_profile(spark, d).filter(F.col(P.N) >= 3)
    long = g.select("grp", *[F.col(qi_spark(c)) for c in NORM_TAGS]).unpivot(
        ["grp"], [F.col(qi_spark(c)) for c in NORM_TAGS], "column_name", "value")
    long = long.filter(F.col("value") <= 1.01)
    res = hypothesis.mannwhitney(long, "grp", "value", "A", "B", by=["column_name"])
    w = Window.orderBy(F.col("log10_p").asc_nulls_last(), F.col("column_name"))
    # the frame has one row per tested column (20 at most): a global window is fine
    return res.select(
        derive.strip_suffix(F.col("column_name"), NORM).alias("tag"), "u1", "n1", "n2", "z",
        "p_value", "log10_p", derive.verdict(F.col("p_value"), ALPHA, "le").alias("verdict"),
        F.row_number().over(w).cast("long").alias("p_rank"))


def q_mwu_tags(spark, d):
    return mwu_tags_frame(spark, d)


def q_top_bottom_k(spark, d, k: int = 3):
    res = mwu_tags_frame(spark, d)
    total = res.agg(F.count(F.lit(1)).alias("_n"))
    both = with_one_row(res, total)
    return both.filter((F.col("p_rank") <= k) | (F.col("p_rank") > F.col("_n") - k)).select(
        F.when(F.col("p_rank") <= k, F.lit("most")).otherwise(F.lit("least")).alias("side"),
        "p_rank", "tag", "p_value", "log10_p")


def q_cohens_d(spark, d):
    return effects.cohens_d(_lineitem(spark, d, "l_extendedprice"), "l_returnflag",
                            "l_extendedprice", "A", "R")


def q_variance_ratio(spark, d):
    return effects.variance_ratio(_lineitem(spark, d, "l_extendedprice"), "l_returnflag",
                                  "l_extendedprice", "A", "R")


def _reps_mn(spark, d):
    """The m-out-of-n replicates, drawn once: the interval reads them too."""
    return shared_table(spark, ("bootstrap_mn", d), lambda: effects.bootstrap_replicates(
        grouped_profile(spark, d), "grp", "rating_adj", P.KEY, ["A", "B"], BOOT_B, BOOT_M, SEED), profile_inputs(d))


def q_bootstrap_mn(spark, d):
    return _reps_mn(spark, d).select("rep", "mean1", "var1", "mean2", "var2")


def q_bootstrap_nn(spark, d):
    reps = effects.bootstrap_replicates(grouped_profile(spark, d), "grp", "difficulty_adj", P.KEY,
                                        ["A", "B"], BOOT_B, None, SEED)
    return effects.bootstrap_effects(reps).select("rep", "d_pooled")


def q_bootstrap_poisson(spark, d):
    reps = effects.poisson_replicates(grouped_profile(spark, d), "grp", "difficulty_adj", P.KEY,
                                      ["A", "B"], BOOT_B, SEED)
    return reps.select("rep", "n1", "mean1", "var1", "n2", "mean2", "var2")


def q_bootstrap_ci(spark, d):
    return effects.bootstrap_ci(effects.bootstrap_effects(_reps_mn(spark, d)),
                                ["d_average", "var_ratio"])


QUERIES = {
    "levene": q_levene,
    "ttest_pooled": q_ttest_pooled,
    "ttest_welch": q_ttest_welch,
    "ttest_underflow": q_ttest_underflow,
    "welch_underflow": q_welch_underflow,
    "anova_underflow": q_anova_underflow,
    "mwu_single": q_mwu_single,
    "mwu_tags": q_mwu_tags,
    "top_bottom_k": q_top_bottom_k,
    "cohens_d": q_cohens_d,
    "variance_ratio": q_variance_ratio,
    "bootstrap_mn": q_bootstrap_mn,
    "bootstrap_nn": q_bootstrap_nn,
    "bootstrap_poisson": q_bootstrap_poisson,
    "bootstrap_ci": q_bootstrap_ci,
}


# ------------------------------------------------------------ SQL oracles
LI = "lineitem"


def ttest_sql(first, second, equal_var, alternative) -> str:
    t, dfr = (STUDENT_T, STUDENT_DF) if equal_var else (WELCH_T, WELCH_DF)
    return f"""WITH pm AS (SELECT * FROM {moments_pair_sql(LI, "l_returnflag", "l_extendedprice", first, second)} _p),
 t AS (SELECT n1, n2, m1, m2, v1, v2, {t} AS t, CAST({dfr} AS DOUBLE) AS df FROM pm),
 tl AS ({tail_sql("t", [], "t", "abs(t)", "df")})
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, m1 AS mean1, m2 AS mean2, v1 AS var1,
  v2 AS var2, t.t, t.df, {_t_p(alternative, "t.t", "tl.tail")} AS p_value,
  log10({_t_p(alternative, "t.t", "tl.tail")}) AS log10_p
FROM t, tl"""


HALVES = """(SELECT l_quantity, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS half,
   floor(l_quantity / 10) AS tenth FROM lineitem)"""


def ttest_log_sql(equal_var, sides) -> str:
    """The t-test of the halves with its p-value from the log tail."""
    t, dfr = (STUDENT_T, STUDENT_DF) if equal_var else (WELCH_T, WELCH_DF)
    return f"""WITH pm AS (SELECT * FROM {moments_pair_sql(HALVES, "half", "l_quantity", "high", "low")} _p),
 t AS (SELECT n1, n2, m1, m2, v1, v2, {t} AS t, CAST({dfr} AS DOUBLE) AS df FROM pm),
 tl AS ({log_tail_sql("t", "t", "abs(t)", "df")})
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, m1 AS mean1, m2 AS mean2, v1 AS var1,
  v2 AS var2, t.t, t.df, {sides} * exp(log_tail) AS p_value, (log_tail + ln({sides})) / ln(10) AS log10_p
FROM t, tl"""


ANOVA_LOG_SQL = f"""WITH g AS (SELECT tenth, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss
   FROM {HALVES} _h GROUP BY tenth),
 s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n_total, sum(n * m) / sum(n) AS grand, sum(ss) AS ssw FROM g),
 f AS (SELECT k, n_total, (SELECT sum(n * (m - grand) * (m - grand)) FROM g) AS ssb, ssw FROM s),
 w AS (SELECT *, (ssb / (k - 1)) / (ssw / (n_total - k)) AS f_stat, CAST(k - 1 AS DOUBLE) AS df_between,
         CAST(n_total - k AS DOUBLE) AS df_within FROM f),
 tl AS ({log_tail_sql("w", "f", "f_stat", "df_between", "df_within")})
SELECT k, n_total, ssb, ssw, f_stat, df_between, df_within, exp(log_tail) AS p_value, log_tail / ln(10) AS log10_p FROM w, tl"""


def mwu_sql(src: str, grp: str, value: str, first: str, second: str, by: str | None) -> str:
    """Rank-sum oracle with a plain ordered window (fine for a small oracle)."""
    bsel = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    keys = [by] if by else []
    return f"""WITH c AS (SELECT {bsel}{value} AS value,
      CAST(count(*) FILTER (WHERE {grp} = '{first}') AS DOUBLE) AS c1,
      CAST(count(*) FILTER (WHERE {grp} = '{second}') AS DOUBLE) AS c2
    FROM {src} _s WHERE {value} IS NOT NULL AND {grp} IN ('{first}', '{second}') GROUP BY {bsel}{value}),
 cu AS (SELECT *, sum(c2) OVER ({part}ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum2 FROM c),
 s AS (SELECT {bsel}sum(c1 * (cum2 - c2 * 0.5)) AS u1, sum(c1) AS n1, sum(c2) AS n2,
        sum((c1 + c2) * (c1 + c2) * (c1 + c2) - (c1 + c2)) AS tie_term FROM cu {gb}),
 z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5)
        / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s),
 tl AS ({tail_sql("z", keys, "norm", "abs(z)")})
SELECT {("z." + by + ", ") if by else ""}z.u1, CAST(z.n1 AS BIGINT) AS n1, CAST(z.n2 AS BIGINT) AS n2,
  z.tie_term, z.z,
  CASE WHEN z.z > 0 THEN least(1.0, 2 * tl.tail) ELSE 1.0 END AS p_value,
  'asymptotic' AS method,
  log10(CASE WHEN z.z > 0 THEN least(1.0, 2 * tl.tail) ELSE 1.0 END) AS log10_p
FROM z JOIN tl ON {("z." + by + " = tl." + by) if by else "TRUE"}"""


def mwu_tags_sql() -> str:
    union = "\n  UNION ALL\n  ".join(
        f"SELECT grp, '{c}' AS column_name, {qi(c)} AS value FROM {grouped_sql()} _g WHERE n_ratings >= 3"
        for c in NORM_TAGS)
    src = f"(SELECT * FROM ({union}) _u WHERE value <= 1.01)"
    base = mwu_sql(src, "grp", "value", "A", "B", "column_name")
    return f"""SELECT replace(column_name, '{NORM}', '') AS tag, u1, n1, n2, z, p_value, log10_p,
  CASE WHEN p_value <= {ALPHA} THEN 'significant' ELSE 'not significant' END AS verdict,
  row_number() OVER (ORDER BY p_value ASC NULLS LAST, column_name) AS p_rank
FROM ({base}) _m"""


def _h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


_WIDE = """SELECT rep, {cols} FROM st GROUP BY rep""".format(cols=", ".join(
    f"max({c}) FILTER (WHERE grp = '{g}') AS {c}{i}" for i, g in ((1, "A"), (2, "B")) for c in ("n", "mean", "var")))


def _boot_rows(value: str) -> str:
    return f"""rws AS (SELECT grp, {_h(f"'{SEED}:' || CAST(p_partkey AS VARCHAR)")} AS h, p_partkey AS k, {value} AS x
        FROM {grouped_sql()} _g WHERE {value} IS NOT NULL AND grp IN ('A', 'B'))"""


def boot_reps_sql(value: str, draws: int | None) -> str:
    m = draws or "s.n"
    high, low = (mix_sql("id", mix_keys(SEED, lane)) for lane in ("high", "low"))
    rows = f"""(SELECT s.grp, s.n AS total, r.rep, CASE WHEN s.grp = 'A' THEN 0 ELSE {BOOT_B} * {draws or "na"} END
        + r.rep * {m} + dd.draw AS id FROM sizes s, range({BOOT_B}) r(rep),
        range({draws or "(SELECT max(n) FROM sizes)"}) dd(draw), (SELECT max(n) FILTER (WHERE grp = 'A') AS na FROM sizes)
      WHERE dd.draw < {m})"""
    return f"""WITH {_boot_rows(value)},
 ix AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY h, k) - 1 AS idx FROM rws),
 sizes AS (SELECT grp, count(*) AS n FROM rws GROUP BY grp),
 pk AS (SELECT grp, rep, ((({high}) << {DRAW_BITS}) + ({low})) % total AS idx FROM {rows}),
 st AS (SELECT pk.rep, pk.grp, CAST(count(*) AS DOUBLE) AS n, avg(ix.x) AS mean, var_samp(ix.x) AS var
        FROM pk JOIN ix ON pk.grp = ix.grp AND pk.idx = ix.idx GROUP BY pk.rep, pk.grp)
{_WIDE}"""


def boot_poisson_sql(value: str) -> str:
    row, draw = mix_keys(SEED, "row"), mix_keys(SEED, "poisson")
    u = f"""(SELECT grp, x, rep, {mix_sql(f"m + (rep << {DRAW_BITS})", draw)} AS u
      FROM (SELECT grp, x, {mix_sql("h", row)} AS m FROM rws), range({BOOT_B}) r(rep))"""
    weight = " ".join(f"WHEN u >= {limit} THEN {i + 1}" for i, limit in reversed(list(enumerate(POISSON_LIMITS))))
    return f"""WITH {_boot_rows(value)},
 c AS (SELECT grp, avg(x) AS c FROM rws GROUP BY grp),
 w AS (SELECT u.grp, u.rep, c.c, u.x - c.c AS z, CAST(CASE {weight} ELSE 0 END AS DOUBLE) AS w
       FROM {u} u JOIN c ON u.grp = c.grp),
 sm AS (SELECT rep, grp, max(c) AS c, sum(w) AS n, sum(w * z) AS s1, sum(w * z * z) AS s2 FROM w GROUP BY rep, grp),
 st AS (SELECT rep, grp, n, c + s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) AS var FROM sm)
{_WIDE}"""


D_POOLED = "(mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))"
D_AVG = "(mean1 - mean2) / sqrt((var1 + var2) / 2)"

_TT = ["mean1", "mean2", "var1", "var2", "t", "df", "p_value", "log10_p"]
_MWU = ["u1", "tie_term", "z", "p_value", "log10_p"]

SQL = {
    "levene": sql_round(
        levene_sql(LI, "l_returnflag", "l_extendedprice").replace(
            "f.f_stat, f.df_between", "f.f_stat AS w_stat, f.df_between"),
        ["ssb", "ssw", "w_stat", "df_between", "df_within", "p_value", "log10_p"]),
    "ttest_pooled": sql_round(ttest_sql("A", "R", True, "greater"), _TT),
    "ttest_welch": sql_round(ttest_sql("A", "R", False, "two-sided"), _TT),
    "ttest_underflow": sql_round(ttest_log_sql(True, 2), _TT),
    "welch_underflow": sql_round(ttest_log_sql(False, 1), _TT),
    "anova_underflow": sql_round(ANOVA_LOG_SQL, ["ssb", "ssw", "f_stat", "df_between", "df_within", "p_value", "log10_p"]),
    "mwu_single": sql_round(mwu_sql(LI, "l_returnflag", "l_quantity", "A", "R", None), _MWU),
    "mwu_tags": sql_round(mwu_tags_sql(), ["u1", "z", "p_value", "log10_p"]),
    "top_bottom_k": sql_round(f"""SELECT CASE WHEN p_rank <= 3 THEN 'most' ELSE 'least' END AS side,
  p_rank, tag, p_value, log10_p FROM ({mwu_tags_sql()}) m
WHERE p_rank <= 3 OR p_rank > (SELECT count(*) FROM ({mwu_tags_sql()}) m2) - 3""",
                              ["p_value", "log10_p"]),
    "cohens_d": sql_round(f"""SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, m1 - m2 AS mean_diff,
  (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d_pooled,
  (m1 - m2) / sqrt((v1 + v2) / 2) AS d_average
FROM {moments_pair_sql(LI, "l_returnflag", "l_extendedprice", "A", "R")} _p""",
                          ["mean_diff", "d_pooled", "d_average"]),
    "variance_ratio": sql_round(f"""SELECT v1 AS var1, v2 AS var2, v1 / v2 AS var_ratio
FROM {moments_pair_sql(LI, "l_returnflag", "l_extendedprice", "A", "R")} _p""",
                                ["var1", "var2", "var_ratio"]),
    "bootstrap_mn": sql_round(f"SELECT rep, mean1, var1, mean2, var2 FROM ({boot_reps_sql('rating_adj', BOOT_M)}) _b",
                              ["mean1", "var1", "mean2", "var2"]),
    "bootstrap_nn": sql_round(f"SELECT rep, {D_POOLED} AS d_pooled FROM ({boot_reps_sql('difficulty_adj', None)}) _b",
                              ["d_pooled"]),
    "bootstrap_poisson": sql_round(boot_poisson_sql("difficulty_adj"), ["n1", "mean1", "var1", "n2", "mean2", "var2"]),
    "bootstrap_ci": sql_round(f"""WITH e AS (SELECT rep, {D_AVG} AS d_average, var1 / var2 AS var_ratio
   FROM ({boot_reps_sql('rating_adj', BOOT_M)}) _b),
 l AS (SELECT 'd_average' AS statistic, d_average AS v FROM e UNION ALL SELECT 'var_ratio', var_ratio FROM e)
SELECT statistic, avg(v) AS boot_mean, quantile_cont(v, CAST(0.025 AS DOUBLE)) AS ci_lo,
  quantile_cont(v, CAST(0.975 AS DOUBLE)) AS ci_hi,
  (quantile_cont(v, CAST(0.025 AS DOUBLE)) + quantile_cont(v, CAST(0.975 AS DOUBLE))) / 2 AS ci_mid
FROM l GROUP BY statistic""", ["boot_mean", "ci_lo", "ci_hi", "ci_mid"]),
}
