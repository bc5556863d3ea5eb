"""Driver queries for chart data (histograms, box, KDE) and positional
binding, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratestat.operators import chartdata, derive, describe, quantiles
from ratestat.plans import profiles as P
from ratestat.plans.common import sql_round
from ratestat.plans.q_clean import NORM, grouped_profile, grouped_sql
from ratestat.plans.q_tests import mwu_tags_sql, q_top_bottom_k
from ratestat.sources.positional import positional_bind
from ratestat.sources.tables import read_table

TAG_EDGES = chartdata.arange_edges(-0.05, 1.15, 0.1)
HIST_TAG = "tag_r (Normalized)"
AUTO_BINS = 30


def q_hist_fixed(spark, d):
    g = grouped_profile(spark, d).filter(F.col(P.N) >= 3)
    return chartdata.histogram_fixed(g, "grp", HIST_TAG, TAG_EDGES)


def q_hist_six_tags(spark, d):
    """The tags with the three least and the three greatest p-values."""
    tags = q_top_bottom_k(spark, d).select("tag").toArrow().column("tag").to_pylist()  # six rows
    g = grouped_profile(spark, d).filter(F.col(P.N) >= 3)
    found = chartdata.histogram_columns(g, "grp", [t + NORM for t in tags], TAG_EDGES, "tag")
    return found.withColumn("tag", derive.strip_suffix(F.col("tag"), NORM))


UNEQUAL_EDGES = [0.0, 1.0, 5.0, 20.0, 48.5, 50.0]


def q_hist_unequal(spark, d):
    """Quantities on edges of unequal widths, rows without a group included."""
    li = read_table(spark, d, "lineitem", "l_returnflag", "l_quantity")
    li = li.select(F.expr("nullif(l_returnflag, 'N')").alias("grp"), "l_quantity")
    return chartdata.histogram_fixed(li, "grp", "l_quantity", UNEQUAL_EDGES)


def q_quantile_null_group(spark, d):
    """Quartiles, one of the groups being null."""
    li = read_table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    li = li.select(F.expr("nullif(l_returnflag, 'N')").alias("grp"), "l_extendedprice")
    return quantiles.group_quantiles(li, ["grp"], "l_extendedprice", [0.25, 0.5, 0.75], ["q1", "median", "q3"])


def q_corr_constant(spark, d):
    """Correlations with a constant column and one that has nulls."""
    li = read_table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount")
    li = li.select("l_quantity", "l_extendedprice", F.lit(0.1).alias("constant"),
                   F.expr("nullif(l_discount, 0.0D)").alias("discount"))
    return describe.corr_matrix(li, ["l_quantity", "l_extendedprice", "constant", "discount"])


def q_hist_auto(spark, d):
    li = read_table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    return chartdata.histogram_auto(li, "l_returnflag", "l_extendedprice", AUTO_BINS, density=True)


def q_box_stats(spark, d):
    li = read_table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    return chartdata.box_stats(li, "l_returnflag", "l_extendedprice")


def q_box_outliers(spark, d):
    ev = read_table(spark, d, "events", "event_id", "event_type", "value")
    return chartdata.box_outliers(ev, "event_type", "value")


def q_kde_grid(spark, d):
    return chartdata.kde_grid(grouped_profile(spark, d), "grp", "difficulty_adj")


def q_positional_bind(spark, d):
    part = read_table(spark, d, "part", "p_partkey", "p_name")
    supp = read_table(spark, d, "supplier", "s_suppkey", "s_name")
    return positional_bind(part, supp)


QUERIES = {
    "hist_unequal": q_hist_unequal,
    "quantile_null_group": q_quantile_null_group,
    "corr_constant": q_corr_constant,
    "hist_fixed": q_hist_fixed,
    "hist_six_tags": q_hist_six_tags,
    "hist_auto": q_hist_auto,
    "box_stats": q_box_stats,
    "box_outliers": q_box_outliers,
    "kde_grid": q_kde_grid,
    "positional_bind": q_positional_bind,
}


def _edges_values(edges):
    return ", ".join(f"({k}, {float(e)!r}::DOUBLE, {float(edges[k + 1])!r}::DOUBLE)"
                     for k, e in enumerate(edges[:-1]))


HIST_FIXED_SQL = f"""WITH b(bin, lo, hi) AS (VALUES {_edges_values(TAG_EDGES)}),
 v AS (SELECT grp, "{HIST_TAG}" AS x FROM {grouped_sql()} _g WHERE n_ratings >= 3),
 g AS (SELECT DISTINCT grp FROM v)
SELECT g.grp, b.bin, b.lo, b.hi,
  (SELECT count(*) FROM v WHERE v.grp = g.grp AND v.x >= b.lo
     AND (v.x < b.hi OR (b.bin = {len(TAG_EDGES) - 2} AND v.x <= b.hi))) AS count
FROM g, b"""

_TAG_ROWS = " UNION ALL ".join(f"""SELECT grp, '{t}' AS tag, "{t}{NORM}" AS x FROM {grouped_sql()} _g WHERE n_ratings >= 3""" for t in P.TAGS)
HIST_SIX_SQL = f"""WITH b(bin, lo, hi) AS (VALUES {_edges_values(TAG_EDGES)}),
 r AS (SELECT tag, p_rank, count(*) OVER () AS n FROM ({mwu_tags_sql()}) _m),
 v AS (SELECT u.* FROM ({_TAG_ROWS}) u JOIN r ON u.tag = r.tag WHERE p_rank <= 3 OR p_rank > n - 3),
 g AS (SELECT DISTINCT tag, grp FROM v)
SELECT g.tag, g.grp, b.bin, b.lo, b.hi, count(v.x) AS count
FROM g CROSS JOIN b LEFT JOIN v ON v.tag = g.tag AND v.grp = g.grp AND v.x >= b.lo
  AND (v.x < b.hi OR (b.bin = {len(TAG_EDGES) - 2} AND v.x <= b.hi))
GROUP BY g.tag, g.grp, b.bin, b.lo, b.hi"""

HIST_AUTO_SQL = f"""WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
 s AS (SELECT grp, count(*) AS n,
          CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
          CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM r GROUP BY grp),
 s2 AS (SELECT *, (hi - lo) / {AUTO_BINS} AS step FROM s),
 f AS (SELECT r.grp, r.x, s2.*, CAST(trunc((r.x - s2.lo) / (s2.hi - s2.lo) * {AUTO_BINS}) AS INTEGER) AS f0
       FROM r JOIN s2 USING (grp)),
 f1 AS (SELECT *, CASE WHEN f0 = {AUTO_BINS} THEN {AUTO_BINS - 1} ELSE f0 END AS f FROM f),
 k1 AS (SELECT *, CASE WHEN x < (CASE WHEN f >= {AUTO_BINS} THEN hi ELSE f * step + lo END) THEN f - 1 ELSE f END AS k FROM f1),
 k2 AS (SELECT grp, CASE WHEN k <> {AUTO_BINS - 1} AND x >= (CASE WHEN k + 1 >= {AUTO_BINS} THEN hi ELSE (k + 1) * step + lo END)
                      THEN k + 1 ELSE k END AS bin FROM k1),
 c AS (SELECT grp, bin, count(*) AS cnt FROM k2 GROUP BY grp, bin),
 grid AS (SELECT s2.*, b.bin FROM s2, range({AUTO_BINS}) b(bin))
SELECT grid.grp, CAST(grid.bin AS INTEGER) AS bin,
  CASE WHEN grid.bin >= {AUTO_BINS} THEN hi ELSE grid.bin * step + lo END AS lo,
  CASE WHEN grid.bin + 1 >= {AUTO_BINS} THEN hi ELSE (grid.bin + 1) * step + lo END AS hi,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
  coalesce(c.cnt, 0) / (n * ((CASE WHEN grid.bin + 1 >= {AUTO_BINS} THEN hi ELSE (grid.bin + 1) * step + lo END)
                            - (CASE WHEN grid.bin >= {AUTO_BINS} THEN hi ELSE grid.bin * step + lo END))) AS density
FROM grid LEFT JOIN c ON grid.grp = c.grp AND grid.bin = c.bin"""

BOX_SQL = """WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem
            WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL),
 q AS (SELECT grp, quantile_cont(x, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(x, CAST(0.5 AS DOUBLE)) AS median,
         quantile_cont(x, CAST(0.75 AS DOUBLE)) AS q3 FROM r GROUP BY grp),
 l AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l.grp, l.q1, l.median, l.q3, count(*) AS n, avg(r.x) AS mean,
  min(r.x) FILTER (WHERE r.x >= l.lo AND r.x <= l.hi) AS whisker_lo,
  max(r.x) FILTER (WHERE r.x >= l.lo AND r.x <= l.hi) AS whisker_hi,
  count(*) FILTER (WHERE NOT (r.x >= l.lo AND r.x <= l.hi)) AS n_outliers
FROM r JOIN l USING (grp) GROUP BY l.grp, l.q1, l.median, l.q3"""

KDE_SQL = f"""WITH r AS (SELECT grp, difficulty_adj AS x FROM {grouped_sql()} _g WHERE difficulty_adj IS NOT NULL),
 s AS (SELECT grp, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM r GROUP BY grp),
 t AS (SELECT count(*) AS ntot FROM r),
 s2 AS (SELECT s.*, t.ntot, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM s, t WHERE n > 1 AND sd > 0),
 s3 AS (SELECT *, mn - 3 * bw AS lo, mx + 3 * bw AS hi FROM s2),
 s4 AS (SELECT *, (hi - lo) / 199 AS step FROM s3),
 grid AS (SELECT s4.*, CAST(i AS INTEGER) AS i,
            CASE WHEN i = 199 THEN hi ELSE i * step + lo END AS gx FROM s4, range(200) g(i))
SELECT grid.grp, grid.i, grid.gx AS x,
  sum(exp(-0.5 * ((grid.gx - r.x) / grid.bw) * ((grid.gx - r.x) / grid.bw))) / (grid.ntot * grid.bw * sqrt(2 * pi())) AS density
FROM grid JOIN r ON grid.grp = r.grp GROUP BY grid.grp, grid.i, grid.gx, grid.ntot, grid.bw"""

POS_SQL = """SELECT coalesce(a.row_idx, b.row_idx) AS row_idx, a.p_partkey, a.p_name, b.s_suppkey, b.s_name
FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx FROM part) a
FULL OUTER JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx FROM supplier) b
ON a.row_idx = b.row_idx"""

_EDGE_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(UNEQUAL_EDGES, UNEQUAL_EDGES[1:])))
_LAST = len(UNEQUAL_EDGES) - 2
HIST_UNEQUAL_SQL = f"""WITH e(bin, lo, hi) AS (VALUES {_EDGE_ROWS}),
 r AS (SELECT nullif(l_returnflag, 'N') AS grp, l_quantity AS x FROM lineitem),
 g AS (SELECT DISTINCT grp FROM r)
SELECT g.grp, CAST(e.bin AS INTEGER) AS bin, CAST(e.lo AS DOUBLE) AS lo, CAST(e.hi AS DOUBLE) AS hi,
  (SELECT count(*) FROM r WHERE r.grp IS NOT DISTINCT FROM g.grp AND r.x >= e.lo
     AND (r.x < e.hi OR (e.bin = {_LAST} AND r.x = e.hi))) AS "count"
FROM g, e"""

QUANTILE_NULL_SQL = """SELECT nullif(l_returnflag, 'N') AS grp,
  quantile_cont(l_extendedprice, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)) AS median,
  quantile_cont(l_extendedprice, CAST(0.75 AS DOUBLE)) AS q3
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1"""

_CORR = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "constant": "NULL",
         "discount": "nullif(l_discount, 0.0)"}
CORR_CONSTANT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS \"row\", '{b}' AS \"col\", "
    + (f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" if "NULL" not in (x, y) else "CAST(NULL AS DOUBLE)")
    + " AS r FROM lineitem" for a, x in _CORR.items() for b, y in _CORR.items())
CORR_CONSTANT_SQL = f"SELECT DISTINCT * FROM (\n{CORR_CONSTANT_SQL}\n)"

SQL = {
    "hist_unequal": sql_round(HIST_UNEQUAL_SQL, ["lo", "hi"]),
    "quantile_null_group": sql_round(QUANTILE_NULL_SQL, ["q1", "median", "q3"]),
    "corr_constant": sql_round(CORR_CONSTANT_SQL, ["r"]),
    "hist_fixed": sql_round(HIST_FIXED_SQL, ["lo", "hi"]),
    "hist_six_tags": sql_round(HIST_SIX_SQL, ["lo", "hi"]),
    "hist_auto": sql_round(HIST_AUTO_SQL, ["lo", "hi", "density"]),
    "box_outliers": sql_round("""WITH q AS (SELECT event_type AS g,
    quantile_cont(value, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(value, CAST(0.75 AS DOUBLE)) AS q3
  FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value FROM events e JOIN q ON e.event_type = q.g
WHERE e.value < q.q1 - 1.5 * (q.q3 - q.q1) OR e.value > q.q3 + 1.5 * (q.q3 - q.q1)""", ["value"]),
    "box_stats": sql_round(BOX_SQL, ["q1", "median", "q3", "mean", "whisker_lo", "whisker_hi"]),
    "kde_grid": sql_round(KDE_SQL, ["x", "density"]),
    "positional_bind": POS_SQL,
}
