"""Stand-in survey tables derived from the driver's TPC-H-like tables.

``part_profile``: one row per part, built from ``lineitem`` pre-aggregated on
``l_partkey`` (map-side partial aggregation, one shuffle on the part key) and
then joined to the projected ``part`` dimension.  Aggregating *before* the
join keeps the join input at one row per part instead of one per line item.

| survey role          | column        | expression                                 |
|----------------------|---------------|--------------------------------------------|
| number of ratings    | n_ratings     | count(*)                                   |
| rating               | rating        | avg(l_quantity), null when p_size % 17 = 0 |
| difficulty           | difficulty    | avg(round(l_discount * 100))               |
| group flags          | flag_a/flag_b | p_size % 2 = 0 / p_size % 3 = 0 (0/1)      |
| pepper               | pepper        | avg(l_quantity) > 25.5 (0/1)               |
| would take again     | again         | share of l_tax > 0.04, null when p_size % 10 = 0 |
| online ratings       | online        | count of l_linestatus = 'O'                |
| tags                 | tag_*         | counts per return flag / line status       |
| over-bound tag       | tag_over      | floor(sum(l_linenumber | flag R) / 2)      |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.sources.tables import read_table

KEY = "p_partkey"
N = "n_ratings"
RATING = "rating"
DIFFICULTY = "difficulty"
AGAIN = "again"
ONLINE = "online"
PEPPER = "pepper"
FLAG_A = "flag_a"
FLAG_B = "flag_b"
FIELD = "p_brand"
KIND = "p_type"

# (column, return flag, line status); None = any
_TAG_SPECS = [
    ("tag_r", "R", None), ("tag_a", "A", None), ("tag_n", "N", None),
    ("tag_o", None, "O"), ("tag_f", None, "F"),
    ("tag_ro", "R", "O"), ("tag_rf", "R", "F"),
    ("tag_ao", "A", "O"), ("tag_af", "A", "F"),
    ("tag_no", "N", "O"), ("tag_nf", "N", "F"),
]
TAGS = [t for t, _, _ in _TAG_SPECS] + ["tag_over"]
NUMERIC = [RATING, DIFFICULTY, N, PEPPER, AGAIN, ONLINE, FLAG_A, FLAG_B]
PROFILE_COLUMNS = [KEY, FIELD, KIND, *NUMERIC, *TAGS]


def _tag_sql(flag, status) -> str:
    cond = []
    if flag:
        cond.append(f"l_returnflag = '{flag}'")
    if status:
        cond.append(f"l_linestatus = '{status}'")
    return " AND ".join(cond)


def part_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_discount",
                    "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")
    tag_aggs = [F.count_if(F.expr(_tag_sql(f, s))).alias(name) for name, f, s in _TAG_SPECS]
    per_part = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias(N),
        F.avg("l_quantity").alias("_avg_qty"),
        F.avg(F.round(F.col("l_discount") * 100)).alias(DIFFICULTY),
        F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)).alias("_again"),
        F.count_if(F.col("l_linestatus") == "O").alias(ONLINE),
        *tag_aggs,
        F.floor(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
                      .otherwise(0)) / 2).alias("tag_over"),
    )
    part = read_table(spark, sf_dir, "part", KEY, FIELD, KIND, "p_size")
    joined = per_part.join(part, per_part["l_partkey"] == part[KEY], "inner")
    size = F.col("p_size")
    return joined.select(
        F.col(KEY), F.col(FIELD), F.col(KIND),
        F.when(size % 17 != 0, F.col("_avg_qty")).alias(RATING),
        F.col(DIFFICULTY),
        F.col(N).cast("double").alias(N),
        (F.col("_avg_qty") > 25.5).cast("int").alias(PEPPER),
        F.when(size % 10 != 0, F.col("_again")).alias(AGAIN),
        F.col(ONLINE).cast("double").alias(ONLINE),
        (size % 2 == 0).cast("int").alias(FLAG_A),
        (size % 3 == 0).cast("int").alias(FLAG_B),
        *[F.col(t).cast("double").alias(t) for t in TAGS],
    )


def part_profile_sql() -> str:
    """The same profile as DuckDB SQL (for oracles)."""
    tag_aggs = ",\n    ".join(
        f"CAST(count(*) FILTER (WHERE {_tag_sql(f, s)}) AS DOUBLE) AS {name}"
        for name, f, s in _TAG_SPECS)
    return f"""(SELECT p.p_partkey, p.p_brand, p.p_type,
    CASE WHEN p.p_size % 17 <> 0 THEN a._avg_qty END AS rating,
    a.difficulty,
    CAST(a.n_ratings AS DOUBLE) AS n_ratings,
    CAST(a._avg_qty > 25.5 AS INTEGER) AS pepper,
    CASE WHEN p.p_size % 10 <> 0 THEN a._again END AS again,
    a.online,
    CAST(p.p_size % 2 = 0 AS INTEGER) AS flag_a,
    CAST(p.p_size % 3 = 0 AS INTEGER) AS flag_b,
    {", ".join(f"a.{t}" for t in TAGS)}
  FROM (SELECT l_partkey,
    count(*) AS n_ratings,
    avg(l_quantity) AS _avg_qty,
    avg(round(l_discount * 100)) AS difficulty,
    avg(CASE WHEN l_tax > 0.04 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS _again,
    CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS online,
    {tag_aggs},
    CAST(floor(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) / 2) AS DOUBLE) AS tag_over
    FROM lineitem GROUP BY l_partkey) a
  JOIN part p ON a.l_partkey = p.p_partkey)"""
