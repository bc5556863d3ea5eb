"""Driver queries for sources and sinks: data derived from the tables is
written as the files of a survey -- headerless and headed CSV in several
parts, a JSON object, a feature collection -- and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratestat.plans import profiles as P
from ratestat.plans.common import sql_round
from ratestat.plans.q_clean import PROFILE_SQL, adjusted_profile, adjusted_sql, profile
from ratestat.session import scratch_path
from ratestat.sources import survey
from ratestat.sources.positional import positional_bind
from ratestat.sources.tables import read_table

SURVEY_NUMBERS = [P.KEY, P.RATING, P.DIFFICULTY, P.N, P.AGAIN, P.ONLINE]
ADJUSTED = [P.KEY, P.FIELD, "rating_adj", "difficulty_adj", P.AGAIN, "total_tags"]


def _written(df, key, parts, header=False, null=""):
    """``df`` as CSV part files whose order is that of ``key``."""
    path = scratch_path(df.sparkSession, "csv")
    ordered = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    survey.write_csv(ordered, path, header=header, null=null)
    return path


def q_csv_headerless(spark, d):
    """Numbers by position, missing ones written as NA, numbered in order."""
    path = _written(profile(spark, d).select(*SURVEY_NUMBERS), P.KEY, 4, null="NA")
    return survey.read_csv_columns(spark, path, SURVEY_NUMBERS, SURVEY_NUMBERS, idx="row_idx")


def q_csv_headed(spark, d):
    """The adjusted table written with a header in each part and read back."""
    path = _written(adjusted_profile(spark, d).select(*ADJUSTED), P.KEY, 3, header=True)
    numbers = [c for c in ADJUSTED if c != P.FIELD]
    return survey.read_csv_columns(spark, path, ADJUSTED, numbers, header=True)


def q_csv_documents(spark, d):
    """Texts with quotes and line ends, over several ordered part files."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang")
    path = _written(docs.select("doc_id", "text", "lang"), "doc_id", 5)
    back = survey.read_csv_columns(spark, path, ["doc_id", "text", "lang"], na_tokens=(), idx="row_idx")
    return back.select("row_idx", F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"),
                       F.length("text").cast("long").alias("n_chars"), "lang")


def q_csv_bind(spark, d):
    """Three headerless inputs of different part files bound by position."""
    p = profile(spark, d)
    frames = []
    for names, parts in (([P.KEY, P.RATING], 2), ([P.FIELD, P.KIND], 5), (P.TAGS[:3], 3)):
        path = scratch_path(spark, "csv")
        ordered = p.repartitionByRange(parts, P.KEY).sortWithinPartitions(P.KEY).select(*names)
        survey.write_csv(ordered, path, header=False)
        frames.append(survey.read_csv_columns(spark, path, names, [c for c in names if c not in (P.FIELD, P.KIND)]))
    return positional_bind(*frames)


def _one_text(spark, one_row, name):
    path = scratch_path(spark, name)
    one_row.coalesce(1).write.text(path)
    return path


def q_json_map(spark, d):
    """Nations to regions as one JSON object."""
    nation, region = (read_table(spark, d, t) for t in ("nation", "region"))
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))).alias("value"))  # a fixed dimension
    return survey.read_json_map(spark, _one_text(spark, pairs, "map"), "nation", "region")


_RING = "concat('[[', k, ',', k, '.5],[', k + 1, ',', k, '],[', k, ',', k, '.5]]')"
_SHAPE = f"""CASE WHEN k % 2 = 0 THEN concat('{{"type":"Polygon","coordinates":[', {_RING}, ']}}')
  ELSE concat('{{"type":"MultiPolygon","coordinates":[[', {_RING}, '],[', {_RING}, ']]}}') END"""


def q_geojson(spark, d):
    """A collection of polygons and multipolygons, one for each nation."""
    nation = read_table(spark, d, "nation", "n_nationkey", "n_name").withColumn("k", F.col("n_nationkey").cast("int"))
    feature = F.concat(F.lit('{"type":"Feature","id":"'), F.col("k"), F.lit('","properties":{"name":"'), F.col("n_name"),
                       F.lit('"},"geometry":'), F.expr(_SHAPE), F.lit("}"))
    doc = nation.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                              F.array_join(F.collect_list(feature), ",\n "), F.lit("]}")).alias("value"))
    return survey.read_geojson(spark, _one_text(spark, doc, "geo"), "nation")


def q_preview(spark, d):
    """The first five parts."""
    return profile(spark, d).select(*SURVEY_NUMBERS).orderBy(P.KEY).limit(5)


QUERIES = {
    "csv_headerless": q_csv_headerless,
    "csv_headed": q_csv_headed,
    "csv_documents": q_csv_documents,
    "csv_bind": q_csv_bind,
    "json_map": q_json_map,
    "geojson": q_geojson,
    "preview": q_preview,
}

_NUMBERS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SURVEY_NUMBERS)
_ROW = f"row_number() OVER (ORDER BY {P.KEY}) - 1 AS row_idx"

SQL = {
    "csv_headerless": sql_round(f"SELECT {_ROW}, {_NUMBERS} FROM {PROFILE_SQL} _p", SURVEY_NUMBERS),
    "csv_headed": sql_round(f"SELECT {', '.join(ADJUSTED)} FROM {adjusted_sql()} _a".replace(
        f"SELECT {P.KEY},", f"SELECT CAST({P.KEY} AS DOUBLE) AS {P.KEY},", 1), [c for c in ADJUSTED if c != P.FIELD]),
    "csv_documents": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, md5(text) AS text_md5,
  CAST(length(text) AS BIGINT) AS n_chars, lang FROM documents""",
    "csv_bind": sql_round(f"""SELECT {_ROW}, CAST({P.KEY} AS DOUBLE) AS {P.KEY}, {P.RATING}, {P.FIELD}, {P.KIND}, {', '.join(P.TAGS[:3])}
FROM {PROFILE_SQL} _p""", [P.KEY, P.RATING, *P.TAGS[:3]]),
    "json_map": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "geojson": f"""SELECT CAST(k AS VARCHAR) AS nation, n_name AS name, {_SHAPE} AS geometry_json
FROM (SELECT CAST(n_nationkey AS INTEGER) AS k, n_name FROM nation) _n""",
    "preview": sql_round(f"SELECT {', '.join(SURVEY_NUMBERS)} FROM {PROFILE_SQL} _p ORDER BY {P.KEY} LIMIT 5",
                         SURVEY_NUMBERS[1:]),
}
