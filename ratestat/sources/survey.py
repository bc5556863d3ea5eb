"""Survey inputs and outputs.

* Headerless CSVs whose columns are named by position, with pandas'
  missing-value tokens (``NA``, ``NaN``, ``null``, ...) read as null -- Spark's
  CSV reader would keep most of them as text.  Columns are read as strings
  and converted with ``try_cast`` (bad numbers become null, never errors).
* The three survey files bound by row position (see ``positional``).
* A JSON object file read as a two-column lookup table.
* A GeoJSON feature collection, one row per feature (geometry kept as JSON
  text: polygon handling is not part of this library).
* CSV / Parquet sinks; the row count goes into the file name only when asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ratestat.functions import constants as K
from ratestat.operators.common import col, q
from ratestat.sources.csvranges import read_records
from ratestat.sources.positional import positional_bind, with_row_numbers


def _clean_token(c: Column, na_tokens: Sequence[str]) -> Column:
    return F.when(c.isNull() | c.isin(list(na_tokens)), F.lit(None).cast("string")).otherwise(c)


def read_csv_columns(spark: SparkSession, path: str | Sequence[str], names: Sequence[str],
                     numeric: Sequence[str] = (), header: bool = False,
                     na_tokens: Sequence[str] = K.NA_TOKENS, idx: str | None = None) -> DataFrame:
    """Read a CSV whose columns are ``names`` (by position when headerless);
    ``numeric`` columns become doubles (NaN never appears: missing is null).
    Quotes inside a quoted field are doubled, and it may hold line ends.

    ``path`` may be a file, a folder or a list of them; files of any size are
    read in byte ranges (:mod:`ratestat.sources.csvranges`), many tasks a
    file.  ``idx`` names a column for the record's number from 0 over all
    files in order; without it :func:`positional_bind` still knows the number,
    as long as the frame is passed on as it is."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = read_records(spark, path, header).select(
        F.col("record").alias("_record"), F.from_csv("line", _ddl(names), options).alias("_f"))
    numeric = set(numeric)
    out = []
    for n in names:
        c = _clean_token(F.col("_f").getField(n), na_tokens)
        out.append((c.try_cast("double") if n in numeric else c).alias(n))
    numbered = parsed.select(F.col("_record").alias(idx or "row_idx"), *out)
    if idx:
        return numbered
    return with_row_numbers(numbered.select(*[col(n) for n in names]), numbered)


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"{q(n)} string" for n in names)


def read_survey(spark: SparkSession, num_path: str, qual_path: str, tags_path: str,
                num_names: Sequence[str] = K.NUMERIC_COLUMNS,
                qual_names: Sequence[str] = K.QUALITATIVE_COLUMNS,
                tag_names: Sequence[str] = K.TAG_COLUMNS) -> DataFrame:
    """Numeric + qualitative + tag files bound by row position (31 columns
    plus ``row_idx``).  An input may be one file of any size, a folder of part
    files or a list of files in order."""
    num = read_csv_columns(spark, num_path, num_names, numeric=num_names)
    qual = read_csv_columns(spark, qual_path, qual_names)
    tags = read_csv_columns(spark, tags_path, tag_names, numeric=tag_names)
    bound = positional_bind(num, qual, tags)
    return bound.select("row_idx", *[col(c) for c in (*num_names, *qual_names, *tag_names)])


def read_adjusted(spark: SparkSession, path: str, tags: Sequence[str] = K.TAG_COLUMNS) -> DataFrame:
    """Headed CSV written by :func:`write_csv` for the 55-column adjusted table."""
    names = K.adjusted_column_order(tags)
    text = set(K.QUALITATIVE_COLUMNS)
    return read_csv_columns(spark, path, names, numeric=[c for c in names if c not in text],
                            header=True)


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object ``{"k": "v", ...}`` as rows (key, value)."""
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), MapType(StringType(), StringType()))
    return doc.select(F.explode(m).alias(key, value))


def read_geojson(spark: SparkSession, path: str, id_as: str = "State") -> DataFrame:
    """Feature collection -> (id_as, name, geometry_json), one row per feature.

    The geometry is handed through as the file's own JSON text, whatever its
    type: an inferred schema would have to give polygons and multipolygons one
    type.  A property that is no text comes as its JSON text; a missing id,
    name or geometry is null."""
    feature = StructType([StructField("id", StringType()), StructField("geometry", StringType()),
                          StructField("properties", MapType(StringType(), StringType()))])
    doc = spark.read.schema(StructType([StructField("features", ArrayType(feature))])).option("multiLine", True).json(path)
    feats = doc.select(F.explode("features").alias("f"))
    return feats.select(F.col("f.id").alias(id_as), F.try_element_at("f.properties", F.lit("name")).alias("name"),
                        F.col("f.geometry").alias("geometry_json"))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              single_file: bool = False, null: str = "") -> None:
    """CSV without an index column; missing values are written as ``null``.
    ``single_file`` coalesces to one part file (only for small outputs)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", header).option("nullValue", null).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def counted_name(df: DataFrame, prefix: str, suffix: str = ".csv") -> str:
    """``f"{prefix}_{n}{suffix}"`` -- the only place a row count is taken."""
    return f"{prefix}_{df.count()}{suffix}"


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
