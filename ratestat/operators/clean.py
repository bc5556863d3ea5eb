"""Cleaning and consistency filters (dropna, dedupe, duplicate audit, tag
bound, exclusive groups, overlap audit, null counts, whitelist)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.operators.common import broadcast_if_small, col
from ratestat.session import materialize

MANY = 0.1  # share of repeating rows above which all rows are compared whole
BROADCAST_DIGESTS = 1 << 20


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows null in any of ``subset`` (pandas ``dropna(subset=...)``)."""
    return df.na.drop(how="any", subset=list(subset))


def _digests(keys: Sequence[str]) -> list:
    """Two 64-bit hashes of a row's ``keys``; nulls have their own mark, as a
    hash alone passes over them."""
    marks = [col(c).isNull() for c in keys]
    return [F.xxhash64(F.lit(lane), *marks, *[col(c) for c in keys]).alias(f"_d{lane}") for lane in (1, 2)]


def _narrow(df: DataFrame, keys: Sequence[str]) -> bool:
    """True if a row of ``keys`` is no wider than its digest."""
    fixed = {"byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp"}
    return len(keys) <= 2 and all(df.select(col(c)).schema[0].dataType.typeName() in fixed for c in keys)


def _suspects(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The rows with ``_met``, the number of rows of their digest; None where
    many rows repeat, so that comparing all of them whole shuffles less.

    One scan without a shuffle estimates the share of rows that repeat.  Unless
    it is over ``MANY``, the digests are counted, 16 bytes a row and combined
    map-side; what repeats is written, and broadcast if it is at most
    ``BROADCAST_DIGESTS`` rows.  More of it would be joined by sorting all rows
    whole, which costs more than comparing them.  ``_met`` is null for a row
    whose digest is its own: that row repeats nothing and needs no comparison."""
    digests = df.select(*_digests(keys))
    n, kinds = digests.agg(F.count(F.lit(1)), F.approx_count_distinct("_d1", 0.02)).first()
    if n - kinds > MANY * n:
        return None
    repeated = materialize(digests.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_met")).where("_met > 1"))
    if repeated.count() > BROADCAST_DIGESTS:
        return None
    return df.select("*", *_digests(keys)).join(F.broadcast(repeated), ["_d1", "_d2"], "left")


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Full-row (or subset) dedupe; null equals null like pandas.

    Rows are told apart by 128-bit digests; only rows whose digest repeats are
    shuffled whole and compared column by column (as a partial + final hash
    aggregate, so a hot duplicate collapses map-side).  The others are passed
    on from where they were read.  Where many rows repeat, and for rows no
    wider than a digest, all rows are compared in one shuffle."""
    keys = list(subset or df.columns)
    rows = None if keys == df.columns and _narrow(df, keys) else _suspects(df, keys)
    if rows is None:
        return df.dropDuplicates(keys)
    back = [col(c) for c in df.columns]
    return rows.where("_met is null").select(*back).unionByName(rows.where("_met is not null").select(*back).dropDuplicates(keys))


def count_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row ``n_duplicates``: rows that repeat an earlier identical row
    (pandas ``duplicated().sum()``).  Rows are compared as in
    :func:`drop_duplicate_rows`."""
    keys = list(subset or df.columns)
    df = df.select(*[col(c) for c in keys])
    rows = None if _narrow(df, keys) else _suspects(df, keys)
    rows = df if rows is None else rows.where("_met is not null")
    grouped = rows.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("_c"))
    return grouped.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long")
                       .alias("n_duplicates"))


def tag_bound(df: DataFrame, n_col: str, tag_cols: Sequence[str]) -> DataFrame:
    """Keep rows where ``n >= row max of tag counts``.  The row max skips
    nulls; a row whose tags are all null (or whose n is null) is dropped, as
    a NaN comparison is false in the original."""
    tags = [col(c) for c in tag_cols]
    row_max = tags[0] if len(tags) == 1 else F.greatest(*tags)
    return df.filter(col(n_col) >= row_max)


def clean_survey(df: DataFrame, rating: str, n_col: str, tag_cols: Sequence[str],
                 also_require: Sequence[str] = ()) -> DataFrame:
    """The cleaning order of the analysis: dropna(rating) -> dedupe ->
    dropna(extra required columns) -> tag bound."""
    out = drop_duplicate_rows(drop_missing(df, [rating]))
    if also_require:
        out = drop_missing(out, also_require)
    return tag_bound(out, n_col, tag_cols)


def exclusive_groups(df: DataFrame, flag_a: str, flag_b: str,
                     labels: tuple[str, str] = ("A", "B"), grp: str = "grp") -> DataFrame:
    """Label rows with a=1,b=0 as labels[0] and a=0,b=1 as labels[1]; rows
    with both or neither flag (or nulls) are excluded."""
    a, b = col(flag_a), col(flag_b)
    label = (F.when((a == 1) & (b == 0), F.lit(labels[0]))
             .when((a == 0) & (b == 1), F.lit(labels[1])))
    return df.withColumn(grp, label).filter(F.col(grp).isNotNull())


def flag_overlap(df: DataFrame, flag_a: str, flag_b: str) -> DataFrame:
    """Counts of rows flagged both, neither, and either (one pass)."""
    a, b = col(flag_a), col(flag_b)
    return df.agg(
        F.count_if((a == 1) & (b == 1)).alias("n_both"),
        F.count_if((a == 0) & (b == 0)).alias("n_neither"),
        F.count_if((a == 1) | (b == 1)).alias("n_either"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null)`` for every column, from a single aggregation."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_null"))
             for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.column", "_p.n_null")


def whitelist_filter(df: DataFrame, column: str, allowed) -> DataFrame:
    """Keep rows whose ``column`` is in ``allowed`` (a Python list becomes an
    ``IN`` list; a DataFrame becomes a left-semi join, broadcast only after a
    size check)."""
    if isinstance(allowed, DataFrame):
        key = allowed.columns[0]
        small = broadcast_if_small(allowed.select(col(key).alias("_allowed")).distinct())
        return df.join(small, col(column) == F.col("_allowed"), "left_semi")
    return df.filter(col(column).isin(list(allowed)))


def min_support(df: DataFrame, n_col: str, minimum: float) -> DataFrame:
    return df.filter(col(n_col) >= minimum)


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into null in floating columns (ingest rule: missing = null)."""
    floating = {f.name for f in df.schema.fields
                if f.dataType.typeName() in ("double", "float")}
    targets = [c for c in (columns or df.columns) if c in floating]
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in targets else col(c)
                       for c in df.columns])

