"""Helpers shared by the operators: staged tables in the shared folder,
hold-out remainders, bounded training samples."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.session import scratch_path, ship_package
from ratestat.sources.tables import read_table


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_BYTES`` for the jobs run inside: rows
    here hold whole texts or sets, and buffers of the default size take more
    memory than the tasks themselves.  The setting is put back afterwards."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder that ``spark.checkpoint.dir``
    names and return the table read back: computed once, pruned when read,
    and not lost with an executor.  ``ratestat.session.release`` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to its workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *columns)


def remainder(id_col: str, mod: int):
    """crc32(id as text) mod ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def is_remainder(id_col: str, mod: int, value: int):
    """True where the id falls into this fold; false for a null id."""
    return F.coalesce(remainder(id_col, mod) == value, F.lit(False))


def hash_order(id_col: str, seed: int):
    """A fixed pseudo-random order of ids, the same on every run."""
    return F.xxhash64(F.lit(seed), F.col(id_col))


def first_ids(ids: DataFrame, bound: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``bound`` distinct ids in the fixed hash order.  A cut of the
    hash range set by the row count leaves about twice as many to sort, so
    the whole column never is; rows that repeat ids can make it fewer."""
    span = 1 << 30
    share = min(1.0, 2 * bound / max(ids.count(), 1))
    near = ids.select(id_col).where(F.pmod(hash_order(id_col, seed), F.lit(span)) < int(share * span) + 1)
    return near.distinct().orderBy(F.pmod(hash_order(id_col, seed), F.lit(span)), id_col).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, value: int, bound: int,
                    seed: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """At most ``bound`` (id, text) rows whose label is ``value``, chosen by a
    fixed hash of ids, so that the choice does not depend on how the data are
    partitioned.  The ids are picked from the narrow label table; at most
    ``bound`` of them are broadcast to fetch the texts."""
    known = labels.where((F.col(label_col) == value) & F.col(id_col).isNotNull())
    return _texts(docs, first_ids(known, bound, seed, id_col), id_col, text_col)


def plain_sample(docs: DataFrame, where, bound: int, seed: int, id_col: str = "doc_id",
                 text_col: str = "text") -> list:
    """At most ``bound`` (id, text) rows of ``docs`` with ``where``, chosen in
    the same way."""
    known = docs.where(where & F.col(id_col).isNotNull())
    return _texts(docs, first_ids(known, bound, seed, id_col), id_col, text_col)


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list:
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(ids.select(F.col(id_col).alias("id"))), "id")
            .groupBy("id").agg(F.min("text").alias("text")).collect())
    return sorted(((r["id"], r["text"] or "") for r in rows))
