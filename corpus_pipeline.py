"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark
leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame, which ``run`` writes as Parquet and reads again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.llm.common import documents, is_remainder, staged
from ratestat.llm.decontam import decontaminate
from ratestat.llm.near_dedup import near_dedup
from ratestat.llm.packing import best_fit_packing, with_sizes
from ratestat.llm.quality import ACCEPT, quality_scores
from ratestat.llm.substring_dedup import substring_dedup
from ratestat.sources.tables import read_table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not listed; rows with a null id stay."""
    return docs.join(ids, "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least ``ACCEPT``."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    scores = quality_scores(docs, labels, held_out=is_remainder("doc_id", 4, 2))
    rejected = scores.where((F.col("score") < ACCEPT) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return _without(docs, rejected)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return _without(docs, near_dedup(docs).where("not kept").select("doc_id").distinct())


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; texts in which
    nothing repeats are unchanged, those of which nothing is left go."""
    cut = (substring_dedup(docs).where("n_removed > 0 and doc_id is not null")
           .select("doc_id", F.col("text").alias("before"), F.col("kept_text").alias("after")).distinct())
    joined = docs.join(cut, (docs["doc_id"] == cut["doc_id"]) & (docs["text"] == cut["before"]), "left")
    text = F.coalesce("after", "text")
    changed = F.col("after").isNotNull()
    columns = {"text": text, "n_chars": F.when(changed, F.length("after").cast("long")).otherwise(F.col("n_chars"))}
    return joined.where(~changed | (F.col("after") != "")).select(
        *[columns[c].alias(c) if c in columns else docs[c] for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(docs, found.select("doc_id").distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into training sequences, one row per piece."""
    return best_fit_packing(with_sizes(docs), "size")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier is trained; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
