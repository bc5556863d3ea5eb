"""The pipeline's stages on the small documents table."""

import corpus_pipeline
from ratestat.llm.near_dedup import near_dedup
from ratestat.llm.substring_dedup import substring_dedup
from ratestat.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        columns = docs.columns
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        seen.append(len(after))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            if "near" in name:
                assert near_dedup(docs).where("not kept").count() == 0
            if "substring" in name:
                assert substring_dedup(docs).where("n_removed > 0").count() == 0
    assert seen[-1] == seen[-2] > 0


def test_run_and_empty_input(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "bin_id" in got.columns
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
