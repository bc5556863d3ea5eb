"""Materialised tables: versions of their inputs, deletion on request."""

import os

import pytest

from ratestat import session


def _plain(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_version_sees_files_below_partitions(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id", "id % 2 as p").write.partitionBy("p").parquet(path)
    before = session.table_version(spark, path)
    assert any("p=0" in name for name, _, _ in before)
    spark.range(11).selectExpr("id", "id % 2 as p").where("p = 1").write.mode("overwrite").parquet(path + "/p=1")
    assert session.table_version(spark, path) != before


def test_release_deletes_what_was_materialised(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)
    table = session.shared_table(spark, ("release-test",), build)
    assert session.shared_table(spark, ("release-test",), build).count() == 5 and len(built) == 1
    folder = _plain(session.run_dir(spark))
    assert os.path.isdir(folder) and os.listdir(folder)
    session.release(spark)
    assert not os.path.isdir(folder)
    with pytest.raises(Exception):
        table.collect()
    assert session.shared_table(spark, ("release-test",), build).count() == 5 and len(built) == 2


def test_no_setting_is_changed(spark, monkeypatch):
    before = dict(spark.sparkContext.getConf().getAll())
    session.checkpoint_dir(spark)
    assert dict(spark.sparkContext.getConf().getAll()) == before
