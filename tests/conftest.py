import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ratestat.session import tune_session
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="ratestat-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    tune_session(s)
    yield s


A = [1.0, 2.0, 2.0, 4.0, 7.0]
B = [2.0, 3.0, 5.0, 5.0, 9.0, 10.0]


@pytest.fixture(scope="session")
def two_samples(spark):
    rows = [("A", i, x) for i, x in enumerate(A)] + [("B", 100 + i, x) for i, x in enumerate(B)]
    return spark.createDataFrame(rows, "grp string, id long, x double")
