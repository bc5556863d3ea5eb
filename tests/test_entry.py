import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_keys_aligned():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert {"method", "t", "df", "p_value", "levene_p"} <= set(df.columns)


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")
def test_entry_from_foreign_cwd(tmp_path):
    """Python workers must import the package even when the driver process
    does not run from the repository (the package is shipped with addPyFile)."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', len(E.entry(s).collect()))\n" % repo)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 1" in out.stdout, out.stderr[-3000:]
