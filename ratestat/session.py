"""Session helpers: a tuned local session for tests, and the shared
checkpoint folder taken from the session (never a machine-local temp dir
on a cluster)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ratestat") -> SparkSession:
    """Return the active session, or build a local one tuned for tests/bench.

    On a cluster the session already exists (spark-submit) and is returned
    unchanged; nothing here overrides cluster settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RATESTAT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune_session(spark)


def tune_session(spark: SparkSession) -> SparkSession:
    """Prepare the caller's session without changing its settings: the
    package is shipped to its workers."""
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``ratestat`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` pickle our functions by module reference): zip the package
    once per application and distribute it with ``SparkContext.addPyFile``,
    the same mechanism as ``--py-files``."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    staging = tempfile.mkdtemp(prefix="ratestat-pyfiles-")  # driver-side staging for addPyFile
    zpath = os.path.join(staging, "ratestat.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


_PRIVATE: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) create a private folder, once per application.  No setting
    of the session is changed.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="ratestat-ckpt-")
    return _PRIVATE[app]


def run_dir(spark: SparkSession) -> str:
    """This application's folder inside :func:`checkpoint_dir`; everything the
    library writes between jobs lies below it."""
    return f"{checkpoint_dir(spark)}/ratestat/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`run_dir`."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete every table that the library has materialised in this
    application.  Results that still read them become unreadable: call it when
    they have been written, at the end of a run or between two runs."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _SHARED if k[0] == app]:
        del _SHARED[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: Parquet in the shared folder
    (it survives executor loss), read back with column pruning, filter
    pushdown and statistics.  Use it for an intermediate that a plan reads
    several times, so the expensive upstream (e.g. the line-item
    aggregation) runs once instead of once per reuse.  :func:`release` deletes
    what has been materialised."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHARED: dict = {}


def table_version(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files under ``paths``: a table that is
    written anew under its old path gets another version."""
    out = []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
        while found.hasNext():  # files of every level: a partitioned table has them in subfolders
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def shared_table(spark: SparkSession, key: tuple, build, inputs=()) -> DataFrame:
    """Materialise ``build()`` once per Spark application, ``key`` and state
    of the ``inputs`` (paths of the tables it reads), and hand the same table
    to every later caller -- the analysis' "write the adjusted table once, let
    every question read it" stage.  The files live in the shared folder, so a
    lost executor does not lose them."""
    full = (spark.sparkContext.applicationId, *key, table_version(spark, *inputs))
    if full not in _SHARED:
        _SHARED[full] = materialize(build())
    return _SHARED[full]
