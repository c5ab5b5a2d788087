"""Spark session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of the engine relies on. Sizes (shuffle partitions, memory)
#: belong to the cluster and are left to it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "quern", **conf: str) -> SparkSession:
    """Return the running session, or build one with the engine's defaults."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory; a file and a directory of files are alike."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a Spark application, so they need no install and no PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quern-ship-")  # on the driver only: Spark serves the archive to the workers
    archive = f"{folder}/quern.zip"
    with zipfile.PyZipFile(archive, "w") as z:
        z.writepy(here)
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._quern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a private folder is
    made and removed again at exit, in local mode only: on a cluster each executor would
    write to a disk of its own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("quern.private.dir", None)
    if not own:
        path = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = f"file://{path}"
        spark.conf.set("quern.private.dir", own)
    return own


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables; the file system deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}-{os.getpid()}"
    if spark.conf.get("quern.run.dir", None) != path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        spark.conf.set("quern.run.dir", path)
    return path


def fresh_path(spark: SparkSession, label: str = "cut") -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", by: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This is how lineage is cut: the files outlive any executor, and parquet keeps them
    small. Column names must be unique. ``by`` names a column of few values whose rows go to
    folders of their own, so a filter on it reads no others; ``options`` go to the writer.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write.options(**(options or {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for every core before work in Python.

    A large input has them already and is left alone; only an input of a few files is dealt out.
    For scans with filters and projections only: counting the partitions of a plan with an
    exchange would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever file system it lives in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
