"""Session helpers shared by every operator: tables, shared checkpoints, shipping the package to executors."""

from __future__ import annotations

import importlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable on every executor, once per application.

    Python workers import functions by module name; on a cluster that was not started with the
    repository on its path the package is sent along as a zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="voxloom-ship-"), "voxloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(base, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(_PACKAGE)))
    sc.addPyFile(out)
    importlib.invalidate_caches()
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """`df`, over at least as many partitions as there are cores.

    For stages that cost much more than their bytes. Only input in fewer partitions than cores (a few small files) is
    shuffled; large input has more already and stays where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the cluster names in spark.checkpoint.dir.

    Only in local mode, as in tests, a temporary one is made where it is unset; on a cluster that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get() if at.isDefined() else tempfile.mkdtemp(prefix="voxloom-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of one run, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/voxloom-{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, its lineage cut. spark.cleaner.referenceTracking.cleanCheckpoints tells Spark
    to remove the files with the last reference to it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
