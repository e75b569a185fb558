"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and make sure that checkpoints have a folder.

    The folder is the cluster's own (spark.checkpoint.dir). Only in local mode, as in tests, a temporary folder is made where
    none is set; it goes when the process ends. On a cluster without the setting this fails: a folder of one machine wouldn't do.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{path}".rstrip(":")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            shared = tempfile.mkdtemp(prefix="scriptorium-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder for staged files, below that of the checkpoints, where all machines see it."""
    return f"{ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/staged-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in fewer partitions (a small table in one file); else unchanged.

    For narrow passes that compute much per row. Large tables have more partitions than cores and aren't shuffled. Rows
    that come out of a shuffle are left alone: to count their partitions would run it.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for shuffles before Python stages: given as a number, they are not coalesced by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the defaults that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
