"""Spark session helpers.

On a cluster the session is created by the platform; these helpers only fill in
settings that are unset, so a user's configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings this package relies on. They are applied only where the session has none.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings of a new context; a running one keeps its own.
STARTUP_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "warmstart") -> SparkSession:
    """Create (or reuse) a session for tests and local runs."""
    running = SparkSession.getActiveSession()
    if running is not None:
        for k, v in DEFAULT_CONF.items():
            if running.conf.isModifiable(k) and running.conf.get(k, None) is None:
                running.conf.set(k, v)
        return running
    given = SparkConf()  # what spark-defaults.conf and the command line say
    wanted = dict(DEFAULT_CONF) | STARTUP_CONF
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if memory := os.environ.get("WARMSTART_DRIVER_MEMORY"):
        wanted["spark.driver.memory"] = memory
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in wanted.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). A private
    folder is created only when nothing is set and the master is local, i.e. in
    tests; on a cluster an unset value is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this job")
    d = tempfile.mkdtemp(prefix="warmstart-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pinned(df: DataFrame, name: str = "pinned") -> DataFrame:
    """``df`` written once to the shared checkpoint folder as Parquet and read from there by every use."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Paths of the entries of a folder; an absent folder has none, other errors are raised."""
    fs, p = _folder(spark, path)
    return [str(x.getPath()) for x in fs.listStatus(p)] if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Plans made inside are not adaptive and shuffle into ``partitions``: a persisted table keeps the partitioning of its plan,
    known from the start, and joins on its key need no exchange of it."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
