"""Session, table access and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "billspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect. On a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once, so that it need not be installed where they run.

    The driver's own file server hands it out; nothing is read from a local folder by the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="billspark-"), "billspark_package"), "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sys.path[:] = [p for p in sys.path if "billspark_package" not in p]  # the driver keeps its own copy
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Splits an input of fewer partitions than the session has task slots, before costly work on its rows.

    A table of one small file is read by one task however costly the work after it is. Larger inputs have as many
    splits as there are slots and pass through unchanged, so that nothing is shuffled at scale.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a folder of our own if all runs on this machine, as in
    tests; on a cluster that is an error, since executors on other machines would not see it."""
    now = spark.sparkContext.getCheckpointDir()
    if now:
        return now
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="billspark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it back: lineage is cut and later uses don't recompute.

    The folder outlives executors; what is written goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already; the cluster cleans its own folder
            return
