"""Session settings and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Safe on any cluster: runtime re-planning, skew splitting, UTC clock.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Shuffle files go when the query that wrote them has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_ROWS = 20_000  # rows of a task that works long on each
_ROOTS: set[str] = set()  # scratch folders of this process that are marked for deletion


def build_session(app: str = "tablekeep", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only in local mode (unit tests, a laptop), where driver and executor are one process, an unset
    folder is replaced by a temporary one, kept in the session so that later calls agree on it. On
    a cluster an unset folder is an error: executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tablekeep-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path under this application's scratch folder, which goes when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/tablekeep/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _ROOTS.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, survives lost executors, and keeps the columnar
    layout so later passes read only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_tidy(df: DataFrame, label: str) -> DataFrame:
    """``materialize``; the shuffle files of the write are deleted with its end, as nothing reads them again."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        if was is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, was)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in as many tasks as its rows ask for, whatever files it comes from; equal ``by`` stay together.

    A small file is read by one task, and so is a row group; costly work on its rows comes behind this.
    """
    return df.repartition(max(1, -(-df.count() // SLICE_ROWS)), *by)
