"""Writers for history and registers."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.operators.registers import merge_register


def write_history(history: DataFrame, path: str, key: list[str], batch_id: int | None = None) -> None:
    """Append history laid out for "one row's changes, newest first".

    Folders by day prune by time; files sorted by key and descending time prune by key through
    their min/max statistics. Files are ranges of (day, key, time) of about equal row count, so a busy
    day or key is many tasks. With ``batch_id`` the write replaces exactly that batch's folder, which makes a
    repeated streaming batch harmless.
    """
    dated = history.withColumn("h_date", F.to_date("h_ts"))
    order = [F.col("h_date"), *(F.col(k) for k in key), F.col("h_ts").desc()]
    laid_out = dated.repartitionByRange(*order).sortWithinPartitions(*order)
    if batch_id is None:
        laid_out.write.mode("append").partitionBy("h_date").parquet(path)
    else:
        laid_out.write.mode("overwrite").partitionBy("h_date").parquet(f"{path}/batch_id={batch_id}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_register(incoming: DataFrame, path: str, key: list[str], update: bool = True, keep: int = 10, attempts: int = 20) -> int:
    """New version of a register next to the old ones; readers take the highest. Returns its number.

    Parquet has no MERGE: the merged rows go to a folder of their own, and a marker file with the next
    version number, which can be made only once, names that folder. A writer that finds the number
    taken merges anew on top of the version that was faster, so no change is lost; a failed attempt
    leaves no marker. The last ``keep`` versions stay for readers, older ones go. The store must
    refuse to create a file twice (HDFS does; object stores need conditional writes).
    """
    spark = incoming.sparkSession
    for _ in range(attempts):
        version = latest_version(spark, path)
        old = None if version is None else read_register(spark, path, version)
        merged = incoming if old is None else merge_register(old, incoming.select(*old.columns), key, update)
        folder = f"data/{uuid.uuid4().hex}"
        merged.write.parquet(f"{path}/{folder}")
        number = 0 if version is None else version + 1
        if _put_if_absent(spark, _marker(path, number), folder):
            _retire(spark, path, number - keep)
            return number
        _delete(spark, f"{path}/{folder}")
    raise RuntimeError(f"register at {path}: {attempts} versions in a row were taken by others")


def _marker(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    files, where = _files(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" in taken.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text + "\n", "utf-8"))
    out.close()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def _folder(spark: SparkSession, path: str, number: int) -> str | None:
    """Folder that a version's marker names; None for a marker that was never finished."""
    files, where = _files(spark, _marker(path, number))
    stream = files.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text.strip() if text.endswith("\n") else None


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Version numbers that are taken, highest first."""
    files, where = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _retire(spark: SparkSession, path: str, last: int) -> None:
    for number in _numbers(spark, path):
        if number <= last:
            folder = _folder(spark, path, number)
            if folder:
                _delete(spark, f"{path}/{folder}")
            _delete(spark, _marker(path, number))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest number taken; an unfinished marker counts, so that no number is ever used twice."""
    return next(iter(_numbers(spark, path)), None)


def read_register(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The register as of the highest finished version up to ``version``."""
    for number in _numbers(spark, path):
        if version is None or number <= version:
            folder = _folder(spark, path, number)
            if folder:
                return spark.read.parquet(f"{path}/{folder}")
    raise FileNotFoundError(f"no register at {path}")
