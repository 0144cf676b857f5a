"""Inventory snapshots of a catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablekeep.session import scratch_path

SNAPSHOTS = (
    "inv_tables inv_columns inv_geometry inv_views inv_roles inv_members inv_triggers inv_constraints inv_indexes"
).split()


def read_inventory(spark: SparkSession, path: str, names: Iterable[str] = SNAPSHOTS) -> dict[str, DataFrame]:
    """Saved snapshots, one folder per table; only names that exist under ``path`` are returned."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def write_inventory(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def read_inventory_jdbc(
    spark: SparkSession, url: str, queries: dict[str, str], partition_on: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str,
) -> dict[str, DataFrame]:
    """Snapshots straight from a database. With ``partition_on`` (a numeric id) and its bounds each
    query is read by several tasks; without it the catalog is one connection's worth of rows."""
    frames = {}
    for name, sql in queries.items():
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if partition_on and bounds:
            reader = (
                reader.option("dbtable", f"({sql}) AS inventory")
                .option("partitionColumn", partition_on)
                .option("lowerBound", bounds[0])
                .option("upperBound", bounds[1])
                .option("numPartitions", partitions)
            )
        else:
            reader = reader.option("query", sql)
        frames[name] = reader.load()
    return frames


def inventory_of_frames(spark: SparkSession, tables: dict[tuple[str, str], DataFrame]) -> dict[str, DataFrame]:
    """Inventory of DataFrames at hand: their schemas only, no data is read."""
    table_rows, column_rows = [], []
    for table_id, ((schema, table), df) in enumerate(sorted(tables.items(), key=lambda kv: kv[0]), start=1):
        table_rows.append((table_id, schema, table))
        for i, field in enumerate(df.schema.fields, start=1):
            column_rows.append((table_id, schema, table, field.name, i, field.dataType.simpleString(), False))
    return {
        "inv_tables": spark.createDataFrame(table_rows, "table_id bigint, schema_name string, table_name string"),
        "inv_columns": spark.createDataFrame(
            column_rows,
            "table_id bigint, schema_name string, table_name string, column_name string, ordinal_position int, "
            "data_type string, is_identity boolean",
        ),
    }


def stored(df: DataFrame, label: str) -> DataFrame:
    """Round trip through parquet in the shared folder, as a saved snapshot would make."""
    path = scratch_path(df.sparkSession, "inventory")
    write_inventory({label: df}, path)
    return read_inventory(df.sparkSession, path, [label])[label]
