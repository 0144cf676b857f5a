"""Event sources and stateless or built-in stateful stream operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.config import Config
from tablekeep.operators.reconcile import CREATE, reconcile, valid_events

EVENT_SCHEMA = "seq bigint, ts timestamp, channel string, payload string"


def read_file_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_schema_events(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """S3: schema events from files (``{"path": ...}``) or Kafka (``{"kafka.bootstrap.servers":
    ..., "subscribe": ...}`` with JSON values). Events without a payload are left out here; count
    them with ``empty_payloads``."""
    return raw_schema_events(spark, source).filter("payload IS NOT NULL AND payload != ''")


def empty_payloads(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """The events S3 leaves out, for a warning."""
    return raw_schema_events(spark, source).filter("payload IS NULL OR payload = ''")


def raw_schema_events(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    if "path" in source:
        limit = source.get("maxFilesPerTrigger")
        return read_file_stream(spark, source["path"], EVENT_SCHEMA, int(limit) if limit else None)
    rows = spark.readStream.format("kafka").options(**source).load()
    return rows.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")


def write_schema_events(events: DataFrame, path: str):
    """S3 as a stream writer: one reader of the source, two sinks. Events with a payload go to
    ``path``/events, the others, for a warning, to ``path``/empty; both by batch id, so a repeated
    batch replaces itself. ``events`` are ``raw_schema_events``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        filled = F.coalesce(F.col("payload") != "", F.lit(False))
        for name, part in (("events", batch.filter(filled)), ("empty", batch.filter(~filled))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(run)


def lifecycle_stream(events: DataFrame, cfg: Config) -> DataFrame:
    """T2 as a stream (update mode): the running latest state per schema. The state is one small
    mergeable aggregate per schema, combined before the shuffle."""
    last = valid_events(events, cfg).groupBy(F.col("payload").alias("schema_name")).agg(
        F.max(F.struct("ts", "seq", "channel")).alias("last"), F.count("*").alias("n_events")
    )
    return last.select(
        "schema_name",
        F.when(F.col("last.channel") == CREATE, "present").otherwise("dropped").alias("state"),
        F.col("last.ts").alias("since"),
        "n_events",
    )


def dedupe_stream(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """T9 as a stream: a resend within the watermark is dropped; state expires with it."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["channel", "payload"])


def reconcile_periodically(
    ticks: DataFrame, schemas: Callable[[], DataFrame], workspaces: Callable[[], DataFrame], cfg: Config, path: str
):
    """A stream writer that reconciles anew on every trigger.

    Give ``ticks`` a processing-time trigger (the reference interval is 3600 s). The snapshots are
    read again each time; the result of a trigger replaces the folder of its own batch id, so a
    retried trigger leaves one result.
    """

    def run(_: DataFrame, batch_id: int) -> None:
        reconcile(schemas(), workspaces(), cfg).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return ticks.writeStream.foreachBatch(run)
