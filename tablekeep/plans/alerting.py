"""Catalogue: alert suppression and streams run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators.alerts import suppress_alerts
from tablekeep.plans.catalog import query
from tablekeep.operators import names
from tablekeep.plans.governance import AS_OF, FORWARD, LOG, OURS, READY, TABLE_ROWS, VALID
from tablekeep.plans.histories import FOLD_EMPTY, HISTORY_OUT
from tablekeep.session import scratch_path
from tablekeep.streaming import events, stateful

CFG = Config()


FILE_ROWS = 250_000  # rows aimed at per file of a slice
SURE_ROWS = 10_000  # rows per file that make sure no file of a slice stays without any


def files_per_slice(fewest: int, most: int, least: int) -> int:
    """Files of every slice, so that a large one is written and read by many tasks. All slices need the same
    number, since a trigger takes a number of files: few where a slice has few rows."""
    return max(min(-(-most // FILE_ROWS), fewest // SURE_ROWS), least)


def stream_of(fx, view: str, slices: int = 3) -> DataFrame:
    """A derived view as a file stream: consecutive time slices, one micro-batch each. The slices
    are written one after the other because a file source takes files in the order they appear."""
    path = scratch_path(fx.spark, f"stream-{view}")
    df = fx[view].withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = df.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    width = (bounds["hi"] - bounds["lo"]) // slices + 1
    part = F.floor((F.unix_micros("ts") - bounds["lo"]) / width)
    sizes = {r["k"]: r["count"] for r in df.groupBy(part.alias("k")).count().collect()}
    rows = [sizes.get(k, 0) for k in range(slices)]
    files = files_per_slice(min(rows), max(rows), 2)
    for k in range(slices):
        df.filter(part == k).repartition(files).write.mode("append").parquet(path)
    return events.read_file_stream(fx.spark, path, df.schema, files_per_trigger=files)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up and return everything it wrote."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").outputMode("append").start(out)
        started.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    started = writer.outputMode(mode).foreachBatch(keep).start()
    started.awaitTermination()
    return spark.read.parquet(out)


GREEDY = """
WITH go AS (SELECT subject, min(ts) AS ts FROM alerts GROUP BY 1
  UNION ALL SELECT go.subject, (SELECT min(a.ts) FROM alerts a WHERE a.subject = go.subject AND a.ts >= go.ts + INTERVAL 300 SECOND) FROM go WHERE go.ts IS NOT NULL)
SELECT (SELECT min(a.seq) FROM alerts a WHERE a.subject = go.subject AND a.ts = go.ts) AS seq, ts, subject FROM go WHERE ts IS NOT NULL
"""


@query("t03_suppress_alerts", GREEDY)
def _(fx):
    return suppress_alerts(fx["alerts"])


@query("t03_suppress_alerts_long", GREEDY.replace("300 SECOND", "5 HOUR"))
def _(fx):
    return suppress_alerts(fx["alerts"], cooldown_seconds=5 * 3600)


@query("t03_suppress_alerts_stream", GREEDY)
def _(fx):
    return drained(stateful.suppress_alerts_stream(stream_of(fx, "alerts"))).filter("NOT is_late").drop("is_late")


@query("t02_lifecycle_stream", f"""
SELECT payload AS schema_name, CASE WHEN channel = 'schema_create' THEN 'present' ELSE 'dropped' END AS state, ts AS since, n_events FROM (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY payload) AS n_events FROM {VALID}) WHERE k = 1
""")
def _(fx):
    updates = drained(events.lifecycle_stream(stream_of(fx, "schema_events"), CFG), "update")
    last = updates.groupBy("schema_name").agg(F.max_by(F.struct("state", "since", "n_events"), "batch_id").alias("s"))
    return last.select("schema_name", "s.*")


@query("t04_pending_monitor", LOG + """, w AS (SELECT schema_name, table_name, ts AS since,
    (SELECT min(c.ts) FROM m c WHERE c.mark = 'clear' AND c.schema_name = s.schema_name AND c.table_name = s.table_name AND c.ts > s.ts) AS ends
  FROM s WHERE mark = 'set' AND coalesce(before, 'clear') = 'clear')
SELECT schema_name, table_name, 'overdue' AS event, since, since + INTERVAL 2 HOUR AS at FROM w
  WHERE coalesce(ends, TIMESTAMP '2100-01-01 00:00:00') > since + INTERVAL 2 HOUR AND since + INTERVAL 2 HOUR < (SELECT max(ts) FROM m WHERE mark IS NOT NULL)
UNION ALL SELECT schema_name, table_name, 'cleared', since, ends FROM w WHERE ends > since + INTERVAL 2 HOUR
""")
def _(fx):
    return drained(stateful.pending_monitor(stream_of(fx, "ddl_log"), CFG))


@query("t05_history_stream", FOLD_EMPTY + HISTORY_OUT)
def _(fx):
    out = drained(stateful.history_stream(stream_of(fx, "change_feed"), "gid", ["varde", "detalj"]))
    return out.filter("NOT is_late").drop("is_late")


@query("t09_dedupe_stream", """
SELECT channel, payload FROM schema_events WHERE payload <> '' GROUP BY 1, 2
""")
def _(fx):
    path = scratch_path(fx.spark, "stream-schema-events")
    fx["schema_events"].withColumn("ts", F.col("ts").cast("timestamp")).select("seq", "ts", "channel", "payload").write.parquet(path)
    stream = events.read_schema_events(fx.spark, {"path": path})
    return drained(events.dedupe_stream(stream, "60 days")).select("channel", "payload")


def run_out(writer, spark) -> None:
    """Start a stream writer and wait until its input is used up."""
    writer.option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()


def sliced(fx, df: DataFrame, label: str, slices: int = 3) -> DataFrame:
    """Rows as a file stream of a few micro-batches, dealt out by hash."""
    path = scratch_path(fx.spark, label)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
    sizes = {r["k"]: r["count"] for r in df.groupBy(part.alias("k")).count().collect()}
    rows = [sizes.get(k, 0) for k in range(slices)]
    files = files_per_slice(min(rows), max(rows), 1)
    for k in range(slices):
        piece = df.filter(part == k)
        (piece.coalesce(1) if files == 1 else piece.repartition(files)).write.mode("append").parquet(path)
    return events.read_file_stream(fx.spark, path, df.schema, files_per_trigger=files)


@query("s03_schema_events", """
SELECT seq, channel, payload, CASE WHEN payload <> '' THEN 'events' ELSE 'empty' END AS sink FROM schema_events
""")
def _(fx):
    path, out = scratch_path(fx.spark, "raw-events"), scratch_path(fx.spark, "schema-events")
    fx["schema_events"].withColumn("ts", F.col("ts").cast("timestamp")).select("seq", "ts", "channel", "payload").write.parquet(path)
    run_out(events.write_schema_events(events.raw_schema_events(fx.spark, {"path": path, "maxFilesPerTrigger": "2"}), out), fx.spark)
    sinks = [fx.spark.read.schema(events.EVENT_SCHEMA).parquet(f"{out}/{name}").select("seq", "channel", "payload", F.lit(name).alias("sink")) for name in ("events", "empty")]
    return sinks[0].unionByName(sinks[1])


@query("t06_placeholder_stream", READY + f"""SELECT 'D' AS h_type, TIMESTAMP '{AS_OF}' AS h_ts, 'loader' AS h_by, r.*, true AS is_placeholder FROM r
WHERE (r.schema_name, r.table_name) IN (SELECT (schema_name, table_name) FROM ready)
  AND (r.schema_name, r.table_name, r.gid) IN (SELECT (schema_name, table_name, gid) FROM g)""")
def _(fx):
    rows, register = fx.sql(TABLE_ROWS), fx["placeholder_register"]
    path = scratch_path(fx.spark, "placeholders")
    # Every slice of the register comes with the first slice of the rows or before it.
    entries = scratch_path(fx.spark, "placeholder-entries")
    register.write.parquet(entries)
    registered = events.read_file_stream(fx.spark, entries, register.schema)
    run_out(stateful.placeholder_stream(sliced(fx, rows, "placeholder-rows"), registered, path, AS_OF, "loader"), fx.spark)
    return fx.spark.read.parquet(f"{path}/history").drop("batch_id")


@query("t08_periodic_reconcile", "SELECT b.batch_id, x.* FROM (SELECT unnest([0, 1]) AS batch_id) b, (" + OURS + FORWARD + ") x")
def _(fx):
    path = scratch_path(fx.spark, "reconciled")
    schemas, spaces = names.schema_names(fx["inv_tables"]), fx["external_workspaces"]
    ticks = sliced(fx, fx["schema_events"].select("seq"), "ticks", 2)
    run_out(events.reconcile_periodically(ticks, lambda: schemas, lambda: spaces, CFG, path), fx.spark)
    return fx.spark.read.parquet(path)
