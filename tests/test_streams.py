"""Streams: late events, placeholder removal, periodic reconciliation."""

import datetime as dt
import glob
import json

import pandas as pd

from tablekeep.config import Config
from tablekeep.plans import alerting
from tablekeep.session import scratch_path
from tablekeep.sources.tables import read_history
from tablekeep.streaming import events, stateful

START = dt.datetime(2024, 1, 1)
CFG = Config()


def drain(writer, spark):
    writer.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()


def stream(spark, batches, schema):
    path = scratch_path(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return events.read_file_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_late_events_go_to_their_own_table(spark):
    schema = "gid long, ts timestamp, seq long, op string, changed_by string, v int"
    feed = stream(spark, [[(1, at(1), 1, "I", "a", 10), (1, at(3), 3, "U", "b", 30)], [(1, at(2), 2, "U", "c", 20), (1, at(4), 4, "D", "d", 0)]], schema)
    path, late = scratch_path(spark, "history"), scratch_path(spark, "late")
    drain(stateful.write_history_and_late(stateful.history_stream(feed, "gid", ["v"]), path, late, ["gid"]), spark)
    rows = sorted((r.h_type, r.seq, r.v) for r in read_history(spark, path).collect())
    assert rows == [("D", 4, 30), ("U", 3, 10)]
    assert [r.seq for r in spark.read.parquet(late).collect()] == [2]


def test_placeholders_go_with_the_first_real_row(spark):
    schema = "schema_name string, table_name string, gid long, body string"
    entry = "schema_name string, table_name string, gid long"
    rows = stream(
        spark,
        [[("s", "a_p", 1, "placeholder"), ("s", "b_p", 1, "placeholder")],
         [("s", "a_p", 2, "real"), ("s", "a_p", 1, "seen again"), ("s", "c_p", 5, "placeholder")],
         [("s", "a_p", 3, "real"), ("s", "c_p", 9, "real")],
         [("s", "a_p", 7, "placeholder, registered after real rows")]],
        schema,
    )
    registered = stream(spark, [[("s", "a_p", 1), ("s", "b_p", 1)], [("s", "c_p", 5)], [("s", "a_p", 7)], [("s", "b_p", 1)]], entry)
    path = scratch_path(spark, "removed")
    drain(stateful.placeholder_stream(rows, registered, path, "2024-02-01 00:00:00", "loader"), spark)
    got = sorted((r.table_name, r.gid, r.body, r.batch_id) for r in spark.read.parquet(f"{path}/history").collect())
    assert got == [("a_p", 1, "placeholder", 1), ("a_p", 7, "placeholder, registered after real rows", 3), ("c_p", 5, "placeholder", 2)]
    assert {(r.h_type, r.h_by, r.is_placeholder) for r in spark.read.parquet(f"{path}/history").collect()} == {("D", "loader", True)}
    spent = sorted((r.table_name, r.gid, r.batch_id) for r in spark.read.parquet(f"{path}/spent").collect())
    assert spent == [("a_p", 1, 1), ("a_p", 7, 3), ("c_p", 5, 2)]
    kept = spark.read.parquet(f"{path}/state")
    assert {r.batch_id for r in kept.select("batch_id").distinct().collect()} == {2, 3}  # earlier states are gone
    assert [(r.table_name, r.gid) for r in kept.filter("batch_id = 3 AND gid IS NOT NULL").collect()] == [("b_p", 1)]


def test_events_without_payload_have_their_own_sink(spark):
    rows = stream(spark, [[(1, at(1), "schema_create", "sk0_ext_a"), (2, at(1), "schema_drop", "")], [(3, at(2), "schema_drop", None)]], events.EVENT_SCHEMA)
    path = scratch_path(spark, "sinks")
    drain(events.write_schema_events(rows, path), spark)
    got = {name: sorted((r.seq, r.batch_id) for r in spark.read.parquet(f"{path}/{name}").collect()) for name in ("events", "empty")}
    assert got == {"events": [(1, 0)], "empty": [(2, 0), (3, 1)]}


def test_periodic_reconcile(spark):
    ticks = stream(spark, [[(1,)], [(2,)]], "n long")
    path = scratch_path(spark, "reconciled")
    schemas = spark.createDataFrame([("sk0_ext_a",), ("sk2_kba_b",)], "schema_name string")
    spaces = spark.createDataFrame([("sk0_ext_gone",), ("demo",)], "workspace string")
    drain(events.reconcile_periodically(ticks, lambda: schemas, lambda: spaces, CFG, path), spark)
    got = sorted((r.schema_name, r.action, r.batch_id) for r in spark.read.parquet(path).collect())
    assert got == sorted((n, a, b) for b in (0, 1) for n, a in (("sk0_ext_a", "create"), ("sk0_ext_gone", "orphan")))


def test_pending_timer_fires_without_new_rows_of_the_table(spark):
    schema = (
        "seq long, ts timestamp, schema_name string, table_name string, command string, session_user_name string, "
        "current_user_name string, application_name string, geom_type string"
    )

    def row(seq, hours, table, command, geom=None):
        return (seq, at(hours), "sk0_ext_a", table, command, "fme", "x", "y", geom)

    ddl = stream(
        spark,
        [[row(1, 0, "slow_p", "CREATE TABLE"), row(2, 0, "quick_l", "CREATE TABLE")],
         [row(3, 1, "quick_l", "ADD GEOMETRY", "LINESTRING")],
         [row(4, 5, "other_y", "CREATE TABLE")],
         [row(5, 6, "slow_p", "ADD GEOMETRY", "POINT")]],
        schema,
    )
    path = scratch_path(spark, "overdue")
    found = stateful.pending_monitor(ddl, CFG)
    drain(found.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    got = sorted((r.table_name, r.event, r.at) for r in spark.read.parquet(path).collect())
    assert got == [("slow_p", "cleared", at(6)), ("slow_p", "overdue", at(2))]


def test_late_alerts_are_marked(spark):
    schema = "seq long, ts timestamp, subject string"
    found = stateful.suppress_alerts_stream(stream(spark, [[(1, at(5), "a")], [(2, at(0), "a"), (3, at(6), "a")]], schema))
    path = scratch_path(spark, "alerts")
    drain(found.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    assert sorted((r.seq, r.is_late) for r in spark.read.parquet(path).collect()) == [(1, False), (2, True), (3, False)]


def test_images_are_exact_under_any_name(spark):
    schema = "gid long, ts timestamp, seq long, op string, changed_by string, _x long, t timestamp_ntz, image decimal(38,10)"
    big, moment = 9007199254740993, dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    rows = [[(1, at(1), 1, "I", "a", big, moment, None), (2, at(1), 2, "I", "a", None, None, None)], [(1, at(2), 3, "U", "b", 1, None, None), (2, at(2), 4, "D", "b", None, None, None)]]
    found = stateful.history_stream(stream(spark, rows, schema), "gid", ["_x", "t", "image"])
    path = scratch_path(spark, "exact")
    drain(found.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    assert sorted((r.gid, r.h_type, r["_x"], r.t) for r in spark.read.parquet(path).select("gid", "h_type", "_x", "t").collect()) == [(1, "U", big, moment), (2, "D", None, None)]


def test_slices_are_many_files(spark, monkeypatch):
    """No task writes or reads a whole slice, and every trigger takes one slice."""
    monkeypatch.setattr(alerting, "FILE_ROWS", 100)
    monkeypatch.setattr(alerting, "SURE_ROWS", 50)
    paths = []
    monkeypatch.setattr(alerting, "scratch_path", lambda spark, label: paths.append(scratch_path(spark, label)) or paths[-1])

    class Inputs(dict):
        pass

    fx = Inputs(v=spark.range(1800, numPartitions=4).selectExpr("id AS seq", "timestamp_seconds(id) AS ts"))
    fx.spark = spark
    for streamed in (alerting.stream_of(fx, "v"), alerting.sliced(fx, fx["v"], "v")):
        files = glob.glob(f"{paths[-1]}/*.parquet")
        assert len(files) % 3 == 0 and len(files) >= 15
        assert max(spark.read.parquet(f).count() for f in files) <= 200
        batches = []
        drain(streamed.writeStream.foreachBatch(lambda df, i: batches.append([r.seq for r in df.select("seq").collect()])), spark)
        assert sorted(x for b in batches for x in b) == list(range(1800)) and len(batches) == 3
        if streamed.columns and len(paths) == 1:
            assert [sorted(b) for b in batches] == [list(range(k * 600, k * 600 + 600)) for k in range(3)]


def test_rows_of_a_key_come_packed_and_in_order(spark):
    rows = [(2, 9007199254740993, "a"), (None, 1, "b"), (2, 5, None), (1, 7, "c")]
    packed = spark.createDataFrame(rows, "t long, seq long, mark string").select(stateful._packed("t", "seq", "mark"))
    texts = [r.event for r in packed.collect()]
    assert json.loads(texts[2]) == {"t": 2, "seq": 5, "mark": None}
    frames = iter([pd.DataFrame({"event": texts[:2]}), pd.DataFrame({"event": texts[2:]})])
    assert stateful._unpacked(frames) == [[1, 7, "c"], [2, 5, None], [2, 9007199254740993, "a"], [None, 1, "b"]]
