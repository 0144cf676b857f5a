"""The change-feed fold against a plain loop, with one key holding most of the feed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import history

START = dt.datetime(2024, 1, 1)


def feed_rows(n, seed, step=90):
    rng = random.Random(seed)
    rows, moment = [], START
    for seq in range(n):
        moment += dt.timedelta(minutes=rng.randint(0, step))
        key = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        rows.append((key, moment, seq, rng.choice("IUUUD"), f"u{rng.randint(0, 2)}", rng.choice([None, 1, 2, 3])))
    return rows


def fold(rows, current):
    state = {k: dict(live=True, v=v, ct=ct, cb=cb, mt=mt, mb=mb) for k, v, ct, cb, mt, mb in current}
    log = []
    for key, ts, seq, op, by, v in rows:
        s = state.setdefault(key, dict(live=False))
        if op == "I" and not s["live"]:
            s.update(live=True, v=v, ct=ts, cb=by, mt=None, mb=None)
        elif op == "U" and s["live"]:
            log.append(("U", ts, by, key, seq, s["v"], s["ct"], s["cb"], s["mt"], s["mb"]))
            s.update(v=v, mt=ts, mb=by)
        elif op == "D" and s["live"]:
            log.append(("D", ts, by, key, seq, s["v"], s["ct"], s["cb"], ts, by))
            s["live"] = False
    table = [(k, s["v"], s["ct"], s["cb"], s["mt"], s["mb"]) for k, s in state.items() if s["live"]]
    return sorted(log, key=str), sorted(table, key=str)


@pytest.mark.parametrize("step", [0, 90, 3000])
def test_feed_matches_loop(spark, step):
    """One key has 60% of the changes; with step 0 all of them in one moment."""
    rows = feed_rows(400, 3, step)
    current = [(1, 9, START, "import", None, None), (99, 5, START, "import", START, "x")]
    feed = spark.createDataFrame(rows, "gid long, ts timestamp_ntz, seq long, op string, changed_by string, v int")
    now = spark.createDataFrame(
        current, "gid long, v int, skapad_tidpunkt timestamp_ntz, skapad_av string, andrad_tidpunkt timestamp_ntz, andrad_av string"
    )
    want_log, want_table = fold(rows, current)
    log = history.history_from_changes(feed, ["gid"], ["v"], current=now)
    assert sorted((tuple(r) for r in log.collect()), key=str) == want_log
    table = history.apply_changes(now, feed, ["gid"], ["v"])
    assert sorted((tuple(r) for r in table.collect()), key=str) == want_table


def test_history_schema(spark):
    parent = spark.createDataFrame([(1, "a")], "gid long, namn string")
    assert history.history_schema(parent.schema).fieldNames() == ["h_type", "h_ts", "h_by", "gid", "namn"]


def test_registers_follow_the_lives_of_a_table(spark):
    """Dropped, made again and registered: the new row stays, in every register and for every scope rule."""
    log = spark.createDataFrame(
        [(1, "CREATE TABLE", 1, "sk1_kba_a", "t"), (5, "DROP TABLE", 1, "sk1_kba_a", "t"), (6, "CREATE TABLE", 2, "sk1_kba_a", "t"),
         (8, "DROP TABLE", 3, "public", "t"), (9, "DROP TABLE", 4, "pg_temp_1", "t"), (9, "DROP TABLE", 5, "sk1_kba_a", "u_h"),
         (10, "DROP TABLE", 6, "sk1_kba_a", "moved"), (11, "DROP TABLE", 7, "sk1_kba_a", "v"), (12, "DROP TABLE", 8, "sk1_kba_a", "v")],
        "seq long, command string, table_id long, schema_name string, table_name string",
    )
    rows = [("sk1_kba_a", "t", 2), ("sk1_kba_a", "t", 7), ("sk1_kba_a", "t", None), ("public", "t", 1), ("pg_temp_1", "t", 1), ("sk1_kba_a", "u_h", 1),
            ("sk1_kba_a", "moved", 3), ("sk1_kba_a", "v", 11), ("sk1_kba_a", "v", 13), ("sk1_kba_a", "other", None)]
    register = spark.createDataFrame(rows, "schema_name string, table_name string, seq long")
    left = history.registers_after_drop(register, log, internal=F.col("table_name") == "moved")
    gone = {("sk1_kba_a", "t", 2), ("sk1_kba_a", "t", None), ("sk1_kba_a", "v", 11)}
    assert {tuple(r) for r in left.collect()} == set(rows) - gone
    lives = {(r.schema_name, r.table_name, r.life): (r.since, r.until) for r in history.table_lifetimes(log).collect()}
    assert [lives["sk1_kba_a", "v", k] for k in (1, 2, 3)] == [(None, 11), (11, 12), (12, None)]
    assert lives["public", "t", 1] == (None, None) and ("public", "t", 2) not in lives
    metadata = spark.createDataFrame([(1, "old_h", "trg_own"), (2, "t_h", None), (3, "x_h", None)], "table_id long, history_table string, trigger_function string")
    assert {r.table_id for r in history.metadata_after_drop(metadata, log).collect()} == {2, 3}
    there = spark.createDataFrame([("sk1_kba_a", "old_h")], "schema_name string, table_name string")
    functions = spark.createDataFrame([("sk1_kba_a", "trg_own"), ("sk1_kba_a", "trg_fn_v_qa")], "schema_name string, function_name string")
    got = {(r.table_id, r.history_table, r.history_exists, r.trigger_function, r.function_exists) for r in history.drop_cleanup(log, metadata, there, functions).collect()}
    assert got == {(1, "old_h", True, "trg_own", True), (6, "moved_h", False, "trg_fn_moved_qa", False), (7, "v_h", False, "trg_fn_v_qa", True), (8, "v_h", False, "trg_fn_v_qa", True)}
