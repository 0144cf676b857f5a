"""Keyed stateful streams.

Each key's state is a few values; Spark partitions and shuffles the keys. One micro-batch brings a
key at most what the source's trigger limit admits (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``),
which bounds what one call sorts. Ordering inside a batch is by (ts, seq); what arrives behind the
order already processed is never dropped silently but comes out marked late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablekeep.config import Config
from tablekeep.functions import naming
from tablekeep.operators.alerts import MICROS, fold_alerts
from tablekeep.operators.registers import KEY, _by_system_user, _clears, _creates_suffixed, governed


def _in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(by), kind="stable")


EVENT = "event"


def _packed(*columns: Column | str) -> Column:
    """One text column for what a fold reads: every column of a group costs a conversion per key and batch,
    which for keys of few rows is most of the work."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(EVENT)


def _unpacked(batches: Iterator[pd.DataFrame]) -> list[list]:
    """Packed rows of one key, ordered by the first two columns, missing values last."""
    rows = [list(json.loads(text).values()) for batch in batches for text in batch[EVENT].tolist()]
    return sorted(rows, key=lambda r: [(v is None, v) for v in r[:2]])


def suppress_alerts_stream(alerts: DataFrame, cooldown_seconds: int = 300) -> DataFrame:
    """T3 as a stream over ``alerts(seq, ts, subject)``: the alerts that go out, and with ``is_late``
    those that came behind what was already decided for their subject."""
    cooldown = cooldown_seconds * MICROS
    keyed = alerts.select("subject", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))

    def step(key, batches, state: GroupState):
        rows = _in_order(batches, "t", "seq")
        last, seen = state.get if state.exists else (None, None)
        late = rows["t"] < seen if seen is not None else pd.Series(False, rows.index)
        timely = rows[~late & (rows["t"] != seen)].drop_duplicates("t")
        sent, last = fold_alerts((int(t) for t in timely["t"]), last, cooldown)
        state.update((last, max([int(rows["t"].max())] + ([seen] if seen is not None else []))))
        out = pd.concat([timely[timely["t"].isin(sent)].assign(is_late=False), rows[late].assign(is_late=True)])
        yield out.assign(subject=key[0])[["subject", "seq", "t", "is_late"]]

    return keyed.groupBy("subject").applyInPandasWithState(
        step, "subject string, seq long, t long, is_late boolean", "last_sent long, seen long", "append", GroupStateTimeout.NoTimeout
    ).select("seq", F.timestamp_micros("t").alias("ts"), "subject", "is_late")


def pending_monitor(ddl_stream: DataFrame, cfg: Config, threshold: str = "2 hours", lateness: str = "0 seconds") -> DataFrame:
    """T4: alerts for tables whose geometry has not come within ``threshold``.

    Emits ``overdue`` (once per wait, stamped start plus threshold) and ``cleared`` when geometry or
    a drop ends a wait that was already overdue. The event-time timer fires without any new row.
    """
    limit = int(pd.Timedelta(threshold).total_seconds() * MICROS)
    mark = F.when(_clears(), "clear").when(_creates_suffixed() & _by_system_user(cfg), "set")
    marked = (
        ddl_stream.filter(governed())
        .withWatermark("ts", lateness)
        .withColumn("mark", mark)
        .filter("mark IS NOT NULL")
        .select(*KEY, "ts", _packed(F.unix_micros(F.col("ts")).alias("t"), "seq", "mark"))
    )

    def step(key, batches, state: GroupState):
        since, alerted = state.get if state.exists else (None, False)
        out = []

        def overdue() -> None:
            out.append((key[0], key[1], "overdue", since, since + limit))

        if state.hasTimedOut:
            if since is not None and not alerted:
                overdue()
                alerted = True
            state.update((since, alerted))
        else:
            for t, _, mark_ in _unpacked(batches):
                if since is not None and not alerted and t > since + limit:
                    overdue()
                    alerted = True
                if mark_ == "set" and since is None:
                    since, alerted = int(t), False
                elif mark_ == "clear" and since is not None:
                    if alerted:
                        out.append((key[0], key[1], "cleared", since, int(t)))
                    since, alerted = None, False
            state.update((since, alerted))
            if since is not None and not alerted:
                # Timers take milliseconds and must lie ahead of the watermark.
                state.setTimeoutTimestamp(max((since + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["schema_name", "table_name", "event", "since", "at"])

    found = marked.groupBy(*KEY).applyInPandasWithState(
        step,
        "schema_name string, table_name string, event string, since long, at long",
        "since long, alerted boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.withColumns({"since": F.timestamp_micros("since"), "at": F.timestamp_micros("at")})


# Row images travel as JSON text: exact for 64-bit numbers with NULLs, and open to any column name.
IMAGE_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def history_stream(feed: DataFrame, key: str, data: list[str]) -> DataFrame:
    """T5: history rows from a live feed (``key, ts, seq, op, changed_by`` + data).

    State per key: does the row exist, its image, its creation and last modification, and how far
    it has been processed. An event behind that point comes out with ``is_late`` and no effect.
    """
    stamps = "born long, born_by string, changed long, changed_by string"
    key_type = feed.schema[key].dataType.simpleString()
    out_type = f"h_type string, t long, h_by string, k {key_type}, seq long, image string, {stamps}, is_late boolean"
    names = T._parse_datatype_string(out_type).fieldNames()

    def step(k, batches, state: GroupState):
        state_ = state.get if state.exists else (False, *([None] * 7))
        live, image, born, born_by, changed, changed_by, done_t, done_seq = state_
        out = []
        for t, seq, op, by, now in _unpacked(batches):
            t, seq = int(t), int(seq)
            if done_t is not None and (t, seq) <= (done_t, done_seq):
                out.append((op, t, by, k[0], seq, now, None, None, None, None, True))
                continue
            done_t, done_seq = t, seq
            if op == "I" and not live:
                live, image, born, born_by, changed, changed_by = True, now, t, by, None, None
            elif op == "U" and live:
                out.append(("U", t, by, k[0], seq, image, born, born_by, changed, changed_by, False))
                image, changed, changed_by = now, t, by
            elif op == "D" and live:
                out.append(("D", t, by, k[0], seq, image, born, born_by, t, by, False))
                live = False
        state.update((live, image, born, born_by, changed, changed_by, done_t, done_seq))
        if out:
            # Objects keep whole numbers whole beside missing ones; only the key has a type of its own.
            frame = pd.DataFrame(out, columns=names, dtype=object)
            frame["k"] = frame["k"].infer_objects()
            yield frame

    image = F.to_json(F.struct(*data), IMAGE_OPTIONS).alias("image")
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    rows = feed.select(F.col(key).alias("k"), _packed(micros, "seq", "op", F.col("changed_by").alias("by"), image))
    state_type = f"live boolean, image string, {stamps}, done_t long, done_seq long"
    history = rows.groupBy("k").applyInPandasWithState(step, out_type, state_type, "append", GroupStateTimeout.NoTimeout)
    back = F.from_json("image", feed.select(*data).schema, IMAGE_OPTIONS)
    return history.withColumn("image", back).select(
        "h_type", F.timestamp_micros("t").alias("h_ts"), "h_by", F.col("k").alias(key), "seq", *(F.col("image")[c].alias(c) for c in data),
        F.timestamp_micros("born").alias("skapad_tidpunkt"), F.col("born_by").alias("skapad_av"),
        F.timestamp_micros("changed").alias("andrad_tidpunkt"), F.col("changed_by").alias("andrad_av"), "is_late",
    )


def write_history_and_late(history: DataFrame, path: str, late_path: str, key: list[str]):
    """Stream writer for T5: history rows to one table, late events to another. Both are written
    per batch id, so a repeated batch replaces itself."""
    from tablekeep.sources.tables import write_history

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_history(batch.filter("NOT is_late").drop("is_late"), path, key, batch_id=batch_id)
        batch.filter("is_late").drop("is_late").write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.unpersist()

    return history.writeStream.foreachBatch(run)


def placeholder_stream(rows: DataFrame, registered: DataFrame, path: str, as_of: str, user: str):
    """Stream writer that takes placeholder rows away once their table has a real row.

    ``rows`` (schema_name, table_name, gid and more) and ``registered`` (schema_name, table_name,
    gid) are both streams; an entry has to come in the batch of its row or before, else the row counts
    as real. Under ``path`` every batch writes its own folders: ``history`` (the ``D`` rows, as G13
    has them), ``spent`` (register entries that go), and ``state``, which the next batch reads: entries that
    stay with the row seen of each, and the tables that have real rows. A batch reads the state of the
    batch before it alone, and removes the one before that; a repeated batch replaces its folders.
    """
    spark, columns = rows.sparkSession, rows.columns
    image = F.struct(*columns)
    entry_type = rows.select(*KEY, "gid").schema
    state_type = T.StructType([*entry_type, T.StructField("real", T.BooleanType()), T.StructField("image", rows.select(image.alias("i")).schema["i"].dataType)])
    none = F.lit(None).cast(state_type["image"].dataType)
    both = rows.select(*KEY, "gid", image.alias("image")).unionByName(registered.select(*KEY, "gid", none.alias("image")))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if batch_id:
            before = spark.read.schema(state_type).parquet(f"{path}/state/batch_id={batch_id - 1}")
        else:
            before = spark.createDataFrame([], state_type)
        fresh = batch.filter("image IS NULL").select(*KEY, "gid").distinct()
        held = before.filter("gid IS NOT NULL")
        arrived = batch.filter("image IS NOT NULL")
        # A row seen twice keeps the first image that the state has; entries are few, rows are not.
        entries = held.select(*KEY, "gid", "image").unionByName(fresh.join(held.select(*KEY, "gid"), [*KEY, "gid"], "left_anti").withColumn("image", none))
        seen = arrived.join(entries.select(*KEY, "gid"), [*KEY, "gid"], "left_semi").groupBy(*KEY, "gid").agg(F.min_by("image", F.to_json("image")).alias("_seen"))
        entries = entries.join(seen, [*KEY, "gid"], "left").select(*KEY, "gid", F.coalesce("image", "_seen").alias("image"))
        # Real rows are counted per table before anything is joined, as in the batch operator.
        total = arrived.groupBy(*KEY).agg(F.count("*").alias("_n"))
        known = arrived.join(entries.select(*KEY, "gid"), [*KEY, "gid"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("_k"))
        real = total.join(known, KEY, "left").filter(F.col("_n") > F.coalesce("_k", F.lit(0))).select(*KEY)
        real = real.unionByName(before.filter("gid IS NULL").select(*KEY)).distinct()
        # An entry whose row is still to come stays until then, also where the table has real rows.
        judged = entries.join(real.withColumn("_real", F.lit(True)), KEY, "left").withColumn("_gone", F.col("_real").isNotNull() & F.col("image").isNotNull())
        stays = judged.filter("NOT _gone").select(*KEY, "gid", F.lit(False).alias("real"), "image")
        tables = real.select(*KEY, F.lit(None).cast(entry_type["gid"].dataType).alias("gid"), F.lit(True).alias("real"), none.alias("image"))
        gone = judged.filter("_gone")
        history = gone.select(
            F.lit("D").alias("h_type"), F.lit(as_of).cast("timestamp_ntz").alias("h_ts"), F.lit(user).alias("h_by"),
            *(F.col("image")[c].alias(c) for c in columns), F.lit(True).alias("is_placeholder"),
        )
        history.write.mode("overwrite").parquet(f"{path}/history/batch_id={batch_id}")
        gone.select(*KEY, "gid").write.mode("overwrite").parquet(f"{path}/spent/batch_id={batch_id}")
        stays.unionByName(tables).write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")
        if batch_id > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/batch_id={batch_id - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        batch.unpersist()

    return both.writeStream.foreachBatch(run)
