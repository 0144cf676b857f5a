"""Reconcile expected and actual state; lifecycle events and call outcomes in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators.names import publishable_schemas
from tablekeep.operators.ordering import cut_by_rows, running_count

# The two event channels and the retry policy.
CREATE, DROP = "schema_create", "schema_drop"
RETRY_WAITS = (2, 5, 10)
MAX_ATTEMPTS = 1 + len(RETRY_WAITS)


def reconcile(schemas: DataFrame, workspaces: DataFrame, cfg: Config, known_elsewhere: DataFrame | None = None) -> DataFrame:
    """``create`` what only we have, ``refresh`` what both have, report as ``orphan`` what only
    the other side has although its name is ours. Nothing is ever deleted.

    With several databases, names known to any of them are no orphans, and a database only judges
    levels it has schemas of; with a single one that has nothing published every matching
    name is an orphan.
    """
    ours = publishable_schemas(schemas, cfg).distinct()
    theirs = workspaces.select(F.col("workspace").alias("schema_name")).distinct()
    known = ours if known_elsewhere is None else ours.unionByName(known_elsewhere.select("schema_name")).distinct()
    both = ours.withColumn("_o", F.lit(True)).join(theirs.withColumn("_t", F.lit(True)), "schema_name", "left")
    forward = both.select("schema_name", F.when(F.col("_t").isNull(), "create").otherwise("refresh").alias("action"))
    level = F.substring_index("schema_name", "_", 1).alias("_level")
    extra = theirs.join(known, "schema_name", "left_anti").filter(F.col("schema_name").rlike(cfg.schema_pattern()))
    levels = ours.select(level).distinct()  # one row per level, whatever the number of schemas
    judged = extra.select("schema_name", level).join(levels, "_level", "left_semi").select("schema_name")
    if known_elsewhere is None:
        # One row at most: does this database publish anything at all?
        nothing = F.broadcast(ours.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(True).alias("_all")))
        judged = judged.unionByName(extra.withColumn("_all", F.lit(True)).join(nothing, "_all", "left_semi").select("schema_name"))
    return forward.unionByName(judged.select("schema_name", F.lit("orphan").alias("action")))


def set_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """What each side has that the other lacks."""
    a = ours.select("schema_name").distinct()
    b = theirs.select("schema_name").distinct()
    return (
        a.withColumn("_a", F.lit(True))
        .join(b.withColumn("_b", F.lit(True)), "schema_name", "full_outer")
        .filter("_a IS NULL OR _b IS NULL")
        .select("schema_name", F.when(F.col("_b").isNull(), "ours").otherwise("theirs").alias("only_in"))
    )


def valid_events(events: DataFrame, cfg: Config) -> DataFrame:
    """Second gate: empty payloads and names outside the pattern never reach a handler."""
    return events.filter((F.col("payload") != "") & F.col("payload").rlike(cfg.schema_pattern()))


def lifecycle_state(events: DataFrame, cfg: Config) -> DataFrame:
    """Current state per schema, from the latest create or drop event."""
    last = valid_events(events, cfg).groupBy(F.col("payload").alias("schema_name")).agg(
        F.max(F.struct("ts", "seq", "channel")).alias("last"), F.count("*").alias("n_events")
    )
    return last.select(
        "schema_name",
        F.when(F.col("last.channel") == CREATE, "present").otherwise("dropped").alias("state"),
        F.col("last.ts").alias("since"),
        "n_events",
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """One event per channel and payload, the first; a resend changes nothing."""
    return (
        events.groupBy("channel", "payload")
        .agg(F.min(F.struct("ts", "seq")).alias("first"))
        .select("channel", "payload", "first.ts", "first.seq")
    )


def classify_attempts(outcomes: DataFrame) -> DataFrame:
    """Every attempt of a call numbered and judged. Timeouts and connection errors are
    transient and wait 2, 5, 10 seconds for the next try; a response is final."""
    ordered = cut_by_rows(outcomes, ["call_id", "seq"])
    numbered = running_count(ordered, ["call_id"], "seq", F.lit(True), "attempt", "_piece").drop("_piece")
    transient = F.col("outcome").isin("timeout", "connection_error")
    kind = F.when(transient, "transient").when(F.col("status_code") >= 400, "permanent").otherwise("delivered")
    wait = F.lit(None).cast("int")
    for i, seconds in enumerate(RETRY_WAITS, start=1):
        wait = F.when(transient & (F.col("attempt") == i), seconds).otherwise(wait)
    return numbered.select("call_id", "seq", "attempt", "channel", kind.alias("kind"), wait.alias("wait_seconds"))


def classify_failures(outcomes: DataFrame) -> DataFrame:
    """Calls that failed for good, and calls given up after the last allowed try, with the
    channel to send again. A call ends with its first answer, whatever the log holds after it."""
    tried = classify_attempts(outcomes).filter(F.col("attempt") <= MAX_ATTEMPTS)
    answered = F.col("kind") != "transient"
    calls = tried.groupBy("call_id").agg(
        F.min_by("kind", F.when(answered, F.col("attempt"))).alias("answer"),
        F.min(F.when(answered, F.col("attempt"))).alias("answered_at"),
        F.count("*").alias("n"),
        F.max_by("channel", "attempt").alias("channel"),
    )
    attempts = F.coalesce("answered_at", "n")
    status = F.when(F.col("answer") == "permanent", "failed").when(
        F.col("answer").isNull() & (F.col("n") == MAX_ATTEMPTS), "given_up"
    )
    waited = F.array(*(F.lit(sum(RETRY_WAITS[:i])) for i in range(MAX_ATTEMPTS)))
    return calls.withColumn("status", status).filter("status IS NOT NULL").select(
        "call_id", "status", attempts.cast("int").alias("attempts"),
        F.element_at(waited, attempts.cast("int")).alias("waited_seconds"),
        F.when(F.col("status") == "given_up", F.col("channel")).alias("resend_channel"),
    )
