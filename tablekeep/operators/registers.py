"""Registers of pending geometry, SRID deviations and placeholder rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.functions import naming
from tablekeep.operators.names import needs_geometry_validation
from tablekeep.operators.ordering import cut_by_rows, last_before

KEY = ["schema_name", "table_name"]
SESSION = ["session_user_name", "current_user_name", "application_name"]


# ------------------------------------------------------------------ pending geometry
def _by_system_user(cfg: Config) -> Column:
    return reduce(
        lambda a, b: a | b, (F.coalesce(F.lower(c).isin(*cfg.system_users), F.lit(False)) for c in SESSION)
    )


def _own_suffix() -> Column:
    """Geometry suffix a name really has, NULL when it has none."""
    return F.when(F.col("table_name").rlike(naming.GEOMETRY_SUFFIX), F.right("table_name", F.lit(2)))


def _creates_suffixed() -> Column:
    return (F.col("command") == "CREATE TABLE") & F.col("geom_type").isNull() & _own_suffix().isNotNull()


def _suffix_conflict() -> Column:
    return _own_suffix().isNotNull() & (_own_suffix() != naming.expected_suffix(naming.basal_type(F.col("geom_type"))))


def _clears() -> Column:
    """A drop, or a geometry that fits the name; a conflicting geometry is rejected."""
    arrived = (F.col("command") == "ADD GEOMETRY") & F.col("geom_type").isNotNull()
    return (F.col("command") == "DROP TABLE") | (arrived & ~_suffix_conflict())


def governed() -> Column:
    """Log rows the standard applies to: no table of the public or a temporary schema."""
    return (F.col("schema_name") != "public") & ~F.col("schema_name").rlike("^pg_temp")


def pending_from_log(ddl_log: DataFrame, cfg: Config) -> DataFrame:
    """M1: tables still waiting for their geometry. A system user created them with a geometry
    suffix but no geometry; the first such creation since the last clearing counts."""
    ddl_log = ddl_log.filter(governed())
    last_clear = ddl_log.filter(_clears()).groupBy(*KEY).agg(F.max("seq").alias("_cleared"))
    created = ddl_log.filter(_creates_suffixed() & _by_system_user(cfg)).select(*KEY, "seq", "ts", "session_user_name")
    waiting = created.join(last_clear, KEY, "left").filter("_cleared IS NULL OR seq > _cleared")
    first = waiting.groupBy(*KEY).agg(F.min_by(F.struct("ts", "session_user_name"), "seq").alias("_first"))
    return first.select(*KEY, F.col("_first.ts").alias("registered_at"), F.col("_first.session_user_name").alias("registered_by"))


def rejected_creations(ddl_log: DataFrame, cfg: Config) -> DataFrame:
    """M1: the same creation by anyone else is refused: the suffix is reserved."""
    return ddl_log.filter(governed() & _creates_suffixed() & ~_by_system_user(cfg)).select(
        "seq", *KEY, F.lit("reserved_suffix").alias("code")
    )


def geometry_arrivals(ddl_log: DataFrame, cfg: Config) -> DataFrame:
    """M2/M3: every added geometry column judged by whether its table was pending just then.

    Pending tables: a name whose suffix contradicts the type is a conflict and stays pending.
    Other tables: the usual suffix test, with the name to use instead.
    """
    mark = F.when(_clears(), F.lit(False)).when(_creates_suffixed() & _by_system_user(cfg), F.lit(True))
    log = cut_by_rows(ddl_log.filter(governed()), [*KEY, "seq"])
    marked = last_before(log, KEY, ["seq"], F.col("_piece"), mark, "_pending")
    arrivals = marked.filter((F.col("command") == "ADD GEOMETRY") & F.col("geom_type").isNotNull())
    basal = naming.basal_type(F.col("geom_type"))
    wanted = naming.expected_suffix(basal)
    pending = F.coalesce("_pending", F.lit(False))
    fits = naming.ends_with_suffix(F.col("table_name"), wanted)
    outcome = F.when(pending, F.when(_suffix_conflict(), "suffix_conflict").otherwise("completed")).otherwise(
        F.when(fits, "accepted").otherwise("wrong_suffix")
    )
    return arrivals.select(
        "seq", *KEY, pending.alias("was_pending"), wanted.alias("expected_suffix"), outcome.alias("outcome"),
        F.when(outcome == "wrong_suffix", naming.suggest_name(F.col("table_name"), basal)).alias("suggested_name"),
    )


def pending_suffix_conflicts(ddl_log: DataFrame, cfg: Config) -> DataFrame:
    """M2: geometry refused because a pending table's name says something else."""
    return geometry_arrivals(ddl_log, cfg).filter("outcome = 'suffix_conflict'").select("seq", *KEY, "expected_suffix")


def unregistered_geometry(ddl_log: DataFrame, cfg: Config) -> DataFrame:
    """M3: geometry refused on a table that was not pending, with the suggested name."""
    return geometry_arrivals(ddl_log, cfg).filter("outcome = 'wrong_suffix'").select(
        "seq", *KEY, "expected_suffix", "suggested_name"
    )


def pending_age(pending: DataFrame, as_of: str, alert_after: str = "2 hours") -> DataFrame:
    """M4: how long each table has waited and how to read it: minutes are normal, hours suggest
    a crashed load, days an abandoned table."""
    now = F.lit(as_of).cast("timestamp_ntz")
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("registered_at").cast("timestamp"))
    status = F.when(seconds < 3600, "normal").when(seconds < 86400, "likely_failed").otherwise("critical")
    alert = F.col("registered_at") < now - F.expr(f"INTERVAL {alert_after}")
    return pending.select(*KEY, "registered_by", seconds.alias("elapsed_seconds"), status.alias("status"), alert.alias("alert"))


# ------------------------------------------------------------------ maintenance
def missing_row_rules(
    inv_tables: DataFrame,
    gid_tables: DataFrame,
    inv_geometry: DataFrame,
    placeholders: DataFrame,
    qa_functions: DataFrame,
    inv_triggers: DataFrame,
    cfg: Config,
) -> DataFrame:
    """M5: the four row rules each table should carry, and whether each is there already.

    ``gid_tables`` lists tables with an identity ``gid``. History tables get no geometry check.
    """
    tables = inv_tables.select(*KEY).distinct()
    own = F.col("schema_name").rlike(cfg.level_pattern())
    key = gid_tables.filter(own).select(*KEY, F.lit("force_gid").alias("rule")).distinct()
    is_history = F.col("table_name").rlike(naming.HISTORY_SUFFIX)
    parents = tables.select("schema_name", F.concat("table_name", F.lit("_h")).alias("table_name"))
    with_geom = inv_geometry.filter((F.col("geometry_column") == "geom") & needs_geometry_validation("schema_name", cfg)).select(*KEY).distinct()
    checked = with_geom.filter(~is_history).unionByName(with_geom.filter(is_history).join(parents, KEY, "left_anti"))
    check = checked.select(*KEY, F.lit("check_geometry").alias("rule"))
    placeholder = (
        placeholders.select(*KEY).distinct().join(tables, KEY, "left_semi").select(*KEY, F.lit("drop_placeholder").alias("rule"))
    )
    pattern = "^trg_fn_(.+)_qa$"
    history = (
        qa_functions.filter(own & F.col("function_name").rlike(pattern))
        .select("schema_name", F.regexp_extract("function_name", pattern, 1).alias("table_name"))
        .distinct()
        .join(tables, KEY, "left_semi")
        .select(*KEY, F.concat(F.lit("trg_"), "table_name", F.lit("_qa")).alias("rule"))
    )
    wanted = reduce(DataFrame.unionByName, (key, check, placeholder, history))
    there = inv_triggers.select(*KEY, F.col("trigger_name").alias("rule")).distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, [*KEY, "rule"], "left").select(
        *KEY, "rule", F.when(F.col("_there"), "exists").otherwise("create").alias("action")
    )


def action_summary(actions: DataFrame) -> DataFrame:
    """How many tables per rule and action."""
    kind = F.when(F.col("rule").rlike("^trg_.+_qa$"), "history").otherwise(F.col("rule"))
    return actions.groupBy(kind.alias("rule_kind"), "action").agg(F.count("*").alias("n_tables"))


def stale_registers(register: DataFrame, inv_tables: DataFrame) -> DataFrame:
    """M6: register rows whose table is gone."""
    return register.join(inv_tables.select(*KEY).distinct(), KEY, "left_anti")


def duplicate_spatial_indexes(inv_indexes: DataFrame) -> DataFrame:
    """M7: spatial indexes under any other name than the standard one."""
    standard = F.concat(F.left("table_name", F.lit(naming.INDEX_STEM)), F.lit("_geom_gidx"))
    return inv_indexes.filter((F.col("method") == "gist") & (F.col("index_name") != standard)).select(*KEY, "index_name")


# ------------------------------------------------------------------ SRID deviations
def srid_deviations(inv_geometry: DataFrame, cfg: Config, as_of: str, user: str, scope: DataFrame) -> DataFrame:
    """Tables of ``scope`` (N15) whose SRID is set and not the expected one, as register rows."""
    return (
        inv_geometry.join(scope.select(*KEY).distinct(), KEY, "left_semi").filter(F.col("srid").isNotNull() & (F.col("srid") != cfg.expected_srid))
        .groupBy(*KEY)
        .agg(F.min("srid").alias("srid"))
        .select(*KEY, "srid", F.lit(as_of).cast("timestamp_ntz").alias("registered_at"), F.lit(user).alias("registered_by"))
    )


def merge_register(current: DataFrame, incoming: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """Insert-or-update (incoming wins) or insert-or-ignore (current wins) by key."""
    columns = [c for c in current.columns if c not in key]
    first, second = (incoming, current) if update else (current, incoming)
    a = first.select(*key, F.struct(*columns).alias("_first"))
    b = second.select(*key, F.struct(*columns).alias("_second"))
    row = F.coalesce("_first", "_second")
    return a.join(b, key, "full_outer").select(*key, *(row[c].alias(c) for c in columns))


# ------------------------------------------------------------------ placeholder rows
# Placeholder geometry per basal type; anything else gets the polygon.
_SQUARE = "((160000 6395000, 160100 6395000, 160100 6395100, 160000 6395100, 160000 6395000))"
PLACEHOLDERS = {
    "POINT": "POINT(160000 6395000)",
    "MULTIPOINT": "MULTIPOINT((160000 6395000))",
    "LINESTRING": "LINESTRING(160000 6395000, 160100 6395100)",
    "MULTILINESTRING": "MULTILINESTRING((160000 6395000, 160100 6395100))",
    "POLYGON": "POLYGON" + _SQUARE,
    "MULTIPOLYGON": "MULTIPOLYGON(" + _SQUARE + ")",
}


def placeholder_geometry(inv_geometry: DataFrame) -> DataFrame:
    """The placeholder every geometry table starts with."""
    basal = naming.basal_type(F.col("type"))
    wkt = F.lit(PLACEHOLDERS["POLYGON"])
    for name, text in PLACEHOLDERS.items():
        wkt = F.when(basal == name, text).otherwise(wkt)
    return inv_geometry.filter("geometry_column = 'geom'").select(*KEY, wkt.alias("placeholder"), "srid")


def tables_with_real_rows(rows: DataFrame, register: DataFrame) -> DataFrame:
    """Registered tables that hold more rows than the register lists of them. Rows are counted
    per table before anything is joined, so one table with most of the rows is no hot key."""
    listed = register.select(*KEY, "gid").distinct()
    total = rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
    known = rows.select(*KEY, "gid").join(listed, [*KEY, "gid"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("_k"))
    return (
        total.join(listed.select(*KEY).distinct(), KEY, "left_semi")
        .join(known, KEY, "left")
        .filter(F.col("_n") > F.coalesce("_k", F.lit(0)))
        .select(*KEY)
    )


def drop_placeholders(rows: DataFrame, register: DataFrame, as_of: str, user: str) -> dict[str, DataFrame]:
    """Once a table has a real row its placeholders go: the rows that stay, the register
    that stays, and the ``D`` history the removal leaves."""
    ready = tables_with_real_rows(rows, register)
    spent = register.join(ready, KEY, "left_semi")
    gone = spent.select(*KEY, "gid")
    removed = rows.join(gone, [*KEY, "gid"], "left_semi")
    return {
        "rows": rows.join(gone, [*KEY, "gid"], "left_anti"),
        "register": register.join(ready, KEY, "left_anti"),
        "history": removed.select(
            F.lit("D").alias("h_type"), F.lit(as_of).cast("timestamp_ntz").alias("h_ts"), F.lit(user).alias("h_by"),
            *rows.columns, F.lit(True).alias("is_placeholder"),
        ),
    }
