"""Row history: derive it from snapshots or a change feed, query it, restore from it.

History model: an update logs the OLD row as ``U``; a delete logs the row as ``D`` with the
history-tracked columns overwritten by the time and user of the delete; inserts are not logged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablekeep.config import Config
from tablekeep.functions import naming, types
from tablekeep.operators.conform import default_value, matching_columns, render_types
from tablekeep.operators.ordering import cut_by_rows, neighbour, running_count

KEY = ["schema_name", "table_name"]
HEADER = ["h_type", "h_ts", "h_by"]
CREATED = ("skapad_tidpunkt", "skapad_av")
MODIFIED = ("andrad_tidpunkt", "andrad_av")


# ------------------------------------------------------------------ what is tracked
def qa_columns(inv_columns: DataFrame, cfg: Config) -> DataFrame:
    """H1: history-tracked standard columns each table really has; no row means no history."""
    tracked = [c for c in cfg.columns if c.track_history and c.default is not None]
    default = F.lit(None).cast("string")
    for c in tracked:
        default = F.when(F.col("column_name") == c.name, c.default).otherwise(default)
    return inv_columns.filter(F.col("column_name").isin(*[c.name for c in tracked])).select(
        *KEY, "column_name", default.alias("expression")
    )


def tracked_names(df: DataFrame, schema: str, cfg: Config) -> list[str]:
    """H1 for one DataFrame."""
    return [
        c.name
        for c in matching_columns(schema, cfg, df)
        if c.track_history and c.default is not None and c.name in df.columns
    ]


def history_schema(parent: T.StructType) -> T.StructType:
    """H2: three header columns, then the parent's columns with full types, nullable."""
    header = T.StructType(
        [
            T.StructField("h_type", T.StringType(), False),
            T.StructField("h_ts", T.TimestampType(), False),
            T.StructField("h_by", T.StringType(), False),
        ]
    )
    return T.StructType(header.fields + [T.StructField(f.name, f.dataType, True) for f in parent.fields])


def history_layouts(inv_columns: DataFrame) -> DataFrame:
    """H2 as a set: column list of the history table of every table in the inventory. User
    columns keep their order behind the header; a table's column count is bounded."""
    header = F.array(
        *(
            F.struct(F.lit(-3 + i).alias("sort_key"), F.lit(n).alias("column_name"), F.lit(t).alias("full_type"))
            for i, (n, t) in enumerate([("h_type", "char(1)"), ("h_ts", "timestamptz"), ("h_by", "text")])
        )
    )
    tables = inv_columns.select(*KEY).distinct()
    rows = tables.select(*KEY, F.inline(header)).unionByName(
        render_types(inv_columns).select(*KEY, F.col("ordinal_position").alias("sort_key"), "column_name", "full_type")
    )
    place = Window.partitionBy(*KEY).orderBy("sort_key")
    return rows.select(
        "schema_name",
        "table_name",
        naming.history_name(F.col("table_name")).alias("history_table"),
        F.row_number().over(place).alias("position"),
        "column_name",
        "full_type",
    )


# ------------------------------------------------------------------ from two snapshots
def history_from_snapshots(
    before: DataFrame, after: DataFrame, key: list[str], as_of: str, user: str, tracked: list[str] | Mapping[str, str]
) -> DataFrame:
    """H3: history that turns ``before`` into ``after``. One shuffle of each side by key.

    A deleted row's tracked columns get their own default expressions: ``tracked`` maps columns to
    them, or lists columns of the shipped standard.
    """
    if not isinstance(tracked, Mapping):
        shipped = {c.name: c.default for c in Config().columns}
        tracked = {c: shipped[c] for c in tracked}
    columns = before.columns
    tested = [c for c in columns if c not in key and c not in tracked]
    old = before.select(*key, F.struct(*columns).alias("_old"))
    new = after.select(*key, F.struct(*tested).alias("_new"))
    joined = old.join(new, key, "left")
    old_values = F.struct(*(F.col("_old")[c].alias(c) for c in tested))
    gone = F.col("_new").isNull()
    changed = joined.filter(gone | ~old_values.eqNullSafe(F.col("_new")))
    stamp = {c: default_value(text, as_of, user) for c, text in tracked.items()}
    images = [
        F.when(gone, stamp[c].cast(before.schema[c].dataType)).otherwise(F.col("_old")[c]).alias(c)
        if c in stamp
        else F.col("_old")[c].alias(c)
        for c in columns
    ]
    return changed.select(
        F.when(gone, "D").otherwise("U").alias("h_type"),
        F.lit(as_of).cast("timestamp_ntz").alias("h_ts"),
        F.lit(user).alias("h_by"),
        *images,
    )


# ------------------------------------------------------------------ from a change feed
def _last_before(value: Column, within) -> Column:
    return F.last(value, ignorenulls=True).over(within)


class _Feed:
    """A change feed cut into pieces of bounded row count.

    Whether a change has any effect depends on whether the row exists at that moment, which only
    the last insert or delete before it decides. Inside a piece that is a window; across pieces it
    is carried by a summary of one row per key and piece, kept for both possible starting states so
    that the feed itself is read once; later passes read the pieces.
    """

    def __init__(self, feed: DataFrame, key: list[str], data: list[str], current: DataFrame | None):
        self.key, self.data, self.feed_types = key, data, feed.schema
        order = F.struct("ts", "seq")
        exists_op = F.when(F.col("op").isin("I", "D"), F.col("op"))
        self.within = Window.partitionBy(*key, "_chunk").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
        image = F.struct(
            *data,
            F.when(F.col("op") == "U", F.col("ts")).alias("modified_at"),
            F.when(F.col("op") == "U", F.col("changed_by")).alias("modified_by"),
        )
        born = F.struct(F.col("ts").alias("created_at"), F.col("changed_by").alias("created_by"))
        self.rows = (
            cut_by_rows(feed.select(*key, "ts", "seq", "op", "changed_by", *data), [*key, "ts", "seq"], "_chunk")
            .withColumn("_prev", _last_before(exists_op, self.within))
            .withColumn("_image", image)
            .withColumn("_born", born)
        )

        def setter(start: str) -> Column:
            live = F.coalesce("_prev", F.lit(start)) == "I"
            return ((F.col("op") == "U") & live) | ((F.col("op") == "I") & ~live)

        def inserter(start: str) -> Column:
            return (F.col("op") == "I") & (F.coalesce("_prev", F.lit(start)) == "D")

        pieces = self.rows.groupBy(*key, "_chunk").agg(
            F.max_by(exists_op, F.when(exists_op.isNotNull(), order)).alias("_end"),
            *(
                F.max_by(what, F.when(test(start), order)).alias(f"{name}_{start}")
                for name, what, test in (("_image", F.col("_image"), setter), ("_born", F.col("_born"), inserter))
                for start in ("I", "D")
            ),
        )
        across = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        if current is None:
            pieces = pieces.withColumn("_start", F.lit("D"))
        else:
            known = current.select(*key).withColumn("_start", F.lit("I"))
            pieces = pieces.join(known, key, "left").withColumn("_start", F.coalesce("_start", F.lit("D")))
        pieces = pieces.withColumn("_start", F.coalesce(_last_before(F.col("_end"), across), F.col("_start")))
        self.pieces = pieces.select(
            *key,
            "_chunk",
            "_start",
            F.coalesce("_end", "_start").alias("_end"),
            *(
                F.when(F.col("_start") == "I", F.col(f"{n}_I")).otherwise(F.col(f"{n}_D")).alias(n)
                for n in ("_image", "_born")
            ),
        )
        self.across = across

    def effective(self, current: DataFrame | None, created: tuple[str, str], modified: tuple[str, str]) -> DataFrame:
        """Changes that really happened, each with the row's image before it."""
        carry = self.pieces.select(
            *self.key,
            "_chunk",
            "_start",
            _last_before(F.col("_image"), self.across).alias("_image_in"),
            _last_before(F.col("_born"), self.across).alias("_born_in"),
        )
        if current is not None:
            first = current.select(
                *self.key,
                _current_image(current, self.data, modified).alias("_image_now"),
                _current_birth(current, created).alias("_born_now"),
            )
            carry = (
                carry.join(first, self.key, "left")
                .withColumn("_image_in", F.coalesce("_image_in", "_image_now"))
                .withColumn("_born_in", F.coalesce("_born_in", "_born_now"))
            )
        live = F.coalesce("_prev", "_start") == "I"
        rows = (
            self.rows.join(carry, [*self.key, "_chunk"], "left")
            .withColumn("_live", live)
            .withColumn(
                "_set",
                F.when(((F.col("op") == "U") & F.col("_live")) | ((F.col("op") == "I") & ~F.col("_live")), F.col("_image")),
            )
            .withColumn("_start_of_life", F.when((F.col("op") == "I") & ~F.col("_live"), F.col("_born")))
        )
        return (
            rows.withColumn("_old", F.coalesce(_last_before(F.col("_set"), self.within), F.col("_image_in")))
            .withColumn("_origin", F.coalesce(_last_before(F.col("_start_of_life"), self.within), F.col("_born_in")))
            .filter(F.col("_live") & F.col("op").isin("U", "D"))
        )


def _current_image(current: DataFrame, data: list[str], modified: tuple[str, str]) -> Column:
    at, by = modified
    return F.struct(*data, F.col(at).cast("timestamp_ntz").alias("modified_at"), F.col(by).alias("modified_by"))


def _current_birth(current: DataFrame, created: tuple[str, str]) -> Column:
    at, by = created
    return F.struct(F.col(at).cast("timestamp_ntz").alias("created_at"), F.col(by).alias("created_by"))


def _with_ntz(feed: DataFrame) -> DataFrame:
    return feed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def history_from_changes(
    feed: DataFrame,
    key: list[str],
    data: list[str],
    current: DataFrame | None = None,
    created: tuple[str, str] = CREATED,
    modified: tuple[str, str] = MODIFIED,
) -> DataFrame:
    """H4: ordered I/U/D feed (``ts, seq, op, changed_by`` + data) to history rows.

    Updates and deletes of a row that does not exist do nothing. ``current`` gives the rows that
    exist before the feed starts.
    """
    f = _Feed(_with_ntz(feed), key, data, current)
    deleted = F.col("op") == "D"
    return f.effective(current, created, modified).select(
        F.col("op").alias("h_type"),
        F.col("ts").alias("h_ts"),
        F.col("changed_by").alias("h_by"),
        *key,
        "seq",
        *(F.col("_old")[c].alias(c) for c in data),
        F.col("_origin")["created_at"].alias(created[0]),
        F.col("_origin")["created_by"].alias(created[1]),
        F.when(deleted, F.col("ts")).otherwise(F.col("_old")["modified_at"]).alias(modified[0]),
        F.when(deleted, F.col("changed_by")).otherwise(F.col("_old")["modified_by"]).alias(modified[1]),
    )


def apply_changes(
    current: DataFrame,
    feed: DataFrame,
    key: list[str],
    data: list[str],
    created: tuple[str, str] = CREATED,
    modified: tuple[str, str] = MODIFIED,
) -> DataFrame:
    """H5: the table after the feed. Inserts set the creation columns, updates the modification
    columns; rows nobody touched stay as they are."""
    f = _Feed(_with_ntz(feed), key, data, current)
    latest = f.pieces.groupBy(*key).agg(
        F.max_by("_end", "_chunk").alias("_end"),
        F.max_by("_image", F.when(F.col("_image").isNotNull(), F.col("_chunk"))).alias("_image"),
        F.max_by("_born", F.when(F.col("_born").isNotNull(), F.col("_chunk"))).alias("_born"),
    )
    now = current.select(
        *key,
        _current_image(current, data, modified).alias("_image_now"),
        _current_birth(current, created).alias("_born_now"),
    )
    joined = now.join(latest, key, "full_outer").filter(F.coalesce("_end", F.lit("I")) == "I")
    image, born = F.coalesce("_image", "_image_now"), F.coalesce("_born", "_born_now")
    return joined.select(
        *key,
        *(image[c].alias(c) for c in data),
        born["created_at"].alias(created[0]),
        born["created_by"].alias(created[1]),
        image["modified_at"].alias(modified[0]),
        image["modified_by"].alias(modified[1]),
    )


# ------------------------------------------------------------------ reading history
def history_recent(history: DataFrame, n: int, tie_break: list[str]) -> DataFrame:
    """H6: newest ``n`` changes; each task keeps its own best ``n``, no full sort."""
    return history.orderBy(F.col("h_ts").desc(), *tie_break).limit(n)


def history_of_row(history: DataFrame, key: str, value) -> DataFrame:
    """H7: the changes of one row, oldest first. The filter reaches the scan."""
    return history.filter(F.col(key) == F.lit(value)).orderBy("h_ts")


def history_by_user(history: DataFrame, user: str, as_of: str, days: int) -> DataFrame:
    """H8: what one user changed in the last days."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return history.filter((F.col("h_by") == user) & (F.col("h_ts") > since))


def restore_deleted(history: DataFrame, current: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """H9: latest deleted image of every row that is not there now, ready to insert again."""
    columns = [c for c in history.columns if c not in HEADER]
    order_cols = order or ["h_ts"]
    last = (
        history.filter(F.col("h_type") == "D")
        .groupBy(*key)
        .agg(F.max_by(F.struct(*[c for c in columns if c not in key]), F.struct(*order_cols)).alias("_row"))
    )
    absent = last.join(current.select(*key), key, "left_anti")
    return absent.select(*(F.col(c) if c in key else F.col("_row")[c].alias(c) for c in columns))


def tables_with_history(inv_tables: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every table with the name of its history table, if it has one."""
    link = metadata.select("table_id", "history_table")
    return inv_tables.select("table_id", *KEY).join(link, "table_id", "left").withColumn(
        "has_history", F.col("history_table").isNotNull()
    )


# ------------------------------------------------------------------ keeping history tables in step
def history_schema_diff(parent_columns: DataFrame, history_columns: DataFrame, metadata: DataFrame) -> DataFrame:
    """Columns missing in the history table (with the type to add), extra ones (kept, and
    never reported when they start with ``h_``), and type mismatches.

    A single full outer join on (history table, column) gives all three.
    """
    parent = (
        render_types(parent_columns)
        .withColumnRenamed("full_type", "full_type")
        .join(parent_columns.select(*KEY, "column_name", "data_type"), [*KEY, "column_name"])
        .join(
            metadata.select(
                F.col("parent_schema").alias("schema_name"), F.col("parent_table").alias("table_name"), "history_table"
            ),
            KEY,
        )
        .select("schema_name", "history_table", "column_name", F.col("data_type").alias("parent_type"), "full_type")
    )
    kept = history_columns.join(
        metadata.select(F.col("history_schema").alias("schema_name"), "history_table"), ["schema_name", "history_table"], "left_semi"
    ).select("schema_name", "history_table", "column_name", F.col("data_type").alias("history_type"))
    joined = parent.join(kept, ["schema_name", "history_table", "column_name"], "full_outer")
    problem = (
        F.when(F.col("history_type").isNull(), "missing")
        .when(F.col("parent_type").isNull(), F.when(~F.col("column_name").startswith("h_"), "extra"))
        .when(F.col("parent_type") != F.col("history_type"), "type_mismatch")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select(
        "schema_name",
        "history_table",
        "column_name",
        "problem",
        F.when(F.col("problem") == "missing", F.col("full_type")).alias("type_to_add"),
    )


def sync_history(history: DataFrame, parent: DataFrame, schema: str, cfg: Config, geometry: str = "geom") -> DataFrame:
    """Add the parent's new columns as NULL, keep extra ones, then put trailing standard
    columns and geometry last. One projection."""
    added = [F.lit(None).cast(parent.schema[c].dataType).alias(c) for c in parent.columns if c not in history.columns]
    widened = history.select("*", *added)
    last = [c.name for c in matching_columns(schema, cfg, parent) if c.position < 0 and c.name in widened.columns]
    tail = last + ([geometry] if geometry in widened.columns else [])
    return widened.select(*[c for c in widened.columns if c not in tail], *tail)


def propagate_renames(metadata: DataFrame, ddl_log: DataFrame) -> DataFrame:
    """Metadata after table renames. The id is stable, so only the last rename counts."""
    renamed = (
        ddl_log.filter("command = 'RENAME TO'").groupBy("table_id").agg(F.max_by("new_name", "seq").alias("new_name"))
    )
    name = F.coalesce("new_name", "parent_table")
    return metadata.join(renamed, "table_id", "left").select(
        "table_id",
        "parent_schema",
        name.alias("parent_table"),
        "history_schema",
        F.when(F.col("new_name").isNotNull(), naming.history_name(F.col("new_name")))
        .otherwise(F.col("history_table"))
        .alias("history_table"),
    )


def drops_in_scope(ddl_log: DataFrame, internal: Column | None = None) -> DataFrame:
    """The drops that H14 cleans up after: no history table, nothing in public or a system schema,
    and none that ``internal`` marks as a step of a restructuring or of a temporary table."""
    own = (
        ~F.col("table_name").rlike(naming.HISTORY_SUFFIX) & (F.col("schema_name") != "public") & ~F.col("schema_name").rlike("^pg_")
    )
    meant = F.lit(True) if internal is None else ~F.coalesce(internal, F.lit(False))
    return ddl_log.filter((F.col("command") == "DROP TABLE") & own & meant)


def drop_cleanup(ddl_log: DataFrame, metadata: DataFrame, existing: DataFrame, qa_functions: DataFrame | None = None, internal: Column | None = None) -> DataFrame:
    """What goes with every dropped table: its history table, its QA function, its metadata row.

    Names come from metadata by the stable id, otherwise they are the default ones. ``existing``
    (tables) and ``qa_functions`` (schema_name, function_name) tell whether they are there.
    """
    parents = drops_in_scope(ddl_log, internal).select("table_id", *KEY).distinct()
    named = "trigger_function" in metadata.columns
    known = metadata.select(
        "table_id", F.col("history_table").alias("_known"), (F.col("trigger_function") if named else F.lit(None).cast("string")).alias("_function"), F.lit(True).alias("_row")
    )
    function = F.coalesce("_function", F.concat(F.lit("trg_fn_"), "table_name", F.lit("_qa")))
    found = parents.join(known, "table_id", "left").select(
        "table_id",
        *KEY,
        F.coalesce("_known", F.concat("table_name", F.lit("_h"))).alias("history_table"),
        F.when(F.col("_row"), "metadata").otherwise("default_name").alias("found_by"),
        function.alias("function_name"),
    )
    there = existing.select("schema_name", F.col("table_name").alias("history_table")).distinct().withColumn("_there", F.lit(True))
    out = found.join(there, ["schema_name", "history_table"], "left").withColumn("history_exists", F.coalesce("_there", F.lit(False)))
    columns = ["table_id", *KEY, "history_table", "found_by", "history_exists"]
    if qa_functions is None:
        return out.select(*columns)
    functions = qa_functions.select("schema_name", "function_name").distinct().withColumn("_fn", F.lit(True))
    return out.join(functions, ["schema_name", "function_name"], "left").select(
        *columns, F.col("function_name").alias("trigger_function"), F.coalesce("_fn", F.lit(False)).alias("function_exists")
    )


def metadata_after_drop(metadata: DataFrame, ddl_log: DataFrame, internal: Column | None = None) -> DataFrame:
    """H14 for the metadata: rows whose table was dropped go. The id is never given to another table."""
    return metadata.join(drops_in_scope(ddl_log, internal).select("table_id").distinct(), "table_id", "left_anti")


def table_lifetimes(ddl_log: DataFrame, internal: Column | None = None) -> DataFrame:
    """(schema_name, table_name, life, since, until): what lies between two cleaned-up drops of a name.

    ``since`` is the drop before (NULL for the first life), ``until`` the drop that ends it (NULL for
    the last). Every name in the log has a last life; names outside the scope have that one alone.
    """
    ends = drops_in_scope(ddl_log, internal).select(*KEY, F.col("seq").alias("until")).distinct()
    last = ddl_log.select(*KEY).distinct().withColumn("until", F.lit(None).cast("bigint"))
    log = cut_by_rows(ends.unionByName(last).withColumn("_at", F.coalesce("until", F.lit(2**63 - 1))), [*KEY, "_at"])
    chained = neighbour(log, KEY, ["_at"], F.col("_piece"), F.col("until"), "since", -1)
    numbered = running_count(chained, KEY, "_at", F.lit(True), "life", "_piece")
    return numbered.select(*KEY, F.col("life").cast("bigint"), "since", "until")


def registers_after_drop(register: DataFrame, ddl_log: DataFrame, written: str = "seq", internal: Column | None = None) -> DataFrame:
    """H14 for a register: the rows that no drop of their table has cleared.

    A row belongs to the life of the name in which it was written (``written``, a place in the log as
    ``seq`` is), and goes with the drop that ends this life; a table dropped, made again and
    registered keeps its row. A row that does not say when counts as older than the log. Only the last
    drop of a name is needed to tell, one small row per name.
    """
    last = drops_in_scope(ddl_log, internal).groupBy(*KEY).agg(F.max("seq").alias("_dropped"))
    alive = F.col("_dropped").isNull() | F.coalesce(F.col(written) > F.col("_dropped"), F.lit(False))
    return register.join(last, KEY, "left").filter(alive).select(*register.columns)


# ------------------------------------------------------------------ built on top
def as_of(current: DataFrame, history: DataFrame, key: list[str], moment: str, created_at: str = CREATED[0]) -> DataFrame:
    """The table as it was at ``moment``: the earliest image logged after it, else the
    current row, for rows that had been created by then (or carry no creation time)."""
    columns = current.columns
    then = F.lit(moment).cast("timestamp_ntz")
    later = (
        history.filter(F.col("h_ts") > then)
        .groupBy(*key)
        .agg(F.min_by(F.struct(*columns), F.struct("h_ts", "seq")).alias("_past"))
    )
    both = current.select(*key, F.struct(*columns).alias("_now")).join(later, key, "full_outer")
    row = F.coalesce("_past", "_now")
    born = F.coalesce(F.col("_row")[created_at] <= then, F.lit(True))
    return both.select(row.alias("_row")).filter(born).select("_row.*")


def change_summary(history: DataFrame) -> DataFrame:
    """Changes per user, day and type."""
    return history.groupBy("h_by", F.to_date("h_ts").alias("day"), "h_type").agg(F.count("*").alias("n_changes"))


def changed_columns(history: DataFrame, key: list[str], data: list[str]) -> DataFrame:
    """How often each column changed between one logged image and the next of the row."""
    image = F.struct(*data)
    cut = cut_by_rows(history.select(*key, "h_ts", "seq", "h_type", *data), [*key, "h_ts", "seq"])
    paired = neighbour(cut, key, ["h_ts", "seq"], F.col("_piece"), image, "_next", 1)
    flags = paired.filter(F.col("_next").isNotNull() & (F.col("h_type") == "U")).agg(
        *(F.count_if(~F.col(c).eqNullSafe(F.col("_next")[c])).alias(c) for c in data)
    )
    return flags.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_changes")) for c in data)))
    )
