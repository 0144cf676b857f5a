"""Bring tables to the column standard, and audit their layout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.config import Config, StandardColumn
from tablekeep.functions import naming, rules, types
from tablekeep.operators.ordering import dense_ids

KEY = ["schema_name", "table_name"]
# Section numbers give the fixed column order.
FIRST, USER, LAST, GEOMETRY = 1, 2, 3, 4


def _section(column: StandardColumn) -> int:
    return FIRST if column.position > 0 else LAST


def matching_columns(schema: str, cfg: Config, df: DataFrame) -> list[StandardColumn]:
    """Standard columns whose rule holds for one schema name, in position order."""
    spark = df.sparkSession
    one = spark.createDataFrame([(schema,)], "schema_name string")
    tests = [rules.rule_matches("schema_name", c.schema_rule).alias(f"r{i}") for i, c in enumerate(cfg.columns)]
    outcome = one.select(*tests).first()
    return sorted((c for c, hit in zip(cfg.columns, outcome) if hit), key=lambda c: c.position)


def layout_names(schema: str, cfg: Config, df: DataFrame, geometry: str = "geom") -> list[str]:
    """C1 for one table: standard-first, user columns, standard-last, geometry."""
    matching = matching_columns(schema, cfg, df)
    standard = set(cfg.standard_names())
    user = [c for c in df.columns if c not in standard and c != geometry]
    tail = [geometry] if geometry in df.columns else []
    return (
        [c.name for c in matching if c.position > 0] + user + [c.name for c in matching if c.position < 0] + tail
    )


def standard_layouts(inv_columns: DataFrame, inv_tables: DataFrame, inv_geometry: DataFrame, cfg: Config) -> DataFrame:
    """C1 as a set: the target column list of every table, one row per column.

    Each standard column is tested inside one projection over the tables, so the tables are
    scanned once. Positions are numbered per table, whose column count the database bounds.
    """
    standard = F.array(
        *(
            F.struct(
                F.lit(_section(c)).alias("section"),
                F.lit(c.position).alias("sort_key"),
                F.lit(c.name).alias("column_name"),
                F.lit(c.data_type).alias("data_type"),
                F.lit(None if c.track_history else c.default).cast("string").alias("default_value"),
                rules.rule_matches("schema_name", c.schema_rule).alias("matches"),
            )
            for c in cfg.columns
        )
    )
    from_standard = (
        inv_tables.select(*KEY, F.inline(standard)).filter("matches").drop("matches")
    )
    from_user = inv_columns.filter(
        ~F.col("column_name").isin(*cfg.standard_names()) & (F.col("column_name") != "geom")
    ).select(
        *KEY,
        F.lit(USER).alias("section"),
        F.col("ordinal_position").alias("sort_key"),
        "column_name",
        "data_type",
        F.lit(None).cast("string").alias("default_value"),
    )
    full_type = F.concat(
        naming.basal_type(F.col("type")), naming.dimension_suffix(F.col("type"), F.col("coord_dimension"))
    )
    from_geometry = inv_geometry.filter("geometry_column = 'geom'").select(
        *KEY,
        F.lit(GEOMETRY).alias("section"),
        F.lit(0).alias("sort_key"),
        F.col("geometry_column").alias("column_name"),
        naming.geometry_definition(full_type, F.col("srid")).alias("data_type"),
        F.lit(None).cast("string").alias("default_value"),
    )
    rows = from_standard.unionByName(from_user).unionByName(from_geometry)
    place = Window.partitionBy(*KEY).orderBy("section", "sort_key")
    return rows.select(
        *KEY, F.row_number().over(place).alias("position"), "section", "column_name", "data_type", "default_value"
    )


def dropped_user_columns(inv_columns: DataFrame, cfg: Config) -> DataFrame:
    """User columns that lose to a standard column of the same name, even one whose rule does
    not match the schema; the last case is flagged because the data has no replacement."""
    keeps = F.lit(False)
    for c in cfg.columns:
        keeps = keeps | ((F.col("column_name") == c.name) & rules.rule_matches("schema_name", c.schema_rule))
    return inv_columns.filter(F.col("column_name").isin(*cfg.standard_names())).select(
        *KEY, "column_name", keeps.alias("replaced_by_standard")
    )


def default_value(text: str, as_of: str, user: str) -> Column:
    """A default expression as a column: the session's time or user, or a literal; nothing else runs."""
    # The defaults that depend on the session.
    known = {"NOW()": F.lit(as_of).cast("timestamp"), "SESSION_USER": F.lit(user), "CURRENT_USER": F.lit(user)}
    if text.upper() in known:
        return known[text.upper()]
    if not rules.is_literal(text):
        raise ValueError(f"default {text!r} is neither a literal nor one of {sorted(known)}")
    return F.expr(text)


def default_column(column: StandardColumn, as_of: str, user: str) -> Column:
    """A default applies to new columns unless history fills the column later."""
    kind = types.spark_type(column.data_type)
    if column.track_history or column.default is None:
        return F.lit(None).cast(kind)
    return default_value(column.default, as_of, user).cast(kind)


def apply_defaults(df: DataFrame, schema: str, cfg: Config, as_of: str, user: str) -> DataFrame:
    """C3 on existing columns: fill NULLs of the standard columns that carry a default."""
    filled = {
        c.name: F.coalesce(F.col(c.name).cast(types.spark_type(c.data_type)), default_column(c, as_of, user))
        for c in matching_columns(schema, cfg, df)
        if c.name in df.columns and c.default is not None and not c.track_history
    }
    return df.withColumns(filled) if filled else df


def generated_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """C4: recompute stored generated columns; all see the incoming row, none sees another."""
    out = [
        F.expr(expressions[c]).cast(df.schema[c].dataType).alias(c) if c in expressions else F.col(c)
        for c in df.columns
    ]
    added = [F.expr(e).alias(c) for c, e in expressions.items() if c not in df.columns]
    return df.select(*out, *added)


def assign_gid(df: DataFrame, order_by: list[str], start: int = 1) -> DataFrame:
    """Sequence key as the first column; whatever the client sent in ``gid`` is replaced."""
    return dense_ids(df.drop("gid"), order_by, "gid", start)


def conform(
    df: DataFrame,
    schema: str,
    cfg: Config,
    as_of: str,
    user: str,
    order_by: list[str],
    geometry: str = "geom",
    generated: Mapping[str, str] | None = None,
    start: int = 1,
) -> DataFrame:
    """The table as the standard wants it.

    User columns that collide with a standard name are dropped, missing standard columns are
    added with their defaults, the key is assigned in ``order_by`` order, geometry goes last.
    Everything but the key is one projection.
    """
    standard = set(cfg.standard_names())
    user_columns = [c for c in df.columns if c not in standard and c != geometry]
    matching = {c.name: c for c in matching_columns(schema, cfg, df)}
    keyed = df.select(*user_columns, *([geometry] if geometry in df.columns else []))
    if generated:
        keyed = generated_columns(keyed, generated)
    identity = [n for n, c in matching.items() if types.is_identity(c.data_type)]
    if identity:
        keyed = dense_ids(keyed, order_by, identity[0], start)
    out = []
    for name in layout_names(schema, cfg, df.select(*df.columns), geometry):
        if name in identity[:1] or name not in matching:
            out.append(F.col(name))
        else:
            out.append(default_column(matching[name], as_of, user).alias(name))
    return keyed.select(*out)


def reorder(df: DataFrame, schema: str, cfg: Config, geometry: str = "geom") -> DataFrame:
    """After columns were added, put trailing standard columns and then geometry last again.
    Standard columns the table does not have are skipped; nothing is added or dropped."""
    last = [c.name for c in matching_columns(schema, cfg, df) if c.position < 0 and c.name in df.columns]
    tail = last + ([geometry] if geometry in df.columns else [])
    return df.select(*[c for c in df.columns if c not in tail], *tail)


def check_layout(inv_columns: DataFrame, inv_tables: DataFrame, cfg: Config) -> DataFrame:
    """Layout problems per table: missing or unexpected standard columns, ``gid`` not first,
    ``geom`` not last, trailing standard columns out of order.

    One pass: all facts are aggregates per table, combined map-side before the only shuffle.
    """
    facts = inv_columns.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min("ordinal_position").alias("lo"),
        F.max("ordinal_position").alias("hi"),
        *(
            F.max(F.when(F.col("column_name") == c.name, F.col("ordinal_position"))).alias(f"p{i}")
            for i, c in enumerate(cfg.columns)
        ),
        F.max(F.when(F.col("column_name") == "geom", F.col("ordinal_position"))).alias("geom_at"),
        F.max(
            F.when(~F.col("column_name").isin(*cfg.standard_names(), "geom"), F.col("ordinal_position"))
        ).alias("last_user"),
    )
    t = inv_tables.select(*KEY).join(facts, KEY, "left")
    problems = []
    for i, c in enumerate(cfg.columns):
        at, wanted = F.col(f"p{i}"), rules.rule_matches("schema_name", c.schema_rule)
        problems.append(F.when(wanted & at.isNull(), F.struct(F.lit("missing").alias("problem"), F.lit(c.name).alias("column_name"))))
        problems.append(F.when(~wanted & at.isNotNull(), F.struct(F.lit("unexpected").alias("problem"), F.lit(c.name).alias("column_name"))))
    firsts = sorted((c.position, i, c.name) for i, c in enumerate(cfg.columns) if c.position > 0)
    for rank, (_, i, name) in enumerate(firsts):
        problems.append(
            F.when(F.col(f"p{i}") != F.col("lo") + rank, F.struct(F.lit("not_first").alias("problem"), F.lit(name).alias("column_name")))
        )
    problems.append(
        F.when(F.col("geom_at") < F.col("hi"), F.struct(F.lit("not_last").alias("problem"), F.lit("geom").alias("column_name")))
    )
    earlier = F.col("last_user")
    for _, i, name in sorted((c.position, i, c.name) for i, c in enumerate(cfg.columns) if c.position < 0):
        at = F.col(f"p{i}")
        problems.append(F.when(at < earlier, F.struct(F.lit("misordered").alias("problem"), F.lit(name).alias("column_name"))))
        earlier = F.greatest(earlier, at)
    problems.append(
        F.when(F.col("hi") - F.col("lo") + 1 != F.col("n"), F.struct(F.lit("gap").alias("problem"), F.lit("*").alias("column_name")))
    )
    return t.select(*KEY, F.explode(F.array_compact(F.array(*problems))).alias("p")).select(*KEY, "p.problem", "p.column_name")


def own_identity_warnings(inv_columns: DataFrame) -> DataFrame:
    """Identity columns of the user's own, which the standard key makes redundant."""
    return inv_columns.filter(F.col("is_identity") & (F.col("column_name") != "gid")).select(*KEY, "column_name")


def render_types(inv_columns: DataFrame, geometry_definitions: DataFrame | None = None) -> DataFrame:
    """Full type text of every column, with collation."""
    df = inv_columns
    if geometry_definitions is not None:
        df = df.join(
            geometry_definitions.select(*KEY, F.col("geometry_column").alias("column_name"), "definition"),
            [*KEY, "column_name"],
            "left",
        )
    else:
        df = df.withColumn("definition", F.lit(None).cast("string"))
    text = types.full_type(
        F.col("data_type"), F.col("max_length"), F.col("numeric_precision"), F.col("numeric_scale"), F.col("definition")
    )
    collated = F.concat(text, F.when(F.col("collation_name").isNotNull(), F.concat(F.lit(" COLLATE "), "collation_name")).otherwise(""))
    return df.select(*KEY, "column_name", "ordinal_position", collated.alias("full_type"))


def create_statements(layouts: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text per table; every identifier is quoted so reserved words work.
    A table's column count is bounded by the database, so the ordered list per table is too."""
    column = F.concat(
        naming.quote_ident(F.col("column_name")),
        F.lit(" "),
        "data_type",
        F.when(F.col("default_value").isNotNull(), F.concat(F.lit(" DEFAULT "), "default_value")).otherwise(""),
    )
    listed = layouts.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("position", column.alias("text")))).alias("columns")
    )
    body = F.array_join(F.transform("columns", lambda c: c["text"]), ", ")
    head = F.concat(
        F.lit("CREATE TABLE "), naming.quote_ident(F.col("schema_name")), F.lit("."), naming.quote_ident(F.col("table_name"))
    )
    return listed.select(*KEY, F.concat(head, F.lit(" ("), body, F.lit(")")).alias("statement"))
