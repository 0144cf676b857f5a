"""Naming and structure audits over inventory snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.functions import naming, rules

KEY = ["schema_name", "table_name"]


def schema_names(frame: DataFrame) -> DataFrame:
    """Distinct schema names; duplicates collapse on the map side before any row is shuffled."""
    return frame.select("schema_name").distinct()


def match_patterns(schemas: DataFrame, cfg: Config) -> DataFrame:
    """The two patterns of the standard and whether each schema name satisfies them."""
    full, level = cfg.schema_pattern(), cfg.level_pattern()
    return schemas.select(
        "schema_name",
        F.lit(full).alias("schema_pattern"),
        F.lit(level).alias("level_pattern"),
        F.col("schema_name").rlike(full).alias("matches_schema"),
        F.col("schema_name").rlike(level).alias("matches_level"),
    )


def check_schema_names(schemas: DataFrame, cfg: Config) -> DataFrame:
    """Exempt, valid or invalid; an invalid name says which part is wrong."""
    name = F.col("schema_name")
    status = (
        F.when(naming.is_system_schema(name), "exempt")
        .when(name.rlike(cfg.schema_pattern()), "valid")
        .otherwise("invalid")
    )
    reason = F.when(
        status == "invalid", F.when(name.rlike(cfg.level_pattern()), "category_or_name").otherwise("level")
    )
    return schemas.select("schema_name", status.alias("status"), reason.alias("reason"))


def parse_schemas(schemas: DataFrame, cfg: Config) -> DataFrame:
    """Level, category and free part of each name, all NULL when the name is not valid."""
    pattern = cfg.schema_pattern().removesuffix(".+$") + "(.+)$"
    valid = F.col("schema_name").rlike(cfg.schema_pattern())

    def part(i: int) -> Column:
        return F.when(valid, F.regexp_extract("schema_name", pattern, i))

    return schemas.select(
        "schema_name",
        valid.alias("valid"),
        part(1).alias("level"),
        part(2).alias("category"),
        part(3).alias("description"),
    )


def eval_schema_rules(schemas: DataFrame, named_rules: list[tuple[str, str]], strict: bool = False) -> DataFrame:
    """One row per (schema, rule) with the outcome and, for a bad rule, what is wrong.

    Rules are part of the bounded standard: each becomes one boolean expression in a single
    projection, so no rule table is ever joined to the schemas.
    """
    cells = [
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            rules.rule_matches("schema_name", rule, strict).alias("matches"),
            F.lit(rules.rule_problem(rule)).cast("string").alias("rule_error"),
        )
        for rule_id, rule in named_rules
    ]
    return schemas.select("schema_name", F.inline(F.array(*cells)))


def publishable_schemas(schemas: DataFrame, cfg: Config) -> DataFrame:
    """Schemas named ``level_category_...`` whose level publishes."""
    pattern = cfg.publish_pattern()
    return schemas.select("schema_name").filter(F.col("schema_name").rlike(pattern) if pattern else F.lit(False))


def publishing_level(schema: str, cfg: Config, strict: bool = False) -> Column:
    """Prefix of the publishing level a name starts with: the longest, then the first by name."""
    ranked = sorted((lv.prefix for lv in cfg.levels if lv.publish), key=lambda p: (-len(p), p))
    pick = F.lit(None).cast("string")
    for prefix in reversed(ranked):
        like = F.col(schema).startswith(prefix + "_") if strict else F.col(schema).like(prefix + "_%")
        pick = F.when(like, prefix).otherwise(pick)
    return pick


def publish_events(schemas: DataFrame, cfg: Config, action: str = "publish", strict: bool = False) -> DataFrame:
    """One event per schema that is not a system schema and whose level publishes."""
    return (
        schemas.filter(~naming.is_system_schema(F.col("schema_name")))
        .select("schema_name", publishing_level("schema_name", cfg, strict).alias("level"), F.lit(action).alias("action"))
        .filter(F.col("level").isNotNull())
    )


def anonymous_read(schemas: DataFrame, cfg: Config) -> DataFrame:
    """May layers of the schema be read without login? Unknown levels: no."""
    open_levels = [lv.prefix for lv in cfg.levels if lv.anonymous_read]
    level = F.substring_index("schema_name", "_", 1)
    return schemas.select("schema_name", level.alias("level"), level.isin(*open_levels).alias("anonymous_read"))


def geometry_info(inv_geometry: DataFrame) -> DataFrame:
    """Basal type, dimension suffix, full type and definition of every geometry column."""
    basal = naming.basal_type(F.col("type"))
    suffix = naming.dimension_suffix(F.col("type"), F.col("coord_dimension"))
    full = F.concat(basal, suffix)
    return inv_geometry.select(
        *KEY,
        "geometry_column",
        basal.alias("basal_type"),
        suffix.alias("dimension_suffix"),
        full.alias("full_type"),
        "srid",
        naming.geometry_definition(full, F.col("srid")).alias("definition"),
    )


def _geometry_per_table(inv_geometry: DataFrame) -> DataFrame:
    # Partial aggregation: at most one small row per table leaves each map task.
    return inv_geometry.groupBy(*KEY).agg(
        F.count("*").alias("n_geometries"),
        F.min("geometry_column").alias("geometry_column"),
        F.min("type").alias("type"),
    )


def check_tables(inv_tables: DataFrame, inv_geometry: DataFrame, strict: bool = False) -> DataFrame:
    """First broken structure rule of each table, in fixed order, or NULL."""
    t = inv_tables.select(*KEY).join(_geometry_per_table(inv_geometry), KEY, "left")
    n = F.coalesce("n_geometries", F.lit(0))
    name = F.col("table_name")
    wanted = F.when(n == 1, naming.expected_suffix(naming.basal_type(F.col("type"))))
    code = (
        F.when(F.length(name) > naming.MAX_TABLE_NAME, "name_too_long")
        .when(n == 0, F.when(name.rlike(naming.GEOMETRY_SUFFIX), "reserved_suffix"))
        .when(n > 1, "several_geometries")
        .when(F.col("geometry_column") != "geom", "geometry_column_name")
        .when(~naming.ends_with_suffix(name, wanted, strict), "wrong_suffix")
    )
    return t.select(*KEY, n.cast("bigint").alias("n_geometries"), wanted.alias("expected_suffix"), code.alias("code"))


def suggest_names(inv_tables: DataFrame, inv_geometry: DataFrame) -> DataFrame:
    """Expected suffix and the name to use, for tables with exactly one geometry."""
    basal = naming.basal_type(F.col("type"))
    return (
        inv_tables.select(*KEY)
        .join(_geometry_per_table(inv_geometry).filter("n_geometries = 1"), KEY)
        .select(
            *KEY,
            naming.expected_suffix(basal).alias("expected_suffix"),
            naming.suggest_name(F.col("table_name"), basal).alias("suggested_name"),
        )
    )


def check_views(inv_views: DataFrame, view_geometry: DataFrame, strict: bool = False) -> DataFrame:
    """View prefix and suffix. Views compare the raw type, tables the basal one."""
    geo = _geometry_per_table(view_geometry).withColumnRenamed("table_name", "view_name")
    v = inv_views.select("schema_name", "view_name", "definition").join(geo, ["schema_name", "view_name"], "left")
    n = F.coalesce("n_geometries", F.lit(0))
    name = F.col("view_name")
    wanted = F.when(n == 0, "").when(n == 1, naming.expected_suffix(F.col("type"))).otherwise("_g")
    prefix_ok = name.startswith("v_") if strict else name.like("v_%")
    ok = prefix_ok & ((wanted == "") | naming.ends_with_suffix(name, wanted, strict))
    cast_needed = F.col("definition").rlike("(?i)ST_[A-Za-z]+\\s*\\(") & (n == 1) & (F.col("type") == "GEOMETRY")
    code = F.when(~ok, F.when(cast_needed, "cast_needed").otherwise("view_name"))
    return v.select(
        "schema_name", "view_name", n.cast("bigint").alias("n_geometries"), wanted.alias("expected_suffix"), code.alias("code")
    )


def check_history_names(inv_tables: DataFrame) -> DataFrame:
    """A name ending in ``_h`` is only right when its parent exists in the same schema."""
    parents = inv_tables.select("schema_name", F.col("table_name").alias("parent_table")).distinct()
    named = inv_tables.filter(F.col("table_name").rlike(naming.HISTORY_SUFFIX)).select(
        *KEY, F.regexp_replace("table_name", naming.HISTORY_SUFFIX, "").alias("parent_table")
    )
    found = parents.withColumn("found", F.lit(True))
    return named.join(found, ["schema_name", "parent_table"], "left").select(
        *KEY,
        "parent_table",
        F.when(F.col("found"), "history_table").otherwise("reserved_suffix").alias("status"),
    )


def in_scope(inv_tables: DataFrame, inv_columns: DataFrame) -> DataFrame:
    """Tables the standard applies to (no public/temporary schema, no history table, and
    no table in the middle of a restructuring)."""
    busy = inv_columns.filter(F.col("column_name").like("%_temp0001")).select(*KEY).distinct()
    parents = inv_tables.select("schema_name", F.concat("table_name", F.lit("_h")).alias("table_name")).distinct()
    candidates = inv_tables.filter(
        (F.col("schema_name") != "public") & ~F.col("schema_name").rlike("^pg_temp")
    )
    name_h = F.col("table_name").rlike(naming.HISTORY_SUFFIX)
    plain = candidates.filter(~name_h)
    orphan_h = candidates.filter(name_h).join(parents, KEY, "left_anti")
    return plain.unionByName(orphan_h).join(busy, KEY, "left_anti").select("table_id", *KEY)


def derived_names(inv_tables: DataFrame) -> DataFrame:
    """Names of the objects that belong to a table, and whether truncation makes two
    tables of one schema share a name."""
    name = F.col("table_name")
    stem = F.left(name, F.lit(naming.INDEX_STEM))
    named = inv_tables.select(
        *KEY,
        naming.history_name(name).alias("history_table"),
        F.concat(stem, F.lit("_h_idx")).alias("history_index"),
        F.concat(stem, F.lit("_geom_gidx")).alias("spatial_index"),
        F.concat(F.lit("validera_geom_"), name).alias("check_name"),
        F.concat(F.lit("trg_fn_"), name, F.lit("_qa")).alias("trigger_function"),
        F.concat(F.lit("trg_"), name, F.lit("_qa")).alias("trigger_name"),
    )
    shared = named.groupBy("schema_name", "spatial_index").agg(F.count("*").alias("n_sharing"))
    return named.join(shared, ["schema_name", "spatial_index"]).select(
        *named.columns, (F.col("n_sharing") > 1).alias("index_collision")
    )


def is_system_user(sessions: DataFrame, cfg: Config, cols: list[str]) -> DataFrame:
    """Does any of the lower-cased session names equal a registered system user? The
    register itself is not lowered, so a mixed-case entry never matches."""
    hit = F.lit(False)
    for name in cols:
        hit = hit | F.coalesce(F.lower(name).isin(*cfg.system_users), F.lit(False))
    return sessions.withColumn("is_system_user", hit)


def needs_geometry_validation(schema: str, cfg: Config) -> Column:
    pattern = cfg.validated_pattern()
    return F.col(schema).rlike(pattern) if pattern else F.lit(False)


def tables_to_validate(inv_tables: DataFrame, cfg: Config) -> DataFrame:
    """Tables in a schema whose category asks for geometry validation."""
    return inv_tables.filter(needs_geometry_validation("schema_name", cfg)).select("table_id", *KEY)


def check_schema_renames(ddl: DataFrame, inv_roles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Schema renames in a DDL log and how many roles and history tables hang on the old
    name. Dependants are counted per schema first, so nothing multiplies in the joins."""
    renames = ddl.filter(F.col("command").rlike("(?i)^\\s*ALTER\\s+SCHEMA\\b") & F.col("command").rlike("(?i)\\bRENAME\\s+TO\\b"))
    roles = (
        inv_roles.filter(F.col("role_name").rlike("^(r|w|gs_r|gs_w)_"))
        .groupBy(F.regexp_replace("role_name", "^(gs_)?[rw]_", "").alias("schema_name"))
        .agg(F.count("*").alias("n_roles"))
    )
    history = metadata.groupBy(F.col("parent_schema").alias("schema_name")).agg(F.count("*").alias("n_history_tables"))
    return (
        renames.join(roles, "schema_name", "left")
        .join(history, "schema_name", "left")
        .select(
            "seq",
            "schema_name",
            F.lit("schema_rename_blocked").alias("code"),
            F.coalesce("n_roles", F.lit(0)).alias("n_roles"),
            F.coalesce("n_history_tables", F.lit(0)).alias("n_history_tables"),
        )
    )
