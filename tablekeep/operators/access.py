"""The access model as data: what should exist, what does, and the difference.

Nothing is granted here; every result is a set of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.functions import naming, rules
from tablekeep.session import materialize


def _fill(template: str, schema: str = "schema_name") -> Column:
    return F.replace(F.lit(template), F.lit("{schema}"), F.col(schema))


def expected_roles(schemas: DataFrame, cfg: Config) -> DataFrame:
    """One row per schema and matching role template."""
    cells = [
        F.struct(
            _fill(r.role).alias("role_name"),
            F.lit(r.kind).alias("kind"),
            F.lit(r.login).alias("login"),
            (_fill(r.inherits) if r.inherits else F.lit(None).cast("string")).alias("inherits"),
            rules.rule_matches("schema_name", r.schema_rule).alias("matches"),
        )
        for r in cfg.roles
    ]
    return schemas.select("schema_name", F.inline(F.array(*cells))).filter("matches").drop("matches")


def governed_schemas(schemas: DataFrame, cfg: Config) -> DataFrame:
    return schemas.filter(F.col("schema_name").rlike(cfg.level_pattern()))


def role_drift(
    expected: DataFrame, inv_roles: DataFrame, credentials: DataFrame, members: DataFrame, cfg: Config
) -> DataFrame:
    """R2: state of every expected role, of its inheritance, and of its service-group membership."""
    roles = inv_roles.select("role_name", F.col("can_login").alias("_login"))
    creds = credentials.filter("can_login").select("role_name").distinct().withColumn("_credential", F.lit(True))
    pairs = members.select(F.col("group_role").alias("inherits"), F.col("member").alias("role_name")).distinct()
    service = (
        members.filter(F.col("group_role") == cfg.service_group)
        .select(F.col("member").alias("role_name"))
        .distinct()
        .withColumn("_serves", F.lit(True))
    )
    parents = inv_roles.select(F.col("role_name").alias("inherits")).distinct().withColumn("_parent", F.lit(True))
    joined = (
        expected.join(roles, "role_name", "left")
        .join(creds, "role_name", "left")
        .join(pairs.withColumn("_inherited", F.lit(True)), ["inherits", "role_name"], "left")
        .join(service, "role_name", "left")
        .join(parents, "inherits", "left")
    )
    there = F.col("_login").isNotNull()
    state = (
        F.when(~there, "missing")
        .when(~F.col("login") & F.col("_login"), "login_must_go")
        .when(F.col("login") & F.col("_credential").isNull(), "no_credential")
        .otherwise("correct")
    )
    inheritance = F.when(
        F.col("inherits").isNotNull(),
        F.when(F.col("_parent").isNull(), "parent_missing").when(F.col("_inherited").isNull(), "missing").otherwise("granted"),
    )
    membership = F.when(F.col("login"), F.when(F.col("_serves").isNull(), "missing").otherwise("member")).otherwise(
        F.when(F.col("_serves").isNotNull(), "must_leave").otherwise("none")
    )
    return joined.select(
        "schema_name", "role_name", state.alias("state"), inheritance.alias("inheritance"), membership.alias("membership")
    )


# What a role kind may do.
GRANTS = {
    "read": [("schema", "USAGE"), ("table", "SELECT")],
    "write": [
        ("schema", "USAGE"), ("table", "SELECT"), ("table", "INSERT"), ("table", "UPDATE"), ("table", "DELETE"),
        ("sequence", "USAGE"), ("sequence", "SELECT"),
    ],
}


def expected_grants(roles: DataFrame) -> DataFrame:
    """Privileges per role; a role that inherits gets none of its own."""
    def listed(kind: str) -> Column:
        return F.array(*(F.struct(F.lit(o).alias("object_kind"), F.lit(p).alias("privilege")) for o, p in GRANTS[kind]))

    grants = F.when(F.col("kind") == "read", listed("read")).when(F.col("kind") == "write", listed("write"))
    return roles.filter("inherits IS NULL").select("role_name", "schema_name", F.inline(grants))


def grant_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Grants to add and grants nobody ordered; one full outer join."""
    key = ["role_name", "schema_name", "object_kind", "privilege"]
    e = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(*key).distinct().withColumn("_a", F.lit(True))
    return e.join(a, key, "full_outer").filter("_e IS NULL OR _a IS NULL").select(
        *key, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("drift")
    )


def group_grants(mappings: DataFrame, inv_roles: DataFrame) -> DataFrame:
    """Per mapping, grant it or skip it because one of the roles does not exist."""
    group = inv_roles.select(F.col("role_name").alias("group_role")).distinct().withColumn("_g", F.lit(True))
    schema = inv_roles.select(F.col("role_name").alias("schema_role")).distinct().withColumn("_s", F.lit(True))
    action = F.when(F.col("_g").isNull(), "skip_group_missing").when(F.col("_s").isNull(), "skip_role_missing").otherwise("grant")
    return (
        mappings.join(group, "group_role", "left")
        .join(schema, "schema_role", "left")
        .select("mapping_id", "group_role", "schema_role", action.alias("action"))
    )


def grant_summary(actions: DataFrame, failed_ids: DataFrame | None = None) -> DataFrame:
    """Handled, granted, skipped and failed in one pass."""
    df = actions.withColumn("_failed", F.lit(False))
    if failed_ids is not None:
        failed = failed_ids.select("mapping_id").distinct().withColumn("_f", F.lit(True))
        df = actions.join(failed, "mapping_id", "left").withColumn("_failed", F.coalesce("_f", F.lit(False)) & (F.col("action") == "grant"))
    return df.agg(
        F.count("*").alias("handled"),
        F.count_if((F.col("action") == "grant") & ~F.col("_failed")).alias("granted"),
        F.count_if(F.col("action").startswith("skip")).alias("skipped"),
        F.count_if("_failed").alias("failed"),
    )


def roles_to_remove(dropped_schemas: DataFrame, inv_roles: DataFrame, cfg: Config) -> DataFrame:
    """Existing roles that go with a dropped schema. The template's rule is not asked here."""
    names = [_fill(r.role) for r in cfg.roles if r.drop_with_schema]
    mine = dropped_schemas.filter(~naming.is_system_schema(F.col("schema_name"))).select("schema_name").distinct()
    candidates = mine.select("schema_name", F.explode(F.array(*names)).alias("role_name"))
    return candidates.join(inv_roles.select("role_name").distinct(), "role_name", "left_semi").select("schema_name", "role_name")


def effective_roles(members: DataFrame) -> DataFrame:
    """Every role a member reaches, directly or through other groups, at any depth.

    Each round extends the pairs found in the round before by all pairs known so far, so the reach
    doubles; it is written to the shared folder so that lineage stays short. Cycles end by
    themselves: known pairs are not repeated.
    """
    edges = members.select("member", "group_role").distinct()
    reached = materialize(edges, "roles")
    fresh = reached
    while True:
        hop = reached.select(F.col("member").alias("_via"), F.col("group_role").alias("_next"))
        step = (
            fresh.join(hop, F.col("group_role") == F.col("_via"))
            .select("member", F.col("_next").alias("group_role"))
            .distinct()
            .join(reached, ["member", "group_role"], "left_anti")
        )
        fresh = materialize(step, "roles")
        if fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh)


def expected_layer_rules(schemas: DataFrame, cfg: Config) -> DataFrame:
    """Read and write rule of each schema; open levels add the anonymous role."""
    open_levels = [lv.prefix for lv in cfg.levels if lv.anonymous_read]
    anonymous = F.substring_index("schema_name", "_", 1).isin(*open_levels)
    read = F.concat(F.lit("r_"), "schema_name", F.when(anonymous, ",ROLE_ANONYMOUS").otherwise(""))
    cells = F.array(
        F.struct(F.concat("schema_name", F.lit(".*.r")).alias("rule_key"), read.alias("role")),
        F.struct(F.concat("schema_name", F.lit(".*.w")).alias("rule_key"), F.concat(F.lit("w_"), "schema_name").alias("role")),
    )
    return schemas.select(F.inline(cells))


def layer_rule_drift(expected: DataFrame, current: DataFrame) -> DataFrame:
    """What to do with each expected rule: keep, correct or create."""
    now = current.select("rule_key", F.col("role").alias("current_role"))
    action = F.when(F.col("current_role").isNull(), "create").when(F.col("current_role") == F.col("role"), "keep").otherwise("correct")
    return expected.join(now, "rule_key", "left").select("rule_key", "role", "current_role", action.alias("action"))
