"""Constraint inventories, and the same rules checked over data (K1-K6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.config import Config

KEY = ["schema_name", "table_name"]


def classify_rules(inv_constraints: DataFrame, inv_attributes: DataFrame) -> DataFrame:
    """K1: table rules and column rules. A CHECK belongs to a column only when it names one
    distinct column; keys, uniqueness and foreign keys are table rules."""
    kinds = {"p": "primary_key", "u": "unique", "c": "check", "f": "foreign_key"}
    kind = F.lit(None).cast("string")
    for code, text in kinds.items():
        kind = F.when(F.col("contype") == code, text).otherwise(kind)
    # conkey is a short list of column numbers inside the row: no explode, no shuffle. Keys keep
    # their column order; a CHECK has none.
    given = F.transform(F.split("conkey", ","), lambda a: a.cast("int"))
    attnums = F.when(F.col("contype") == "c", F.array_sort(F.array_distinct(given))).otherwise(given)
    from_constraints = inv_constraints.select(
        *KEY,
        F.col("constraint_name").alias("rule_name"),
        kind.alias("rule_kind"),
        F.when((F.col("contype") == "c") & (F.size(attnums) == 1), "column").otherwise("table").alias("rule_scope"),
        F.array_join(attnums.cast("array<string>"), ",").alias("columns"),
        "definition",
    )
    identity = F.when(F.col("identity_kind") == "a", "GENERATED ALWAYS AS IDENTITY").when(
        F.col("identity_kind") == "d", "GENERATED BY DEFAULT AS IDENTITY"
    )

    def cell(kind_name, when, definition):
        return F.when(when, F.struct(F.lit(kind_name).alias("rule_kind"), definition.alias("definition")))

    cells = F.array_compact(
        F.array(
            cell("not_null", F.col("not_null"), F.lit("NOT NULL")),
            cell("default", F.col("default_expr").isNotNull(), F.col("default_expr")),
            cell("identity", identity.isNotNull(), identity),
        )
    )
    from_attributes = inv_attributes.select(
        *KEY, F.col("column_name").alias("rule_name"), F.col("ordinal_position").cast("string").alias("columns"), F.inline(cells)
    ).withColumn("rule_scope", F.lit("column"))
    return from_constraints.unionByName(from_attributes)


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """K2: NULL count of every column in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return counts.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols)))
    )


def check_predicates(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """K3: rows that break each CHECK, in one pass. An unknown (NULL) outcome passes."""
    counts = df.agg(*(F.count_if(~F.expr(e)).alias(n) for n, e in checks.items()))
    return counts.select(
        F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_violations")) for n in checks)))
    )


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """K4: keys that occur more than once; a key with a NULL is never a duplicate."""
    keyed = df.select(*cols).na.drop(subset=cols)
    return keyed.groupBy(*cols).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def check_foreign_key(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """K5: referencing values without a parent and how many rows carry each.

    Child rows are counted per value first, so a hot value is one row in the anti join. A key
    with a NULL in it passes.
    """
    child_cols = list(on)
    counted = child.select(*child_cols).na.drop(subset=child_cols).groupBy(*child_cols).agg(F.count("*").alias("n_orphans"))
    targets = parent.select(*(F.col(p).alias(c) for c, p in on.items()))
    return counted.join(targets, child_cols, "left_anti")


def restore_plan(classified: DataFrame, inv_indexes: DataFrame, cfg: Config) -> DataFrame:
    """K6: order in which saved rules go back: indexes, table constraints (primary keys are
    skipped, the standard brings its own), foreign keys, NOT NULL, column checks, defaults
    (not those of standard columns), identities. Steps are numbered per table."""
    scope, kind = F.col("rule_scope"), F.col("rule_kind")
    stage = (
        F.when(kind == "index", 1)
        .when((scope == "table") & kind.isin("unique", "check"), 2)
        .when(kind == "foreign_key", 3)
        .when(kind == "not_null", 4)
        .when(kind == "check", 5)
        .when((kind == "default") & ~F.col("rule_name").isin(*cfg.standard_names()), 6)
        .when(kind == "identity", 7)
    )
    indexes = inv_indexes.select(
        *KEY, F.col("index_name").alias("rule_name"), F.lit("index").alias("rule_kind"), F.lit("table").alias("rule_scope")
    )
    rules = classified.select(*indexes.columns).unionByName(indexes)
    step = Window.partitionBy(*KEY).orderBy("stage", "rule_name")
    return (
        rules.withColumn("stage", stage)
        .filter("stage IS NOT NULL")
        .select(*KEY, "stage", "rule_name", "rule_kind", F.row_number().over(step).alias("step"))
    )
