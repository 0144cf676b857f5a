"""Checks and upgrades of the standard itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.rules import MAX_LENGTH, RULE_START

# What a prefix may look like.
LEVEL_PREFIX = "^sk[a-z0-9]+$"
CATEGORY_PREFIX = "^[a-z][a-z0-9]*$"


def _row_checks(df: DataFrame, table: str, key: str, checks: dict) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in checks.items())))
    return df.select(F.lit(table).alias("standard"), F.col(key).alias("entry"), F.explode(found).alias("violation"))


def _duplicates(df: DataFrame, table: str, key: str) -> DataFrame:
    return (
        df.groupBy(F.col(key).alias("entry"))
        .count()
        .filter("count > 1")
        .select(F.lit(table).alias("standard"), "entry", F.lit("duplicate").alias("violation"))
    )


def config_violations(frames: dict[str, DataFrame]) -> DataFrame:
    """Everything the standard's own rules forbid, one row per entry and violation."""
    parts = []
    if "levels" in frames:
        parts += [
            _row_checks(frames["levels"], "levels", "prefix", {"prefix": ~F.col("prefix").rlike(LEVEL_PREFIX)}),
            _duplicates(frames["levels"], "levels", "prefix"),
        ]
    if "categories" in frames:
        parts += [
            _row_checks(frames["categories"], "categories", "prefix", {"prefix": ~F.col("prefix").rlike(CATEGORY_PREFIX)}),
            _duplicates(frames["categories"], "categories", "prefix"),
        ]
    rule = F.col("schema_rule")
    rule_checks = {
        "rule_semicolon": rule.contains(";"),
        "rule_too_long": F.length(rule) >= MAX_LENGTH,
        "rule_start": ~rule.rlike("(?i)" + RULE_START),
    }
    if "columns" in frames:
        checks = {"name_too_long": F.length("name") > 63, "position_zero": F.col("position") == 0, **rule_checks}
        parts += [_row_checks(frames["columns"], "columns", "name", checks), _duplicates(frames["columns"], "columns", "name")]
    if "roles" in frames:
        # The role rules are executed as well, so they get the same safety checks.
        checks = {"kind": ~F.col("kind").isin("read", "write"), **rule_checks}
        parts += [_row_checks(frames["roles"], "roles", "role", checks), _duplicates(frames["roles"], "roles", "role")]
    return reduce(DataFrame.unionByName, parts)


def snapshot_settings(df: DataFrame, path: str) -> None:
    """S5, before an upgrade: keep the edited rows."""
    df.write.mode("overwrite").parquet(path)


def restore_settings(defaults: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """S5, after an upgrade: new defaults overlaid with the saved edits.

    Where both have the key the saved value wins, NULL included; saved rows the new defaults lack
    come back; only columns that exist on both sides are carried, new columns keep their default.
    """
    shared = [c for c in defaults.columns if c in saved.columns and c not in key]
    old = saved.select(*key, *(F.col(c).alias(f"_{c}") for c in shared), F.lit(True).alias("_saved"))
    joined = defaults.join(old, key, "full_outer")
    values = [
        F.when(F.col("_saved"), F.col(f"_{c}")).otherwise(F.col(c)).cast(defaults.schema[c].dataType).alias(c)
        if c in shared
        else F.col(c)
        for c in defaults.columns
    ]
    return joined.select(*values)


def restore_rows(current: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """S5 for tables with users' own rows: insert what is absent, never overwrite."""
    absent = saved.join(current.select(*key), key, "left_anti")
    carried = [c for c in saved.columns if c in current.columns]
    return current.unionByName(absent.select(*carried), allowMissingColumns=True)
