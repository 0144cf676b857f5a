"""The governance standard: levels, categories, standard columns and role templates.

The standard is what people edit by hand, like code: it lives on the driver as plain tuples and is
turned into literals and column expressions. Its size does not depend on the data it governs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Level(NamedTuple):
    prefix: str
    description: str | None
    publish: bool
    anonymous_read: bool


class Category(NamedTuple):
    prefix: str
    description: str | None
    validate_geometry: bool


class StandardColumn(NamedTuple):
    name: str
    position: int
    data_type: str
    default: str | None
    schema_rule: str
    track_history: bool
    description: str | None


class RoleTemplate(NamedTuple):
    role: str
    kind: str
    schema_rule: str
    drop_with_schema: bool
    login: bool
    inherits: str | None
    description: str | None


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


LEVEL_DDL = "prefix string, description string, publish boolean, anonymous_read boolean"
CATEGORY_DDL = "prefix string, description string, validate_geometry boolean"
COLUMN_DDL = (
    "name string, position int, data_type string, `default` string, schema_rule string, "
    "track_history boolean, description string"
)
ROLE_DDL = (
    "role string, kind string, schema_rule string, drop_with_schema boolean, login boolean, "
    "inherits string, description string"
)

# The standard that ships by default.
DEFAULT_LEVELS = (
    Level("sk0", "open data", True, True),
    Level("sk1", "restricted municipal data", True, False),
    Level("sk2", "sensitive data", False, False),
    Level("skx", "unclassified data", False, False),
)
DEFAULT_CATEGORIES = (
    Category("ext", "external sources", False),
    Category("kba", "internal sources", True),
    Category("sys", "system and administration", False),
)
DEFAULT_COLUMNS = (
    StandardColumn("gid", 1, "integer GENERATED ALWAYS AS IDENTITY", None, "IS NOT NULL", False, "primary key"),
    StandardColumn("skapad_tidpunkt", -4, "timestamptz", "NOW()", "IS NOT NULL", False, "created at"),
    StandardColumn("skapad_av", -3, "character varying", "session_user", "LIKE '%_kba_%'", False, "created by"),
    StandardColumn("andrad_tidpunkt", -2, "timestamptz", "NOW()", "LIKE '%_kba_%'", True, "changed at"),
    StandardColumn("andrad_av", -1, "character varying", "session_user", "LIKE '%_kba_%'", True, "changed by"),
)
DEFAULT_ROLES = (
    RoleTemplate("r_{schema}", "read", "IS NOT NULL", True, False, None, "read group"),
    RoleTemplate("w_{schema}", "write", "IS NOT NULL", True, False, None, "write group"),
    RoleTemplate("gs_r_{schema}", "read", "IS NOT NULL", True, True, "r_{schema}", "read service account"),
    RoleTemplate("gs_w_{schema}", "write", "IS NOT NULL", True, True, "w_{schema}", "write service account"),
)
DEFAULT_SYSTEM_USERS = ("fme",)
EXPECTED_SRID = 3007


@dataclass(frozen=True)
class Config:
    levels: tuple[Level, ...] = DEFAULT_LEVELS
    categories: tuple[Category, ...] = DEFAULT_CATEGORIES
    columns: tuple[StandardColumn, ...] = DEFAULT_COLUMNS
    roles: tuple[RoleTemplate, ...] = DEFAULT_ROLES
    system_users: tuple[str, ...] = DEFAULT_SYSTEM_USERS
    expected_srid: int = EXPECTED_SRID
    system_owner: str = "system_owner"
    service_group: str = "service_accounts"

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    # ---- frames -------------------------------------------------------------------------
    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "levels": spark.createDataFrame(list(self.levels), _schema(LEVEL_DDL)),
            "categories": spark.createDataFrame(list(self.categories), _schema(CATEGORY_DDL)),
            "columns": spark.createDataFrame(list(self.columns), _schema(COLUMN_DDL)),
            "roles": spark.createDataFrame(list(self.roles), _schema(ROLE_DDL)),
        }

    # ---- patterns (N1) ------------------------------------------------------------------
    def level_pattern(self) -> str:
        return "^(" + "|".join(sorted(level.prefix for level in self.levels)) + ")_"

    def schema_pattern(self, previous: str | None = None) -> str | None:
        """``^(levels)_(categories)_.+$``; an empty standard keeps the previous pattern."""
        if not self.levels or not self.categories:
            return previous
        categories = "|".join(sorted(c.prefix for c in self.categories))
        return self.level_pattern() + f"({categories})_.+$"

    def publish_pattern(self) -> str | None:
        """Start of every schema name that is published; None when no level publishes."""
        levels = "|".join(sorted(level.prefix for level in self.levels if level.publish))
        categories = "|".join(sorted(c.prefix for c in self.categories))
        return f"^({levels})_({categories})_" if levels and categories else None

    def validated_pattern(self) -> str | None:
        """Start of every schema name whose geometry must be validated."""
        categories = "|".join(sorted(c.prefix for c in self.categories if c.validate_geometry))
        return self.level_pattern() + f"({categories})_" if self.levels and categories else None

    def standard_names(self) -> list[str]:
        return [column.name for column in self.columns]


def _rows(df: DataFrame, kind):
    return tuple(kind(**{name: row[name] for name in kind._fields}) for row in df.toLocalIterator())


def config_from_frames(frames: dict[str, DataFrame], base: Config = Config()) -> Config:
    """Read edited standards back, all rows."""
    kinds = {"levels": Level, "categories": Category, "columns": StandardColumn, "roles": RoleTemplate}
    return base.with_(**{k: _rows(frames[k], kind) for k, kind in kinds.items() if k in frames})


def load_config(spark: SparkSession, path: str | None = None) -> Config:
    """The standard from ``path/{levels,categories,columns,roles}`` or the shipped default."""
    if path is None:
        return Config()
    return config_from_frames(
        {k: spark.read.parquet(f"{path}/{k}") for k in ("levels", "categories", "columns", "roles")}
    )


def save_config(cfg: Config, spark: SparkSession, path: str) -> None:
    for name, frame in cfg.frames(spark).items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
