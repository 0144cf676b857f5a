"""Type text: from inventory rows to full column types, and from those to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Database type names and the Spark types that hold them.
SPARK_TYPES = {
    "integer": "int",
    "bigint": "bigint",
    "smallint": "smallint",
    "text": "string",
    "character varying": "string",
    "character": "string",
    "boolean": "boolean",
    "double precision": "double",
    "real": "float",
    "date": "date",
    "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp",
    "timestamp": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz",
}
IDENTITY = re.compile(r"(?i)\s+GENERATED\s+(ALWAYS|BY DEFAULT)\s+AS\s+IDENTITY")


def is_identity(data_type: str) -> bool:
    return IDENTITY.search(data_type) is not None


def spark_type(data_type: str) -> str:
    """Spark type for a database type; keys grow past 2^31 rows, so identities are bigint."""
    if is_identity(data_type):
        return "bigint"
    base = data_type.strip().lower()
    numeric = re.fullmatch(r"numeric\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", base)
    if numeric:
        return f"decimal({numeric[1]},{numeric[2]})"
    return SPARK_TYPES.get(re.sub(r"\s*\(\d+\)$", "", base), "string")


def full_type(data_type: Column, length: Column, precision: Column, scale: Column, geometry: Column) -> Column:
    """Complete type text; a geometry column shows its own definition."""
    return (
        F.when(geometry.isNotNull(), geometry)
        .when(
            (data_type == "character varying") & length.isNotNull(),
            F.concat(data_type, F.lit("("), length.cast("string"), F.lit(")")),
        )
        .when(
            (data_type == "numeric") & precision.isNotNull(),
            F.concat(
                F.lit("numeric("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")")
            ),
        )
        .otherwise(data_type)
    )
