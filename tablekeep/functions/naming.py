"""Name and geometry-type expressions shared by the audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name limits, suffixes per geometry family, reserved endings.
MAX_TABLE_NAME = 54
MAX_IDENTIFIER = 63
INDEX_STEM = 50
POINT_TYPES = ("POINT", "MULTIPOINT")
LINE_TYPES = ("LINESTRING", "MULTILINESTRING")
POLYGON_TYPES = ("POLYGON", "MULTIPOLYGON")
ARC_TYPES = ("CIRCULARSTRING", "COMPOUNDCURVE", "CURVEPOLYGON", "MULTICURVE", "MULTISURFACE")
GEOMETRY_SUFFIX = "_[plyg]$"
HISTORY_SUFFIX = "_h$"


def is_system_schema(schema: Column) -> Column:
    return schema.isin("public", "information_schema") | schema.rlike("^pg_")


def expected_suffix(geom_type: Column) -> Column:
    """Point ``_p``, line ``_l``, polygon ``_y``, anything else ``_g``."""
    return (
        F.when(geom_type.isin(*POINT_TYPES), "_p")
        .when(geom_type.isin(*LINE_TYPES), "_l")
        .when(geom_type.isin(*POLYGON_TYPES), "_y")
        .otherwise("_g")
    )


def ends_with_suffix(name: Column, suffix: Column, strict: bool = False) -> Column:
    """Suffix test. By default the underscore is a wildcard (``karp`` passes for ``_p``)."""
    if strict:
        return name.endswith(suffix)
    return (F.length(name) >= 2) & (F.right(name, F.lit(1)) == F.right(suffix, F.lit(1)))


def suggest_name(name: Column, geom_type: Column) -> Column:
    """Swap any geometry suffix for the one the geometry type asks for."""
    return F.concat(F.regexp_replace(name, GEOMETRY_SUFFIX, ""), expected_suffix(geom_type))


def basal_type(geom_type: Column) -> Column:
    """Geometry type without its Z/M/ZM ending."""
    return F.regexp_replace(geom_type, "[ZM]+$", "")


def dimension_suffix(geom_type: Column, coord_dim: Column) -> Column:
    return (
        F.when(coord_dim == 4, "ZM")
        .when((coord_dim == 3) & geom_type.endswith("M"), "M")
        .when(coord_dim == 3, "Z")
        .otherwise("")
    )


def geometry_definition(full_type: Column, srid: Column) -> Column:
    return F.concat(F.lit("geometry("), full_type, F.lit(","), srid.cast("string"), F.lit(")"))


def history_name(table: Column) -> Column:
    return F.left(F.concat(table, F.lit("_h")), F.lit(MAX_IDENTIFIER))


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
