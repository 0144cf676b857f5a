"""Well-known text to vertex tables and back (G1), with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions import naming
from tablekeep.functions.compute import computed
from tablekeep.session import materialize, spread
from tablekeep.sources import members

CHUNK = 4096
# Fixed value: how a (possibly SRID-prefixed) text begins: type word, dimension mark, body.
HEAD = r"(?i)^\s*(?:SRID=(\d+);)?\s*([A-Z]+?)\s*(ZM|Z|M)?\s*(?=\(|EMPTY\s*$)"
FLAT_TYPES = naming.POINT_TYPES + naming.LINE_TYPES + naming.POLYGON_TYPES
KNOWN_TYPES = FLAT_TYPES + naming.ARC_TYPES + ("GEOMETRYCOLLECTION",)


def _marked_body() -> Column:
    """Coordinates as text with ``|`` between parts, ``;`` between rings, ``,`` between points."""
    body, kind = F.col("_body"), F.col("_kind")
    ring_gap = r"\)\s*,\s*\("
    polygons = F.regexp_replace(F.regexp_replace(body, r"\)\s*\)\s*,\s*\(\s*\(", "|"), ring_gap, ";")
    nested = F.nullif(F.array_join(F.regexp_extract_all(body, F.lit(r"\(([^()A-DF-Za-df-z]*)\)"), F.lit(1)), "|"), F.lit(""))
    marked = (
        F.when(kind == "MULTIPOINT", F.replace(F.regexp_replace(body, r"[()]", " "), F.lit(","), F.lit("|")))
        .when(kind == "MULTILINESTRING", F.regexp_replace(body, ring_gap, "|"))
        .when(kind == "POLYGON", F.regexp_replace(body, ring_gap, ";"))
        .when(kind == "MULTIPOLYGON", polygons)
        .when(kind.isin(*naming.ARC_TYPES[1:], "GEOMETRYCOLLECTION"), nested)
        .otherwise(body)
    )
    return F.trim(F.regexp_replace(marked, r"[()]", " "))


def _without_empty(body: Column) -> Column:
    """Body without EMPTY members; NULL when there is no other member."""
    left = F.regexp_replace(F.regexp_replace(body, r"(?i)EMPTY\s*,\s*", ""), r"(?i),\s*EMPTY", "")
    return F.when(~left.rlike(r"(?i)^\(\s*EMPTY\s*\)$"), left)


def _well_nested(skeleton: Column, kind: Column) -> Column:
    """Are the brackets those of the type? ``skeleton`` has ``t`` per point and ``E`` per EMPTY member.

    Lists are folded by plain replacement, inside out, so a text of any length is checked in a few
    passes: points into a line ``(t)``, lines into ``r``, rings into a polygon ``(r)``, and so on.
    """

    def fold(text: Column, *steps: tuple[str, str]) -> Column:
        for old, new in steps:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    lines = [(",t", ""), ("(t)", "r")]
    rings = fold(skeleton, *lines, (",r", ""))
    return (
        F.when(kind == "POINT", skeleton == "(t)")
        .when(kind == "LINESTRING", fold(skeleton, (",t", "")) == "(t)")
        .when(kind == "POLYGON", rings == "(r)")
        .when(kind == "MULTIPOINT", (skeleton == "(t)") | (fold(skeleton, ("(t)", "t"), ("E", "t"), (",t", "")) == "(t)"))
        .when(kind == "MULTILINESTRING", fold(skeleton, *lines, ("E", "r"), (",r", "")) == "(r)")
        .when(kind == "MULTIPOLYGON", fold(rings, ("(r)", "p"), ("E", "p"), (",p", "")) == "(p)")
        .otherwise(F.length(F.replace(skeleton, F.lit("("), F.lit(""))) == F.length(F.replace(skeleton, F.lit(")"), F.lit(""))))
    )


# Fixed value: a decimal number.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def heads(df: DataFrame, id_col: str, geom_col: str) -> DataFrame:
    """feature_id, _text, and the text's SRID, type word, dimension mark and body."""
    opened = F.instr("_text", "(")
    return computed(
        df.select(F.col(id_col).alias("feature_id"), F.col(geom_col).alias("_text")),
        {
            "_srid": F.regexp_extract("_text", HEAD, 1),
            "_kind": F.upper(F.regexp_extract("_text", HEAD, 2)),
            "_mark": F.upper(F.regexp_extract("_text", HEAD, 3)),
            "_body": F.when(opened > 0, F.rtrim(F.substr("_text", opened))),
        },
    )


def parse_wkt(df: DataFrame, id_col: str, geom_col: str) -> DataFrame:
    """One row per geometry: type, SRID, dimension, marked coordinate text, ``parse_error``.

    A text that is not well-known text, or holds something that is no number, gets an error and no
    coordinates. NULL stays NULL and is no error. How the brackets of collections and curve types are nested
    is judged in ``members``.
    """
    head = heads(df, id_col, geom_col)
    known = F.col("_kind").isin(*KNOWN_TYPES) & (F.col("_body").isNull() | F.col("_body").endswith(")"))
    points = F.regexp_replace(F.regexp_replace(F.regexp_replace("_body", NUMBER, "n"), r"\s+", " "), r"n(?: n)*+", "t")
    skeleton = F.regexp_replace(F.regexp_replace(points, "(?i)EMPTY", "E"), " ", "")
    head = computed(head, {"_known": F.coalesce(known, F.lit(False)), "_skeleton": skeleton})
    flat = F.col("_kind").isin(*FLAT_TYPES)
    head = computed(head, {"_nested": F.coalesce(_well_nested(F.col("_skeleton"), F.col("_kind")), F.lit(True))})
    head = head.withColumn("_body", F.when(flat, _without_empty(F.col("_body"))).otherwise(F.col("_body")))
    marked = computed(head, {"_marked": F.when(F.col("_known"), _marked_body())})
    # Every number becomes "n"; what is left must be separators and 2 to 4 numbers per point.
    shape = F.regexp_replace(F.regexp_replace("_marked", NUMBER, "n"), r"\s+", " ")
    shaped = computed(marked, {"_shape": shape})
    bad = (
        F.col("_shape").rlike(r"[^n |;,]")
        | F.col("_shape").contains("nn")
        | F.col("_shape").rlike(r"(?:^|[|;,]) ?n? ?(?:[|;,]|$)")
        | F.col("_shape").contains("n n n n n")
    )
    # One dimension for all points, and the one that the mark announces.
    longest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_shape", "n n n n", "4"), "n n n", "3"), "n n", "2")
    per_point = F.array_distinct(F.filter(F.split(F.regexp_replace(longest, "[^234]+", ","), ","), lambda x: x != ""))
    announced = F.when(F.col("_mark") == "ZM", 4).when(F.col("_mark") != "", 3)
    bad = bad | (F.size(per_point) > 1) | F.coalesce(F.get(per_point, 0).cast("int") != announced, F.lit(False))
    known, null, nested = F.col("_known"), F.col("_text").isNull(), F.col("_kind").isin(*members.NESTED_TYPES)
    error = F.when(null, None).when(~known, "not_wkt").when(F.coalesce(bad, F.lit(False)), "bad_coordinate")
    error = error.when(~F.col("_nested"), "not_wkt")
    judged = computed(shaped, {"parse_error": error})
    sound = F.col("parse_error").isNull() & ~null
    first = F.regexp_extract("_shape", r"^ ?([n ]+)", 1)
    dim = F.when(F.col("_marked").isNull(), F.length("_mark") + 2).otherwise(F.length(F.replace(first, F.lit(" "), F.lit(""))))
    return judged.select(
        "feature_id",
        F.when(sound, F.col("_kind")).alias("geom_type"),
        F.when(sound, F.coalesce(F.col("_srid").try_cast("int"), F.lit(0))).alias("srid"),
        F.when(sound, dim).alias("coord_dim"),
        "_mark",
        F.when(sound, F.col("_marked")).alias("marked"),
        sound.alias("_sound"),
        "parse_error",
        *(F.when(nested, F.col(c)).alias(name) for c, name in (("_kind", "_top"), ("_body", "_inner"))),
    )


def explode_wkt(df: DataFrame, id_col: str, geom_col: str) -> tuple[DataFrame, DataFrame]:
    """G1: (features, vertices). Parsing is a chain of projections and explodes: no Python, and no
    array of a whole geometry's points is ever built.

    A vertex says which member of its feature it belongs to, and of what type that member is: flat
    geometries are their own single member, collections and curve types are taken apart (``members``), and a curve
    without any arc has the flat type of the same structure. Texts are parsed once, in slices of bounded
    row count, and the result is stored for both tables.
    """
    texts = spread(df.select(id_col, geom_col), id_col, geom_col)
    parsed = materialize(parse_wkt(texts, id_col, geom_col), "wkt-parsed")
    n_points = F.when(F.col("marked").isNotNull(), F.length(F.regexp_replace("marked", r"[^|;,]", "")) + 1).otherwise(0)
    some = not parsed.filter("_inner IS NOT NULL").isEmpty()  # else there is nothing to take apart
    if some:
        structure, lists = members.nested(parsed)
        broken = structure.filter(~F.col("well_formed")).select("feature_id", F.lit("not_wkt").alias("_broken"))
        judged = parsed.join(broken, "feature_id", "left").withColumn("_sound", F.col("_sound") & F.col("_broken").isNull())
    else:
        judged = parsed.withColumn("_broken", F.lit(None).cast("string"))
    sound = F.col("_sound")
    features = judged.select(
        "feature_id", *(F.when(sound, F.col(c)).alias(c) for c in ("geom_type", "srid", "coord_dim")),
        F.when(sound, n_points).alias("n_points"),
        F.when(sound, F.col("marked").isNull()).alias("is_empty"),
        F.coalesce("_broken", "parse_error").alias("parse_error"),
    )
    flat = parsed.filter(F.col("marked").isNotNull() & ~F.col("geom_type").isin(*members.NESTED_TYPES))
    own = [F.lit(1).alias("member"), F.col("geom_type").alias("member_type")]
    parts = flat.select("feature_id", "_mark", *own, F.posexplode(F.split("marked", r"\|")).alias("part", "_part"))
    rings = parts.select("feature_id", "_mark", "member", "member_type", "part", F.posexplode(F.split("_part", ";")).alias("ring", "_ring"))
    points = rings.select("feature_id", "_mark", "member", "member_type", (F.col("part") + 1).alias("part"), (F.col("ring") + 1).alias("ring"),
                          F.posexplode(F.split("_ring", ",")).alias("idx", "_point"))
    place = ["feature_id", "member", "member_type", "part", "ring"]
    numbers = points.select(*place, (F.col("idx") + 1).alias("idx"), "_mark", F.split(F.trim("_point"), r"\s+").alias("_n"))
    if some:
        numbers = numbers.unionByName(members.points(lists).select(*place, "idx", "_mark", "_n"))

    def number(i: int) -> Column:
        return F.get("_n", i).cast("double")

    third_is_m = F.col("_mark") == "M"
    vertices = numbers.select(
        "feature_id", "part", "ring", "idx",
        number(0).alias("x"),
        number(1).alias("y"),
        F.when(~third_is_m, number(2)).alias("z"),
        F.when(third_is_m, number(2)).otherwise(number(3)).alias("m"),
        "member", "member_type",
    )
    return features, vertices


def _plain(value: Column) -> Column:
    """A double in decimal notation: large and small ones would print with an exponent."""
    text = value.cast("string")
    big = value.cast("decimal(38,15)").cast("string")
    small = value.cast("decimal(38,30)").cast("string")
    decimal = F.when(F.abs(value).between(1e7, 1e22), big).when(F.abs(value).between(1e-25, 1e-3), small).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.coalesce(decimal, text), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def assemble_wkt(features: DataFrame, vertices: DataFrame) -> DataFrame:
    """Text of each feature. Coordinates are joined in order inside pieces of a ring, pieces into
    rings, rings into parts, parts into the feature, so sorting is always over few values; only
    the finished text, which is one value by definition, ends up in one row."""
    ordinates = [c for c in ("x", "y", "z", "m") if c in vertices.columns]
    number = F.concat_ws(" ", *(_plain(F.col(c)) for c in ordinates))
    m_only = F.max(F.col("z").isNull() & F.col("m").isNotNull()) if {"z", "m"} <= set(ordinates) else F.max(F.lit(False))
    measured = vertices.groupBy("feature_id").agg(m_only.alias("_m_only"))

    def joined(df: DataFrame, keys: list[str], order: str, text: str, sep: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
        return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("text"))

    points = vertices.select("feature_id", "part", "ring", "idx", F.floor((F.col("idx") - 1) / CHUNK).alias("piece"), number.alias("text"))
    pieces = joined(points, ["feature_id", "part", "ring", "piece"], "idx", "text", ", ")
    rings = joined(pieces, ["feature_id", "part", "ring"], "piece", "text", ", ")
    parts = joined(rings, ["feature_id", "part"], "ring", "text", "), (")
    whole = joined(parts, ["feature_id"], "part", "text", "|")
    kind = F.col("geom_type")
    three = F.when(F.col("_m_only"), " M").otherwise(" Z")
    mark = F.when(F.col("coord_dim") == 4, " ZM").when(F.col("coord_dim") == 3, three).otherwise("")
    body = (
        F.when(kind.isin("POLYGON"), F.concat(F.lit("(("), "text", F.lit("))")))
        .when(kind.isin("MULTILINESTRING", "MULTIPOINT"), F.concat(F.lit("(("), F.replace("text", F.lit("|"), F.lit("), (")), F.lit("))")))
        .when(kind == "MULTIPOLYGON", F.concat(F.lit("((("), F.replace("text", F.lit("|"), F.lit(")), ((")), F.lit(")))")))
        .otherwise(F.concat(F.lit("("), "text", F.lit(")")))
    )
    text = F.when(F.col("text").isNull(), F.concat(kind, mark, F.lit(" EMPTY"))).otherwise(F.concat(kind, mark, body))
    return features.join(whole.join(measured, "feature_id"), "feature_id", "left").select("feature_id", F.when(kind.isin(*FLAT_TYPES), text).alias("wkt"))
