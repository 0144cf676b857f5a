"""Members of collections and curve types in well-known text (G1): a scan of brackets by prefix sums.

The text between the outer brackets is cut into tokens: coordinate lists, brackets, commas and words.
Depth is a running sum over brackets; a closing bracket finds its opening one as its neighbour on
the same level; a second running sum counts the collections around a token, which tells where a
member begins. Parts, rings and pieces are running counts from there. No token looks further than
its own feature, and only texts of nested kinds are cut at all. The texts are shuffled once, as they
are; tokens stay in the task that cut them, and only coordinate lists are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.functions import naming
from tablekeep.functions.compute import computed
from tablekeep.session import materialize, spread

COLLECTION = "GEOMETRYCOLLECTION"
NESTED_TYPES = naming.ARC_TYPES[1:] + (COLLECTION,)
# A coordinate list (of letters only an exponent's e), a word, a separator.
TOKEN = r"\([^()A-DF-Za-df-z]*\)|[A-Za-z]+|[(),]"
BEGINS = r"(?i)^\s*(?:SRID=\d+;)?\s*(?:" + "|".join(NESTED_TYPES) + ")"
WORD = r"^([A-Z]+?)(?:ZM|Z|M)?$"
SINGLE = ("POINT", "LINESTRING", "CIRCULARSTRING")
MULTI_SURFACES = ("MULTIPOLYGON", "MULTISURFACE")
SURFACES = ("POLYGON", "CURVEPOLYGON", *MULTI_SURFACES)
# A curve type without any arc is the flat type of the same structure.
STRAIGHT = {
    "COMPOUNDCURVE": "LINESTRING", "MULTICURVE": "MULTILINESTRING", "CURVEPOLYGON": "POLYGON", "MULTISURFACE": "MULTIPOLYGON",
}


def _allowed() -> Column:
    """What each type may hold, level by level below the member's own bracket: (type, level, kind, word) as one text each."""
    bare, curve = ("",), ("", "CIRCULARSTRING")
    rules = [(t, 0, ("leaf", "empty"), (t,)) for t in SINGLE]
    rules += [(t, 0, ("open", "empty"), (t,)) for t in ("MULTIPOINT", "MULTILINESTRING", "COMPOUNDCURVE", "MULTICURVE", *SURFACES)]
    rules += [("MULTIPOINT", 0, ("leaf",), ("MULTIPOINT",))]
    rules += [(t, 1, ("leaf", "empty"), bare) for t in ("MULTIPOINT", "MULTILINESTRING")]
    rules += [("POLYGON", 1, ("leaf",), bare), ("MULTIPOLYGON", 1, ("open", "empty"), bare), ("MULTIPOLYGON", 2, ("leaf",), bare)]
    rules += [("COMPOUNDCURVE", 1, ("leaf",), curve), ("MULTISURFACE", 1, ("open", "empty"), ("", "CURVEPOLYGON"))]
    for t, level in (("CURVEPOLYGON", 1), ("MULTICURVE", 1), ("MULTISURFACE", 2)):
        rules += [(t, level, ("leaf", "empty"), curve), (t, level, ("open",), ("COMPOUNDCURVE",)), (t, level + 1, ("leaf",), curve)]
    texts = sorted({f"{t}:{level}:{kind}:{word}" for t, level, kinds, words in rules for kind in kinds for word in words})
    place = F.concat_ws(":", "root", F.col("r").cast("string"), "kind", F.coalesce("word", F.lit("")))
    return F.col("root").isNotNull() & place.isin(*texts)


def _tokens(texts: DataFrame) -> DataFrame:
    """Tokens of texts(feature_id, top, body, ...) with kind, word, whether they may follow the one before, and depth.

    Of the texts themselves only those of coordinate lists are kept.
    """
    kept = [c for c in texts.columns if c not in ("top", "body")]
    cut = texts.select(*kept, "top", F.posexplode(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    upper = F.upper("token")
    kind = (
        F.when(F.col("token") == "(", "open").when(F.col("token") == ")", "close").when(F.col("token") == ",", "comma")
        .when(F.col("token").startswith("("), "leaf").when(upper == "EMPTY", "empty").when(upper.isin("Z", "M", "ZM"), "mark").otherwise("word")
    )
    named = cut.select(*kept, "pos", "token", F.when(F.col("pos") == 0, F.col("top")).alias("_top"), kind.alias("kind"))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    typed = named.select(
        *kept, "pos", "_top", "kind", step.alias("step"),
        F.when(F.col("kind") == "leaf", F.col("token")).alias("token"),
        F.when(F.col("kind") == "word", F.regexp_extract(F.upper("token"), WORD, 1)).alias("_type"),
    )
    w = Window.partitionBy("feature_id").orderBy("pos")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    beside = typed.select(
        "*", *(F.lag("kind", n).over(w).alias(f"_kind{n}") for n in (1, 2, 3)), *(F.lag("_type", n).over(w).alias(f"_type{n}") for n in (1, 2)),
        F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth"),
    )
    marked = F.col("_kind1") == "mark"
    word = F.when(F.col("pos") == 0, F.col("_top")).when(marked, F.col("_type2")).otherwise(F.col("_type1"))
    before = F.when(marked, F.col("_kind3")).when(F.col("_kind1") == "word", F.col("_kind2")).otherwise(F.col("_kind1"))
    element = F.col("kind").isin("open", "leaf", "empty")
    follows = (
        F.when(F.col("pos") == 0, F.col("kind").isin("open", "leaf"))
        .when(element, before.isin("open", "comma"))
        .when(F.col("kind").isin("comma", "close"), F.col("_kind1").isin("leaf", "close", "empty"))
        .when(F.col("kind") == "mark", F.col("_kind1") == "word")
        .otherwise(F.col("_kind1").isin("open", "comma"))
    )
    return beside.select(
        *kept, "pos", "kind", "token", "step", "depth", F.when(element, word).alias("word"), F.coalesce(follows, F.lit(False)).alias("follows")
    )


def scan(texts: DataFrame) -> DataFrame:
    """Tokens of texts(feature_id, top, body, ...) with depth, member and the member's type (``root``).

    ``r`` is the depth below the member's own bracket; ``well`` tells whether the token may stand there.
    Further columns of the texts stay.
    """
    kept = [c for c in texts.columns if c not in ("top", "body")]
    order = Window.partitionBy("feature_id").orderBy("pos")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    # A closing bracket lies one deeper than its opening one; on that level the two are neighbours.
    bracket = F.col("kind").isin("open", "close")
    level = F.when(bracket, F.col("depth") - F.when(F.col("kind") == "close", 1).otherwise(0))
    opened = F.lag("word").over(Window.partitionBy("feature_id", "level").orderBy("pos"))
    paired = _tokens(texts).withColumn("level", level).withColumn("opened", F.when(F.col("kind") == "open", F.col("word")).otherwise(opened))
    wrap = F.when(bracket & (F.col("opened") == COLLECTION), F.col("step")).otherwise(0)
    around = paired.withColumn("around", F.coalesce(F.sum(wrap).over(earlier), F.lit(0))).drop("level", "opened")
    element = F.col("kind").isin("open", "leaf", "empty")
    begins = element & (F.col("depth") == F.col("around")) & (F.coalesce("word", F.lit("")) != COLLECTION)
    owned = around.withColumn("begins", begins).select(
        "*",
        F.sum(F.col("begins").cast("int")).over(so_far).alias("member"),
        F.last(F.when(F.col("begins"), F.coalesce("word", F.lit("?"))), ignorenulls=True).over(so_far).alias("root"),
    )
    placed = owned.withColumn("r", F.col("depth") - F.col("around"))
    collection = F.col("word") == COLLECTION
    once = (F.col("depth") > 0) | (F.col("pos") == 0)  # nothing after the outer bracket
    one_point = (F.col("word") != "POINT") | ~F.col("token").contains(",")
    inside = F.when(collection, F.col("depth") == F.col("around")).when(element, _allowed() & F.coalesce(one_point, F.lit(True))).otherwise(True)
    return placed.select(
        *kept, "pos", "token", "kind", "word", "member", "root", "r", "step",
        (F.col("follows") & once & F.coalesce(inside, F.lit(False))).alias("well"),
    )


def lists(tokens: DataFrame) -> DataFrame:
    """Coordinate lists of scanned tokens, and each text's first token, which may be none (``listed``).

    Columns: feature_id, member, member_type, part, ring, piece, before (points of earlier pieces, each
    joined to the next by one point), text, well (of the whole feature), first, listed, and further ones of the texts.
    Parts are numbered through the whole feature; every point of a MULTIPOINT list is one, and
    ``part`` is then the first of them. Pieces are those of a compound curve, which is one line or
    ring; each has to begin where the one before it ends.
    """
    kept = [c for c in tokens.columns if c not in ("feature_id", "pos", "token", "kind", "word", "member", "root", "r", "step", "well", "junk")]
    order = Window.partitionBy("feature_id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaf, element, root = F.col("kind") == "leaf", F.col("kind").isin("open", "leaf"), F.col("root")
    surface, scattered = root.isin(*SURFACES), root == "MULTIPOINT"
    level = root.isin(*MULTI_SURFACES, "MULTILINESTRING", "MULTICURVE").cast("int")  # where parts begin
    size = F.length(F.regexp_replace("token", "[^,]", "")) + 1
    part = F.when(scattered, F.when(leaf, size).otherwise(0)).otherwise((element & (F.col("r") == level)).cast("int"))
    ring = F.when(surface & element & (F.col("r") == level + 1), 1).otherwise(0)
    numbered = tokens.withColumns({"_points": part, "_ring": ring}).select(
        "*", F.sum("_points").over(so_far).alias("_part"), F.sum("_ring").over(so_far).alias("_rings"),
        (F.min("well").over(whole) & (F.sum("step").over(whole) == 0) & ~F.col("junk")).alias("_well"),
    )
    # Rings are counted through the feature; those before the part are taken off.
    outside = F.last(F.when(F.col("_points") > 0, F.col("_rings") - F.col("_ring")), ignorenulls=True).over(so_far)
    rings = numbered.withColumn("ring", F.when(surface, F.col("_rings") - F.coalesce(outside, F.lit(0))).otherwise(1))
    found = rings.withColumn("listed", leaf).filter(F.col("listed") | (F.col("pos") == 0))
    numbers = lambda text: F.split(F.trim(text), r"\s+").cast("array<double>")
    first = F.when(scattered, F.col("_part") - F.col("_points") + 1).otherwise(F.col("_part"))
    ends = computed(found.withColumns({"part": first, "text": F.trim(F.translate("token", "()", "  "))}), {
        "_size": size, "_head": numbers(F.substring_index("text", ",", 1)), "_tail": numbers(F.substring_index("text", ",", -1)),
    })
    in_ring = Window.partitionBy("feature_id", "_part", "listed", "ring").orderBy("pos")
    joined = ends.select(
        "*", F.row_number().over(in_ring).alias("piece"),
        F.coalesce(F.sum(F.col("_size") - 1).over(in_ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lag("_tail").over(in_ring) != F.col("_head"), F.lit(False)).alias("_gap"),
    )
    curved = F.max(F.coalesce(F.col("word") == "CIRCULARSTRING", F.lit(False))).over(Window.partitionBy("feature_id", "member"))
    gaps = F.max("_gap").over(Window.partitionBy("feature_id"))
    straight = F.create_map(*(F.lit(v) for pair in STRAIGHT.items() for v in pair))
    judged = joined.withColumn("arc", curved).withColumn("well", F.coalesce(F.col("_well"), F.lit(False)) & ~gaps)
    kind = F.when(F.col("arc"), F.col("root")).otherwise(F.coalesce(straight[F.col("root")], F.col("root")))
    return judged.select(
        "feature_id", F.col("member").cast("int"), kind.alias("member_type"), F.col("part").cast("int"), F.col("ring").cast("int"), "piece",
        "before", "text", "well", (F.col("pos") == 0).alias("first"), "listed", *kept,
    )


def points(found: DataFrame) -> DataFrame:
    """(feature_id, _mark, member, member_type, part, ring, idx, _n) of ``lists``, _n the numbers of a point.

    A piece of a compound curve begins where the one before it ends; that point is kept once.
    """
    many = F.col("member_type") == "MULTIPOINT"
    each = found.select("*", F.posexplode(F.split("text", ",")).alias("_i", "_point")).filter("piece = 1 OR _i > 0")
    return each.select(
        "feature_id", "_mark", "member", "member_type", F.when(many, F.col("part") + F.col("_i")).otherwise(F.col("part")).alias("part"), "ring",
        F.when(many, 1).otherwise(F.col("before") + F.col("_i") + 1).cast("int").alias("idx"),
        F.split(F.trim("_point"), r"\s+").alias("_n"),
    )


def nested(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structure, lists) of parsed(feature_id, _top, _inner, _mark, _sound), _inner being texts of nested kinds.

    structure: feature_id, well_formed. lists: ``lists`` of sound and well-formed features. Both are
    read from one stored table. Texts without an id belong to no feature.
    """
    texts = parsed.filter("_inner IS NOT NULL AND feature_id IS NOT NULL")
    junk = F.trim(F.regexp_replace("_inner", TOKEN, "")).rlike(r"\S")
    texts = texts.select("feature_id", F.col("_top").alias("top"), F.col("_inner").alias("body"), "_mark", "_sound", junk.alias("junk"))
    found = materialize(lists(scan(spread(texts, "feature_id"))), "wkt-lists")
    return found.filter("first").select("feature_id", F.col("well").alias("well_formed")), found.filter("listed AND well AND _sound")
