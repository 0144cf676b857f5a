"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and their places
become integer names; then adjacent names are paired, the distinct pairs sorted and named the same
way, until every text has a single name. Names are given after comparing whole contents, so two
texts share a name on the same level if and only if they are equal; a 64-bit hash only carries
blocks to their names and is checked for clashes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import take
from tablekeep.session import materialize

BLOCK_CHARS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def blocks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points; the empty text is one empty piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def named(keys: DataFrame, label: str, keep: list[str]) -> DataFrame:
    """Distinct keys with integer names in sorted order: partition number, then place in it."""
    ordered = keys.distinct().sortWithinPartitions(*keys.columns)
    return materialize(ordered.select(*keep, F.monotonically_increasing_id().alias("name")), label)


def text_names(docs: DataFrame, block_chars: int, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with row number, id and SHA-256; row number with level and name of the whole text)."""
    key = F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block")
    pieces = docs.select(F.explode(blocks(normal(F.col("text")), block_chars)).alias("block")).select(key.alias("h"), "block")
    names = named(pieces, "block-names", ["h"])
    clash = not names.groupBy("h").count().filter("count > 1").isEmpty()
    if clash:  # different blocks with one hash: compare contents in the join as well
        names = named(pieces, "block-names", ["h", "block"])
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normal(F.col("text")).alias("text"))
    cut = text.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), blocks(F.col("text"), block_chars).alias("blocks"))
    hashed = F.transform(
        "blocks",
        lambda b: F.struct(
            (F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(b)).alias("h"),
            *([b.alias("block")] if clash else []),
        ),
    )
    rows = materialize(cut.withColumn("blocks", hashed), "exact-rows")
    items = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "b")).select("row", "n", "pos", "b.*")
    longest = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    done, level = [], 0
    while True:
        on = [c for c in names.columns if c != "name"]
        known = materialize(items.join(names, on).select("row", "n", "pos", "name"), "exact-level")
        done.append(known.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        half = F.col("pos").bitwiseAND(F.lit(1))
        items = (
            known.filter("n > 1")
            .groupBy("row", F.shiftright(F.col("n") + 1, 1).alias("n"), F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(half == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        names = named(items.select("a", "b"), "pair-names", ["a", "b"])
        longest, level = (longest + 1) // 2, level + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return rows.select("row", "doc_id", "text_sha256"), whole


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space (space, U+0009 to U+000D)
    is replaced by one space; null counts as empty. The row with the smallest id stays. A null id
    comes after all others, and keep_id is null only where a whole group has none. Of repeated rows
    with the smallest id exactly one stays. Other columns are ignored; an empty table gives none.

    ``hash_bits`` shortens the carrier hash, to test the path for clashing hashes.
    """
    rows, names = text_names(take(docs, id_col, text_col).toDF("doc_id", "text"), block_chars, hash_bits)
    both = materialize(rows.join(names, "row"), "exact-names")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = materialize(both.groupBy("level", "name").agg(first, F.count("*").alias("group_size")), "exact-groups")
    return both.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
