"""Numbering rows without ever putting them all, or one hot group, in a single task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.session import materialize

PIECE_ROWS = 2_000_000  # rows of a piece that one task may have to hold
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_ids(
    df: DataFrame, order_by: list[str | Column], name: str = "gid", start: int = 1, partitions: int | None = None
) -> DataFrame:
    """Consecutive ids in global order.

    One range shuffle spreads the rows evenly whatever the key distribution (equal keys are told
    apart by a row hash, identical rows by where they were read, so even a value or row that fills
    a third of the table is cut); each row gets its place inside its range partition; the result is
    written once to the shared folder so the places are fixed; per-partition row counts (one row
    per partition) give the offsets.
    """
    hashable = [f.name for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())]
    tied = df.withColumns({"_hash": F.xxhash64(*hashable), "_read": F.monotonically_increasing_id()})
    order = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col("_hash"), F.col("_read")]
    ranged = tied.repartitionByRange(partitions, *order) if partitions else tied.repartitionByRange(*order)
    sorted_rows = ranged.sortWithinPartitions(*order).drop("_hash", "_read")
    placed = materialize(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "dense-ids")
    piece = F.shiftright("_place", _ROW_BITS)
    counts = placed.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_n"))
    # One row per range partition, so a single-task running sum over it is bounded.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_piece", piece)
        .join(offsets, "_piece")
        .withColumn(name, (F.col("_offset") + place + F.lit(start)).cast("bigint"))
        .select(name, *df.columns)
    )


def cut_by_rows(df: DataFrame, order_by: list[str], name: str = "_piece", partitions: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows with a piece number that grows with ``order_by`` and cuts the table by row count.

    Pieces are range partitions, so whatever the keys and times are, a group that fills most of the
    table lies in many pieces of about equal size. ``order_by`` has to tell rows apart (end it with a
    sequence number). Written once to the shared folder, which fixes the pieces for all later uses.
    A table of up to ``piece_rows`` rows may end up in few pieces or one; beyond, the row count gives
    their number, so that a piece does not grow with the table. ``partitions`` sets it outright.
    """
    if partitions is None:
        wanted = -(-df.count() // piece_rows)
        partitions = max(wanted, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if wanted > 1 else None
    ranged = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    return materialize(ranged.withColumn(name, F.spark_partition_id()), "pieces")


def running_count(df: DataFrame, keys: list[str], order_col: str, flag: Column, name: str, piece: str) -> DataFrame:
    """Running count of ``flag`` per group in the order of ``order_col``.

    ``piece`` names a column that grows with the order and cuts every group into bounded pieces,
    so a group holding most of the table is still many tasks. Piece totals, one row per piece,
    carry the count over.
    """
    df = df.withColumn("_one", flag.cast("int"))
    within = Window.partitionBy(*keys, piece).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, piece).agg(F.sum("_one").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, piece, F.sum("_total").over(earlier).alias("_carry"))
    return (
        df.withColumn("_within", F.sum("_one").over(within))
        .join(carry.filter("_carry IS NOT NULL"), [*keys, piece], "left")
        .withColumn(name, F.col("_within") + F.coalesce("_carry", F.lit(0)))
        .drop("_one", "_within", "_carry")
    )


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str, step: int = 1
) -> DataFrame:
    """Value of the next (``step=1``) or previous (``step=-1``) row of the group.

    ``chunk`` must grow with ``order`` (a piece of ``cut_by_rows``, a block of numbers). Rows are windowed per
    (group, chunk), so a hot group spreads over its chunks; the value at a chunk's edge comes
    from a summary with one row per chunk.
    """
    df = df.withColumn("_chunk", chunk).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    shift = F.lead if step > 0 else F.lag
    edge = F.min_by if step > 0 else F.max_by
    summary = df.groupBy(*keys, "_chunk").agg(edge("_value", F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carry = summary.select(*keys, "_chunk", shift("_edge").over(across).alias("_carry")).filter("_carry IS NOT NULL")
    return (
        df.withColumn("_inside", shift("_value").over(inside))
        .join(carry, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry")["v"])
        .drop("_chunk", "_value", "_inside", "_carry")
    )


def last_before(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Last non-NULL ``value`` among the earlier rows of the group.

    Same cut as ``neighbour``: windows stay inside (group, chunk) and a summary with one row per
    chunk carries the value over.
    """
    df = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    return (
        df.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carry.filter("_carry IS NOT NULL"), [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_chunk", "_value", "_inside", "_carry")
    )
