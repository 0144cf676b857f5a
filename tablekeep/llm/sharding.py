"""A reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows get consecutive numbers in a fixed order. The numbers 0 to n-1 lie in a rectangle of a x b
cells, a = ceil(sqrt(n)); a Feistel network over its two coordinates permutes the cells, and a
number that lands on one of the fewer than a cells beyond n-1 walks on along its cycle until it is
back inside. Place p of the shuffle is slot p div shards of shard p mod shards. Any row's shard and
slot, and the row at any shard and slot, can be computed alone, without a table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm.words import take
from tablekeep.operators.ordering import dense_ids
from tablekeep.session import materialize

SHARDS, ROUNDS = 24, 6


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class Feistel:
    """The permutation of 0 .. n-1 that belongs to (n, seed), as column expressions."""

    def __init__(self, spark: SparkSession, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.a = isqrt(n - 1) + 1 if n else 1
        self.b = -(-n // self.a) if n else 1
        self.walks = self._longest_walk(spark) if n < self.a * self.b else 1

    def _mixed(self, i: Column, x: Column) -> Column:
        """60 bits of the SHA-256 of seed, round and value: plain SQL on any engine, no overflow."""
        text = F.concat_ws(":", F.lit(str(self.seed)), i.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")

    def _cell(self, x: Column, sign: int) -> Column:
        """One pass through the network, or back through it: even rounds move in a, odd ones in b."""
        order = range(self.rounds) if sign > 0 else reversed(range(self.rounds))
        start = F.struct(div(x, F.lit(self.b)).alias("l"), (x % F.lit(self.b)).alias("r"))

        def one(s: Column, i: Column) -> Column:
            move = lambda old, by, size: F.pmod(old + F.lit(sign) * F.pmod(by, F.lit(size)), F.lit(size))
            even = i % 2 == 0
            return F.struct(
                F.when(even, move(s["l"], self._mixed(i, s["r"]), self.a)).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(move(s["r"], self._mixed(i, s["l"]), self.b)).alias("r"),
            )

        end = lambda s: s["l"] * F.lit(self.b) + s["r"]
        return F.aggregate(F.array(*map(F.lit, order)), start.cast("struct<l:bigint,r:bigint>"), one, end)

    def _longest_walk(self, spark: SparkSession) -> int:
        """Passes that take every row back inside; only the cells beyond n-1, fewer than sqrt(n) + 1, are looked at."""
        entered = self._cell(F.col("x"), -1) < self.n  # cells on cycles that never touch a row are left alone
        outside, passes = spark.range(self.n, self.a * self.b).toDF("x").filter(entered), 1
        while not (outside := materialize(outside, "sharding-outside")).isEmpty():
            outside = outside.select(self._cell(F.col("x"), 1).alias("x")).filter(F.col("x") >= self.n)
            passes += 1
        return passes

    def _walk(self, x: Column, sign: int) -> Column:
        first = self._cell(x, sign)
        if self.walks == 1:
            return first
        on = lambda y, _: F.when(y < self.n, y).otherwise(self._cell(y, sign))
        return F.aggregate(F.sequence(F.lit(2), F.lit(self.walks)), first, on)

    def place(self, row: Column) -> Column:
        """Place in the shuffle of a row number."""
        return self._walk(row, 1)

    def row(self, place: Column) -> Column:
        """Row number at a place of the shuffle."""
        return self._walk(place, -1)


def numbered(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """The rows with ``row``, 0 to n-1 in the order of ``order_by``, nulls last."""
    order = [F.col(c).asc_nulls_last() for c in order_by]
    return dense_ids(rows, order, "row", 0)


def with_shards(rows: DataFrame, order_by: list[str], shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows with row (number in ``order_by``), shard (int) and slot (long, gapless from 0).

    Shards differ by at most one row, whatever the sizes. The result depends on the order, the row
    count, ``shards`` and ``seed`` alone, not on partitions; rows alike in ``order_by`` may trade places. An empty table gives none.
    """
    table = materialize(numbered(rows, order_by), "sharding-rows")
    n = table.count()
    place = Feistel(rows.sparkSession, n, seed).place(F.col("row"))
    placed = table.select("*", F.inline(F.array(F.struct(place.alias("place")))))
    shard, slot = (F.col("place") % F.lit(shards)).cast("int"), div(F.col("place"), F.lit(shards))
    return placed.withColumns({"shard": shard, "slot": slot}).drop("place")


def row_at(spark: SparkSession, n: int, shard: Column, slot: Column, shards: int = SHARDS, seed: int = 0) -> Column:
    """The row number that ``with_shards`` puts at (shard, slot) of a table of n rows."""
    return Feistel(spark, n, seed).row((slot * F.lit(shards) + shard).cast("bigint"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 8. The law is ``rows``: shards differ by at most one
    row. It looks at no group, so equal texts may lie in different shards, and grown_shard is null: a
    further shard deals all rows anew. A null text counts as empty. Rows are numbered by id (nulls
    last), size, CRC-32 and a hash of the text, so repeated rows differ in their places alone. Other columns
    are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = take(docs, id_col, text_col).toDF("doc_id", "text").select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    placed = with_shards(materialize(narrow, "sharding-sizes"), ["doc_id", "size", "text_crc32", "text_hash"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, order_by: list[str], shards: int = SHARDS, seed: int = 0, tasks: int | None = None) -> None:
    """Whole rows as Parquet under ``path``/shard=<k>, in slot order; a shard is cut into as many files as its tasks.

    The columns row, shard and slot are added, so ``docs`` may not have them.
    """
    placed = with_shards(docs, order_by, shards, seed)
    dealt = placed.repartitionByRange(tasks, "shard", "slot") if tasks else placed.repartitionByRange("shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
