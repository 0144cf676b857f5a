"""Lines that many documents share, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch is reduced to (line hash, number of documents), sorted. Hashes
already known as frequent are merge-anti-joined away; what is left becomes a new run on level 0.
When a level holds ``fanout`` runs they are merged into one run of the next level; hashes whose sum
reaches the limit move to the frequent run. The last compaction merges all levels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm.words import SMALL_SLICE, slices
from tablekeep.session import materialize

WHITE = b" \t\n\v\f\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_hash(line: bytes) -> tuple[int, int]:
    """128-bit hash of a line's key as two signed longs; (0, 0) for a key without characters."""
    key = line.strip(WHITE).translate(LOWER)
    if not key:
        return 0, 0
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SMALL_SLICE):
            seen: Counter = Counter()
            for group, text in zip(part.column("batch").to_pylist(), part.column("text").to_pylist()):
                seen.update({(group, *line_hash(x)) for x in (text or "").encode().split(b"\n")})
            rows = [(*k, n) for k, n in seen.items() if k[1:] != (0, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, [pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                names=["batch", "h1", "h2", "n"],
            )


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SMALL_SLICE):
            out: list[list] = [[], [], [], []]
            for doc, fp, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "fp", "text"))):
                for h in {line_hash(x) for x in (text or "").encode().split(b"\n")} - {(0, 0)}:
                    for column, value in zip(out, (doc, fp, *h)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "fp", "h1", "h2"])


def kept_lines(text: str | None, gone: list[dict] | None) -> tuple[bytes, int, int]:
    """(text without the lines whose hash is in ``gone``, lines, dropped lines)."""
    lines = (text or "").encode().split(b"\n")
    drop = {(g["h1"], g["h2"]) for g in gone or ()}
    kept = [x for x in lines if line_hash(x) not in drop] if drop else lines
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _dropper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SMALL_SLICE):
            kept = [kept_lines(t, g) for t, g in zip(part.column("text").to_pylist(), part.column("gone").to_pylist())]
            columns = [pa.array([k[0].decode() for k in kept], pa.string()), *(pa.array([k[i] for k in kept], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", "text", "n_lines", "n_dropped"])


class LineRuns:
    """Levelled sorted runs of (h1, h2, n) in the shared folder; keys with ``min_docs`` or more are frequent."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.known: list[DataFrame] = []

    def _run(self, counts: DataFrame, label: str) -> DataFrame:
        return materialize(counts.sortWithinPartitions("h1", "h2"), label)

    def frequent(self) -> DataFrame | None:
        """Keys known as frequent so far; each of them once."""
        out = None
        for run in self.known:
            out = run if out is None else out.union(run)
        return out

    def add(self, counts: DataFrame) -> None:
        """One batch: (h1, h2, n) with every key once."""
        known = self.frequent()
        if known is not None:
            counts = counts.hint("merge").join(known, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._run(counts, "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level, level)
            level += 1

    def _compact(self, first: int, last: int) -> None:
        runs = [r for level in self.levels[first : last + 1] for r in level]
        merged = runs[0]
        for r in runs[1:]:
            merged = merged.union(r)
        total = self._run(merged.groupBy("h1", "h2").agg(F.sum("n").alias("n")), "line-compaction")
        self.known.append(self._run(total.filter(F.col("n") >= self.min_docs).select("h1", "h2"), "line-frequent"))
        for level in range(first, last + 1):
            self.levels[level] = []
        if last + 1 == len(self.levels):
            self.levels.append([])
        self.levels[last + 1].append(total.filter(F.col("n") < self.min_docs))

    def finish(self) -> DataFrame:
        """All levels merged; the frequent keys of everything added."""
        if any(self.levels):
            self._compact(0, len(self.levels) - 1)
        return self.frequent()


def frequent_lines(docs: DataFrame, min_docs: int, batches: int, fanout: int = 2) -> DataFrame:
    """(h1, h2) of keys in at least ``min_docs`` rows of docs(doc_id, text), by levelled runs."""
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    each = docs.select(group, "text").mapInArrow(_counts, "batch int, h1 long, h2 long, n long")
    arrivals = materialize(each.groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n")), "line-arrivals")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        runs.add(arrivals.filter(F.col("batch") == b).select("h1", "h2", "n"))
    return runs.finish()


def _without(docs: DataFrame, row: Column, id_col: str, text_col: str, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(row, text that stays, n_lines, n_dropped) for every row of ``docs``."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = plain.select(row.alias("row"), doc_id.cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    known = frequent_lines(keyed.select("doc_id", "text"), min_docs, batches, fanout)
    keys = keyed.select("doc_id", "fp", "text").mapInArrow(_line_keys, "doc_id long, fp long, h1 long, h2 long")
    hits = materialize(keys.join(known, ["h1", "h2"], "left_semi"), "line-hits")
    gone = hits.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["fp"] == gone["fp"])
    joined = keyed.join(gone.hint("shuffle_hash"), same, "left").select("row", "text", "gone")
    schema = joined.select("row", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return joined.mapInArrow(_dropper, schema)


def drop_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """One row per input row: doc_id, text (lines that stay, joined by \\n), n_lines, n_dropped.

    Texts are split at \\n; a null or empty text is one empty line. A line's key is the line without
    white space (space, U+0009 to U+000D) at its ends and with A-Z lower-cased. Keys of at least one
    character found in at least ``min_docs`` rows lose all their lines everywhere; a repeated row
    counts as another document. Ids are bigint and may be null. Other columns are ignored; an empty
    table gives none. ``batches`` says how many batches arrive one after another; the result is the
    same for any number.
    """
    row = F.col(f"c{docs.columns.index(id_col)}").cast("bigint")
    return _without(docs, row, id_col, text_col, min_docs, batches, fanout).withColumnRenamed("row", "doc_id")


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """The rows of ``docs``, with all their columns, and the text without frequent lines; see ``drop_frequent_lines``."""
    at, names = docs.columns.index(text_col), docs.columns
    row = F.struct(*[F.col(f"c{i}") for i in range(len(names)) if i != at] or [F.lit(0).alias("c")])
    kept = _without(docs, row, id_col, text_col, min_docs, batches, fanout)
    return kept.select(*[(F.col("text") if i == at else F.col(f"row.c{i}")).alias(n) for i, n in enumerate(names)])
