"""Removal of word windows that occur before, over whole corpora.

Every window of a fixed number of words gets a Rabin-Karp fingerprint. Fingerprints are grouped in
Spark, but travel packed: a worker reads documents until it has a chunk of windows, keeps the
earliest place of each fingerprint in the chunk (so a passage shared by a third of all documents
travels once a chunk), and sends each hash bucket one row of packed fingerprints and places. The
buckets tell every chunk which of its fingerprints start earlier elsewhere. A chunk then merges the
repeated windows into maximal removal intervals, one row a document, and the documents drop them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import mix, pack, ranges, run_hashes, slices, take, unpack, word_hashes

WINDOW = 20
CHUNK_WINDOWS = 1 << 20
BUCKET_BYTES = 48 << 20  # text bytes whose windows a bucket gets on average
NULL_ID = np.iinfo(np.int64).min  # null ids come first

# A row goes to a bucket and belongs to a chunk. TABLE: ids, text fingerprints and windows per document
# of the chunk, and which windows repeat inside it. BLOCK: places and fingerprints for the bucket, or
# as an answer only the places that start earlier elsewhere.
TABLE, BLOCK = 0, 1
ROW = [("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())] + [(n, pa.binary()) for n in ("docs", "sizes", "at", "prints")]
ROW_DDL = "bucket int, chunk long, kind int, docs binary, sizes binary, at binary, prints binary"
LEAST_BUCKETS = 256  # from here on the bucket stands for the first byte of a fingerprint


def _ordered(ids: np.ndarray, fps: np.ndarray, sizes: np.ndarray, prints: np.ndarray, extra: np.ndarray):
    """A chunk with its documents in order of id, and windows accordingly."""
    order = np.lexsort((fps, ids))
    starts = np.cumsum(sizes) - sizes
    move = ranges(starts[order], sizes[order])
    return ids[order], fps[order], sizes[order], prints[move], extra[move]


def _groups(prints: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal fingerprints together, group number of each in that order)."""
    order = np.argsort(prints, kind="stable")
    p, e = prints[order], extra[order]
    same = p[1:] == p[:-1]
    if (same & (e[1:] != e[:-1])).any():  # 64 bits agree, the rest does not
        order = np.lexsort((extra, prints))
        p, e = prints[order], extra[order]
    fresh = np.append(True, (p[1:] != p[:-1]) | (e[1:] != e[:-1]))[: len(p)]
    return order, np.cumsum(fresh) - 1


def _later(group: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True where a window has another of its group at a smaller id, or same id and earlier start."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(ids, first)[group]
    at_least = np.where(ids == least, pos, np.iinfo(np.int64).max)
    return (ids > least) | (pos > np.minimum.reduceat(at_least, first)[group])


def _high_bytes(buckets: int) -> int:
    """Bytes of a fingerprint's upper half that the bucket leaves open."""
    return 4 - (buckets.bit_length() - 1) // 8 if buckets < 1 << 32 else 0


def _pack_prints(prints: np.ndarray, extra: np.ndarray, bucket: int, buckets: int) -> bytes:
    low = (prints & np.uint64(0xFFFFFFFF)).astype("<u4")
    rest = ((prints >> np.uint64(32)) - np.uint64(-(-(bucket << 32) // buckets))).astype("<u4")
    high = rest.view(np.uint8).reshape(-1, 4)[:, : _high_bytes(buckets)]
    return high.tobytes() + low.tobytes() + extra.astype("<u2").tobytes()


def _unpack_prints(packed: bytes, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one bucket: equal where the whole ones are."""
    k = _high_bytes(buckets)
    high = np.zeros((n, 4), np.uint8)
    high[:, :k] = np.frombuffer(packed, np.uint8, n * k).reshape(n, k)
    low = np.frombuffer(packed, "<u4", n, n * k).astype(np.uint64)
    return high.view("<u4").ravel().astype(np.uint64) << np.uint64(32) | low, np.frombuffer(packed, "<u2", n, n * (k + 4))


def _chunk_rows(chunk: int, parts: list[tuple], buckets: int) -> Iterator[tuple]:
    ids, fps, sizes, prints, extra = _ordered(*(np.concatenate(x) for x in zip(*parts)))
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(ids)), sizes)
    own = np.zeros(len(doc), bool)
    if len(doc):
        order, group = _groups(prints, extra)
        own[order] = _later(group, ids[doc[order]], (np.arange(len(doc)) - starts[doc])[order])
    home = int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets))
    table = np.concatenate([ids, fps.view(np.int64)]).tobytes()
    yield home, chunk, TABLE, table, pack(sizes), pack(np.flatnonzero(own)), None
    ask = np.flatnonzero(~own)  # repeated rows tie for the earliest place, then both ask
    bucket = ((prints[ask] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    ask, bucket = ask[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        at = ask[edges[b] : edges[b + 1]]
        used = np.unique(doc[at])
        yield int(b), chunk, BLOCK, pack(ids[used]), pack(starts[used]), pack(at), _pack_prints(prints[at], extra[at], int(b), buckets)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(ROW), ROW)], names=[n for n, _ in ROW])


def _windows(window: int, chunk_windows: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held = TaskContext.get().partitionId() << 32, [], 0

        def send() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in _chunk_rows(chunk, parts, buckets):
                rows.append(row)
                size += len(row[3]) + len(row[6] or b"")
                if size > 4 << 20:
                    yield from _table(rows).to_batches()
                    rows, size = [], 0
            yield from _table(rows).to_batches()

        for batch in batches:
            for part in slices(batch):
                words, per_text = word_hashes(part.column("text"))
                prints, sizes = run_hashes(words, per_text, window)
                extra = run_hashes(mix(words ^ np.uint64(window)), per_text, window)[0] >> np.uint64(48)
                some = sizes > 0  # texts shorter than a window take no part
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[some]
                fps = part.column("fp").to_numpy(zero_copy_only=False)[some]
                parts.append((ids, fps, sizes[some], prints, extra.astype(np.uint16)))
                held += len(prints)
                if held >= chunk_windows:
                    yield from send()
                    chunk, parts, held = chunk + 1, [], 0
        if held:
            yield from send()

    return run


def _answers(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """For one bucket: the places of each chunk whose fingerprint starts earlier elsewhere."""
        tables = rows.filter(pc.equal(rows["kind"], TABLE)).cast(pa.schema(ROW))
        blocks = rows.filter(pc.equal(rows["kind"], BLOCK)).to_pylist()
        if not blocks:
            return tables
        ids, pos, at, prints, edges = [], [], [], [], [0]
        for b in blocks:
            places, starts = unpack(b["at"]), unpack(b["sizes"])
            doc = np.searchsorted(starts, places, "right") - 1
            ids.append(unpack(b["docs"])[doc])
            pos.append(places - starts[doc])
            at.append(places)
            prints.append(_unpack_prints(b["prints"], len(places), buckets))
            edges.append(edges[-1] + len(places))
        order, group = _groups(*(np.concatenate(x) for x in zip(*prints)))
        later = np.zeros(len(order), bool)
        later[order] = _later(group, np.concatenate(ids)[order], np.concatenate(pos)[order])
        out = []
        for b, places, start, stop in zip(blocks, at, edges, edges[1:]):
            if later[start:stop].any():
                out.append((b["bucket"], b["chunk"], BLOCK, None, None, pack(places[later[start:stop]]), None))
        return pa.concat_tables([tables, _table(out)])

    return run


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) runs of words covered by windows at the sorted starts."""
    cut = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    return starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + window


def _merge(window: int):
    def run(rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        rows = rows.to_pylist()
        table = next(r for r in rows if r["kind"] == TABLE)
        ids, fps = np.frombuffer(table["docs"], np.int64).reshape(2, -1)
        sizes = unpack(table["sizes"])
        starts = np.cumsum(sizes) - sizes
        repeated = np.sort(np.concatenate([unpack(r["at"]) for r in rows]))
        doc = np.searchsorted(starts, repeated, "right") - 1
        edges = np.searchsorted(doc, np.arange(len(ids) + 1))
        for d in np.flatnonzero(np.diff(edges)):
            begin, end = intervals(repeated[edges[d] : edges[d + 1]] - starts[d], window)
            for column, value in zip(out, (ids[d], fps[d], begin, end)):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["id", "fp", "begins", "ends"])

    return run


def removals(docs: DataFrame, window: int, chunk_windows: int, bucket_bytes: int) -> DataFrame:
    """(id, fp, begins, ends) for the docs(doc_id, fp, text) that lose words."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 4 * partitions, -(-total // bucket_bytes))
    rows = docs.mapInArrow(_windows(window, chunk_windows, buckets), ROW_DDL)
    answers = rows.groupBy("bucket").applyInArrow(_answers(buckets), ROW_DDL)
    merged = answers.groupBy("chunk").applyInArrow(_merge(window), "id long, fp long, begins array<int>, ends array<int>")
    return merged.dropDuplicates(["id", "fp"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out: list[list] = [[], [], [], []]
            for doc, text, begins, ends in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "begins", "ends"))):
                words = (text or "").encode().split()
                kept, at = [], 0
                for begin, end in zip(begins or (), ends or ()):
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                for column, value in zip(out, (doc, b" ".join(kept).decode(), len(words), len(words) - len(kept))):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [*(pa.array(c, t) for c, t in zip(out, types)), part.column("begins"), part.column("ends")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "n_removed", "begins", "ends"])


def drop_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    chunk_windows: int = CHUNK_WINDOWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, text (kept words joined by one space), n_words, n_removed, begins, ends.

    Words are runs of characters other than space and U+0009 to U+000D; a null or empty text has
    none. A word goes if it is covered by a window of ``window`` words whose word sequence also
    starts earlier: at a smaller doc_id, or at an earlier start under the same doc_id. All windows
    are judged on the input. begins and ends are the maximal removal intervals in words (end
    exclusive), null where nothing goes. Ids are bigint; null comes first. Rows with the same id are
    one place in the order, so repeated rows never remove each other's windows at the same start.
    Other columns are ignored; an empty table gives none. Windows are told apart by 80 bits.

    The input must be read the same way again if a task is repeated (a table, not rows in random order).
    """
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    keyed = docs.withColumn("fp", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    gone = removals(keyed.select(F.col("id").alias("doc_id"), "fp", "text"), window, chunk_windows, bucket_bytes)
    joined = keyed.join(gone.hint("shuffle_hash"), ["id", "fp"], "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(_keep, "doc_id long, text string, n_words long, n_removed long, begins array<int>, ends array<int>")
