"""Benchmark decontamination: which documents contain a test item, by containment of word shingles.

An index of prefixes, not a size-partitioned MinHash: an item of n shingles is sketched by its
k smallest shingle hashes (bottom-k), k depending on n; items of one run length share an index,
whatever their size, and documents get no sketch. A document that
holds a share t of the item misses all k of them with probability below (1 - t)^k, and never where
k exceeds (1 - t) n, which holds for every item up to SKETCH / (1 - t) shingles. Every shingle of
every document is looked up in the sketches; documents with a hit are then compared with the full
shingle sets. Items are the stated query set: they go to the workers in blocks of bounded size,
documents are never moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import run_hashes, slices, take, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 32  # most hashes of an item in the sketch
BLOCK_SHINGLES = 500_000  # shingles of the items sent to the workers at once


@dataclass
class Block:
    """Some items: their shingles by run length, and which of them are sketch entries."""

    ids: np.ndarray
    sizes: np.ndarray
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: values, starts, items of each value
    sketch: dict[int, np.ndarray]


def item_shingles(texts: list[str | None], length: int) -> list[tuple[int, np.ndarray]]:
    """(run length, distinct shingle hashes) per text; texts of fewer words are one run of all of them."""
    out = []
    for text in texts:
        words, per_text = word_hashes(pa.array([text], pa.string()), lower=True)
        n = min(length, len(words))
        out.append((n, np.unique(run_hashes(words, per_text, n)[0]) if n else np.zeros(0, np.uint64)))
    return out


def make_block(ids: list, sets: list[tuple[int, np.ndarray]], threshold: float) -> Block:
    sizes = np.array([len(s) for _, s in sets], np.int64)
    shingles, sketch = {}, {}
    for length in sorted({n for n, _ in sets if n}):
        own = [i for i, (n, _) in enumerate(sets) if n == length]
        values = np.concatenate([sets[i][1] for i in own])
        items = np.repeat(np.array(own), sizes[own])
        order = np.argsort(values, kind="stable")
        found, starts = np.unique(values[order], return_index=True)
        shingles[length] = (found, np.append(starts, len(values)), items[order])
        # Values are scrambled hashes, so the smallest ones of a set are its bottom-k sketch.
        sketch[length] = np.unique(np.concatenate([sets[i][1][: sketch_size(sizes[i], threshold)] for i in own]))
    return Block(np.array(ids, object), sizes, shingles, sketch)


def sketch_size(n: int, threshold: float) -> int:
    return min(int((1 - threshold) * n + 1e-9) + 1, SKETCH)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, length: int, threshold: float, most: int) -> Iterator[Block]:
    ids, sets, total = [], [], 0
    for row in take(benchmark, id_col, text_col).toLocalIterator():
        sets += item_shingles([row[1]], length)
        ids.append(row[0])
        total += len(sets[-1][1])
        if total >= most:
            yield make_block(ids, sets, threshold)
            ids, sets, total = [], [], 0
    if ids:
        yield make_block(ids, sets, threshold)


def _lookup(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def contained(texts: pa.Array, block: Block, threshold: float) -> list[tuple[int, int, int]]:
    """(text number, item number in the block, shared shingles) of all pairs that reach the threshold."""
    words, per_text = word_hashes(texts, lower=True)
    out = []
    for length, sketch in block.sketch.items():
        runs, counts = run_hashes(words, per_text, length)
        first = np.cumsum(counts) - counts
        hit = np.flatnonzero(_lookup(sketch, runs)[1]) if len(runs) else []
        values, starts, items = block.shingles[length]
        for d in np.unique(np.searchsorted(first + counts, hit, "right")):
            own = np.unique(runs[first[d] : first[d] + counts[d]])
            at, same = _lookup(values, own)
            at = at[same]
            named = np.concatenate([items[starts[i] : starts[i + 1]] for i in at])
            sketched = np.concatenate([items[starts[i] : starts[i + 1]] for i in at[_lookup(sketch, own[same])[1]]])
            shared = np.bincount(named)
            for i in np.unique(sketched):
                if shared[i] >= threshold * block.sizes[i] - 1e-9:
                    out.append((int(d), int(i), int(shared[i])))
    return out


def _search(block_of: Callable[[], Block], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of()
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                rows = contained(part.column("text"), block, threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, _, _ in rows], pa.int64()),
                        pa.array([block.ids[i] for _, i, _ in rows], pa.int64()),
                        pa.array([int(block.sizes[i]) for _, i, _ in rows], pa.int64()),
                        pa.array([n for _, _, n in rows], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_shingles", "n_shared"],
                )

    return run


def _clean(block_of: Callable[[], Block], threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of()
        for batch in batches:
            for part in slices(batch, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _, _ in contained(part.column(text_col), block, threshold)]] = False
                yield part.filter(pa.array(keep))

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) with n_shared / n_shingles >= threshold.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. An item's
    set holds its distinct shingles of ``length`` words (all its words as one, if it has fewer);
    n_shared of them occur in the document. Null or empty texts and items without words are in no
    pair. Every row is judged by itself: repeated rows give repeated pairs. Ids are bigint and may
    be null. Other columns are ignored; empty tables give no pairs.
    """
    spark = docs.sparkSession
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    out = spark.createDataFrame([], schema)
    for i, block in enumerate(item_blocks(benchmark, item_col, item_text_col, length, threshold, block_shingles)):
        sent = spark.sparkContext.broadcast(block)
        found = docs.mapInArrow(_search(lambda sent=sent: sent.value, threshold), schema)
        out = out.union(found) if i else found
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item; see ``contaminated``.

    The text column must be the only one of its name.
    """
    for block in item_blocks(benchmark, item_col, item_text_col, length, threshold, block_shingles):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_clean(lambda sent=sent: sent.value, threshold, text_col), docs.schema)
    return docs
