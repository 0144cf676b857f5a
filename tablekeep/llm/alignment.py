"""Tokens of two tokenizers aligned by the byte offsets where both end.

Texts are worked on in chunks of bounded bytes, as flat Arrow arrays: token lists are flattened with
the index of their document, token byte lengths are summed up within each document, and an Acero
hash join on (document, end) finds the ends that both tokenizers share. How often an id pair is
linked is counted per chunk (``Table.group_by``) and merged by Spark; each chunk then gets back the
counts of its own pairs, so no task ever holds the counts of the whole corpus, and a pair that is
in every text is one row per chunk. A chunk is stored as rows of its documents and of its pairs,
never as one row: Spark reads thousands of stored rows at once, whatever their size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.bpe import byte_symbols
from tablekeep.llm.words import ranges, slices, take
from tablekeep.session import materialize

CHUNK_BYTES = 1 << 20
PAIR_ROWS = 10_000  # pairs of a chunk sent at once
CACHE_UNITS = 100_000  # units whose pieces a worker knows; when full, it starts anew
# Fixed value: where byte-level BPE cuts a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIR_SHIFT = 32  # a pair is a_id << 32 | b_id

# A row of a document, with the places of its links among the chunk's pairs, or of a pair of the chunk.
CHUNKS = """chunk bigint, doc_id bigint, n_a bigint, n_b bigint, groups_sha256 string, at array<int>, place int, pair bigint, times bigint"""
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """One tokenizer: ``encode`` texts to a list array of ids; ``raw`` and ``written`` give an id's bytes and decimal text."""

    def __init__(self, tokens: list[bytes]):
        self.raw = pa.array(tokens, pa.binary())
        self.size = pc.binary_length(self.raw).cast(pa.int64())
        self.written = pa.array(range(len(tokens))).cast(pa.string())


class ByteSide(Side):
    """Byte-level BPE of a tokenizers JSON, on space and text; special tokens' strings are plain text.

    In such a vocabulary an id is the rank of its merge, so the merges run in tiktoken, which gives
    the same ids as the tokenizers library and keeps no offsets and token texts.
    """

    def __init__(self, data: str):
        from tiktoken import Encoding

        content = json.loads(data)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if all(c in byte for c in token)}
        for special in content["added_tokens"]:
            ranks.pop(special["content"].encode(), None)
        self.model = Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> pa.ListArray:
        ids = [self.model.encode_to_numpy(f" {t}", disallowed_special=()) for t in texts]
        return lists(pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)), np.fromiter(map(len, ids), np.int64, len(ids)))


class PieceSide(Side):
    """SentencePiece model, which puts the space before the text itself; byte pieces count as their byte.

    A piece with a space inside, not only in front, would join what lies on both sides of it; where the
    vocabulary has none, runs of spaces with the word behind them are encoded apart, each known one once.
    U+2581 in a text counts as a space in pieces but not in units; such a text's bytes differ anyway.
    """

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.unit = re.compile("(?s).+") if any(re.search("[^▁]▁", p) for p in names) else re.compile(" *[^ ]+| +")
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        # The empty text has no pieces, but a lone space at the end of a text is one.
        ids = [i or [self.model.piece_to_id("▁")] for i in self.model.encode([u[1:] for u in units], num_threads=1)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))

    def encode(self, texts: list[str]) -> pa.ListArray:
        units = [self.unit.findall(f" {t}") if t else [] for t in texts]
        every = list(chain.from_iterable(units))
        new = set(every) - self.known.keys()
        if new and len(self.known) + len(new) > CACHE_UNITS:
            self.forget()
            new = set(every)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        ends = np.append(0, np.cumsum(self.sizes[at]))[np.append(0, np.cumsum(np.fromiter(map(len, units), np.int64, len(units))))]
        return lists(pa.array(self.pool[ranges(self.starts[at], self.sizes[at])]), np.diff(ends))


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


@lru_cache(maxsize=2)
def _loaded(a: str, b: bytes) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


def ends(side: Side, ids: pa.ListArray) -> pa.Table:
    """Flat tokens: doc (parent index), end (byte offset in the document), place (in the flat array), id."""
    doc, flat = pc.list_parent_indices(ids).cast(pa.int32()), ids.flatten()
    total = pc.cumulative_sum(side.size.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets[:-1])  # sum up to the document's first token
    return pa.table({"doc": doc, "end": pc.subtract(total, before.take(doc)), "place": pa.array(np.arange(len(flat))), "id": flat})


def whole(side: Side, ids: pa.ListArray, expected: pa.Array) -> pa.Array:
    """Whether the bytes of a document's tokens, joined, are ``expected``."""
    raw = pa.ListArray.from_arrays(ids.offsets, side.raw.take(ids.flatten()))
    return pc.equal(pc.binary_join(raw, pa.scalar(b"", pa.binary())), expected)


def written_groups(side: Side, ids: pa.ListArray, last: np.ndarray) -> pa.Array:
    """Decimal ids joined by commas, one string per group; ``last`` is the place of each group's last token."""
    offsets = pa.array(np.append(0, last + 1).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, side.written.take(ids.flatten())), ",")


def align(a: ByteSide, b: PieceSide, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Counts and groups per text, and the linked id pairs of all texts one after another."""
    expected = pa.array([f" {t}".encode() for t in texts], pa.binary())
    own_a, own_b = a.encode(texts), b.encode(texts)
    good = pc.and_(pc.and_(whole(a, own_a, expected), whole(b, own_b, expected)), pa.array([bool(t) for t in texts], pa.bool_()))
    keep = good.to_numpy(zero_copy_only=False)
    none = pa.array([[]] * len(texts), pa.list_(pa.int32()))
    own_a, own_b = (pc.if_else(good, own, none) for own in (own_a, own_b))
    both = ends(a, own_a).join(ends(b, own_b), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("place")
    at_a, at_b = both["place"].to_numpy(), both["place_b"].to_numpy()
    sizes = np.bincount(both["doc"].to_numpy(), minlength=len(texts))
    # A document's last tokens end together, so its groups hold all its tokens.
    groups = pc.binary_join_element_wise(written_groups(a, own_a, at_a), written_groups(b, own_b, at_b), "|")
    joined = pc.binary_join(lists(groups, sizes), ";").to_pylist()
    return {
        "n_a": pc.list_value_length(own_a).to_numpy().astype(np.int64),
        "n_b": pc.list_value_length(own_b).to_numpy().astype(np.int64),
        "n_links": sizes.astype(np.int64),
        "groups": [g if k else None for g, k in zip(joined, keep)],
        "a": both["id"].to_numpy().astype(np.int64),
        "b": both["id_b"].to_numpy().astype(np.int64),
    }


def _rows(chunk: int, rows: int, columns: dict) -> pa.RecordBatch:
    """``rows`` rows of ``CHUNKS``; columns that are not given are null."""
    given = columns | {"chunk": np.full(rows, chunk)}
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = [c.split() for c in CHUNKS.split(", ")]
    arrays = [pa.nulls(rows, types[kind]) if name not in given else pa.array(given[name], types[kind]) for name, kind in schema]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in schema])


def _chunks(sent_a, sent_b, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(sent_a.value, sent_b.value)
        number = 0
        for batch in batches:
            for part in slices(batch, most=chunk_bytes):
                found = align(a, b, [t or "" for t in part.column("text").to_pylist()])
                links = pa.table({"pair": found["a"] << PAIR_SHIFT | found["b"]})
                counts = links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
                pairs = counts["pair"].to_numpy()
                sha = [hashlib.sha256(g.encode()).hexdigest() if g is not None else "" for g in found["groups"]]
                at = np.searchsorted(pairs, links["pair"].to_numpy()).astype(np.int32)
                number += 1
                chunk = TaskContext.get().partitionId() << 32 | number
                of_docs = {
                    "doc_id": part.column("doc_id"),
                    "n_a": found["n_a"],
                    "n_b": found["n_b"],
                    "groups_sha256": sha,
                    "at": lists(pa.array(at), found["n_links"]),
                }
                yield _rows(chunk, part.num_rows, of_docs)
                of_pairs = {"place": np.arange(len(pairs)), "pair": pairs, "times": counts["count_all"].to_numpy()}
                for i in range(0, len(pairs), PAIR_ROWS):
                    some = {c: v[i : i + PAIR_ROWS] for c, v in of_pairs.items()}
                    yield _rows(chunk, len(some["pair"]), some)
                del found, links, counts, of_docs, of_pairs
                pa.default_memory_pool().release_unused()  # a chunk's arrays, or the pool keeps them

    return run


def _finish(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a chunk with the counts of its pairs, brought back as (place, n, best), summed up per document."""
    n, best = np.zeros((2, found.num_rows), np.int64)
    place = found["place"].to_numpy()
    n[place] = found["n"].to_numpy()
    best[place] = found["best"].cast(pa.int64()).to_numpy()
    links = pc.list_value_length(docs["at"]).cast(pa.int64())
    at, cut = pc.list_flatten(docs["at"]).to_numpy(), np.append(0, np.cumsum(links.to_numpy()))
    summed = [pa.array(np.diff(np.append(0, np.cumsum(x[at]))[cut])) for x in (best, n)]
    columns = [docs["doc_id"], docs["n_a"], docs["n_b"], links, links, *summed, docs["groups_sha256"]]
    return pa.table(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def align_tokens(
    docs: DataFrame,
    byte_bpe: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``byte_bpe`` is the path of a byte-level tokenizers JSON (A, on space and text), ``piece_model``
    that of a SentencePiece model that adds the space itself (B). Where tokens of both end at the
    same byte they are linked, and the text is cut into a group. A pair's count is the number of
    links of that id pair in the whole table; n_best counts the links whose pair is the most frequent
    of its B id (ties included), count_sum sums counts over links. groups_sha256 is the SHA-256 of
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose joined tokens of A or B are not space and text, have no
    tokens: zeros and an empty string. Repeated rows count again, ids may be null, other columns are ignored,
    an empty table gives none. ``chunk_bytes`` changes the work, not the result; a longer text is a chunk of its own.
    """
    spark = docs.sparkSession
    with open(byte_bpe, encoding="utf-8") as f, open(piece_model, "rb") as g:
        sent_a, sent_b = spark.sparkContext.broadcast(f.read()), spark.sparkContext.broadcast(g.read())
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    chunks = materialize(docs.mapInArrow(_chunks(sent_a, sent_b, chunk_bytes), CHUNKS), "alignment-chunks")
    pairs = chunks.filter("pair IS NOT NULL").select(F.col("chunk").alias("home"), "place", "pair", "times")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("times").alias("n")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << PAIR_SHIFT) - 1)).alias("b")
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    judged = counts.withColumn("b", b_id).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    found = pairs.join(judged, "pair").select("home", "place", "n", "best")
    of_docs = chunks.filter("pair IS NULL").select("chunk", "doc_id", "n_a", "n_b", "groups_sha256", "at")
    return of_docs.groupBy("chunk").cogroup(found.groupBy("home")).applyInArrow(_finish, RESULT)
