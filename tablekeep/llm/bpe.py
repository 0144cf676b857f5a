"""BPE encoding and decoding by batched merge rounds in numpy.

The vocabulary file is a tokenizers JSON with byte-level symbols and a word-end suffix. Texts are
normalised and cut into words; the distinct words of a batch that are not known yet are put as
symbols into one flat array. In each round every word's adjacent pairs are looked up by binary
search in the sorted array of pair keys, and all places of a word's lowest-rank pair are merged,
until no word has a mergeable pair. Words that are done leave the array.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import ranges, slices, take

CACHE_WORDS = 300_000  # known words of a worker; when full, it starts anew
NONE = np.int64(1 << 60)
# White space as the normaliser's \s has it, in Unicode.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary: ``encode_words`` and ``encode`` on the text side, ``decode`` on the id side."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        model = data["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        keys = np.array([vocab[a] << 24 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.piece = regex.compile(pattern.replace(r"\s", WHITE), regex.V0)
        self.forget()

    def forget(self) -> None:
        """Empty cache: number of each known word, and the ids of all of them in one array."""
        self.known: dict[str, int] = {t: i for i, t in enumerate(self.special)}
        self.pool = np.array(list(self.special.values()), np.int32)
        self.starts, self.sizes = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64)

    def learn(self, words: list[str]) -> None:
        ids = self.encode_words(words)
        sizes = np.array([len(i) for i in ids], np.int64)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.concatenate([self.pool, *ids]).astype(np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words merged together in rounds."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(sizes)
        symbol[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        while len(symbol):
            key = symbol[:-1] << 24 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(good, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            over = best == NONE
            for w, s, n in zip(word[starts[over]], starts[over], sizes[over]):
                out[w] = symbol[s : s + n]
            here = (rank == np.repeat(best, sizes)) & (rank < NONE)
            # Of overlapping places (aaa), the first, third, ... of a run of places count.
            index = np.arange(len(here))
            run = here & ~np.append(False, here[:-1])
            origin = np.maximum.accumulate(np.where(run, index, 0))
            here &= (index - origin) % 2 == 0
            merged = np.flatnonzero(here)
            symbol = symbol.copy()
            symbol[merged] = self.made[at[merged]]
            stay = ~np.repeat(over, sizes)
            stay[merged + 1] = False
            symbol, word = symbol[stay], word[stay]
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens are found in the raw text and stand for themselves."""
        if not text.isascii():
            # Lower case letter by letter: no final sigma.
            whole = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:
            whole = text.lower()
        if not self.special or not any(t in text for t in self.special):
            return self.piece.findall(whole)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.piece.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        pieces = [self.pieces(t) for t in texts]
        counts = np.array([len(p) for p in pieces], np.int64)
        words = list(chain.from_iterable(pieces))
        new = set(words) - self.known.keys()
        if new and len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = set(words) - self.known.keys()
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return self.pool[ranges(self.starts[at], sizes)], np.diff(ends)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens of each list joined by one space, as a vocabulary without decoder is read."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")


@lru_cache(maxsize=2)
def _loaded(vocabulary: str) -> Bpe:
    return Bpe(vocabulary)


def _sent(spark, path: str):
    """The vocabulary file, read on the driver and broadcast: executors need not have it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int).

    ``vocabulary`` is the path of a tokenizers JSON. Null and empty texts have no ids. Special tokens
    written out in a text become their ids. Repeated rows are encoded each; other columns are
    ignored; an empty table gives none.
    """
    sent = _sent(docs.sparkSession, vocabulary)
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                ids, counts = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids with their text: tokens joined by one space, special tokens included.

    A null list is null, an empty one the empty text.
    """
    sent = _sent(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = pa.concat_arrays([part.column("ids")])  # offsets from 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, bpe.decode(ids)], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
