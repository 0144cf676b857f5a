"""Spelling variants: near words found through a reduced alphabet, and the usual form of each.

Letters are hashed to a few symbols, which makes words short strings over a small alphabet. All
strings within one edit of a reduced word are few, so they are written out and joined with the
reduced vocabulary. One edit of a word is at most one edit of its reduced word, so no near word is
missed; pairs that the join brings are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.components import forest_roots
from tablekeep.llm.words import slices, take
from tablekeep.session import materialize

SYMBOLS = 8
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on
RUN_LETTERS = 50_000  # letters whose neighbourhoods are made at once
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
CODES = np.array([zlib.crc32(bytes([c])) for c in LETTERS], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C55)
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z only


def runs_of(doc_id: int | None, text: str | None, drop_every: int | None) -> Counter:
    """Lower-cased letter runs of a text, each with its number; see ``spelling_variants`` for ``drop_every``."""
    runs = Counter(RUN.findall((text or "").encode().translate(LOWER).decode()))
    if not drop_every:
        return runs
    start, words = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        words[run if h % drop_every else run[:at] + run[at + 1 :]] += n
    return words


def word_counts(docs: DataFrame, min_chars: int, min_count: int, drop_every: int | None) -> DataFrame:
    """(word, n) of docs(doc_id, text), counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in runs_of(doc_id, text, drop_every).items():
                        if len(word) >= min_chars:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield out(held)
                        held = Counter()
        yield out(held)

    counted = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def flat(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of every head of every word, one after another: sizes[w] + 1 each, and where they start."""
    heads = np.zeros(len(values) + len(sizes), np.uint64)
    begin = np.arange(len(sizes)) + starts
    for k in range(int(sizes.max(initial=0))):  # all words' letters at place k
        on = sizes > k
        at = begin[on] + k
        heads[at + 1] = heads[at] * BASE + values[starts[on] + k]
    return heads, begin


def powers(most: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(most, BASE, np.uint64)))


def neighbourhoods(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every string within one edit of each word's reduced string, itself (first) included.

    A string's hash is a polynomial in its symbols, so each edit's hash follows from those of the
    head before it and the tail behind it: a word of L letters takes some 2 L symbols numbers.
    """
    raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    values = CODES[np.searchsorted(LETTERS, raw)] % np.uint64(symbols) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        heads, begin = flat(values, starts, sizes)
        power = powers(int(sizes.max(initial=0)) + 1)
        word = np.repeat(np.arange(len(words)), sizes + 1)
        head = np.arange(len(heads)) - begin[word]  # letters in the head
        total = heads[begin + sizes]
        rest = sizes[word] - head
        tail = total[word] - heads * power[rest]
        every = np.arange(1, symbols + 1, dtype=np.uint64)
        inner = rest > 0  # heads with a letter behind them
        shorter = tail[inner] - values * power[rest[inner] - 1]  # tail without its first letter
        parts = [
            (np.arange(len(words)), total),
            (word[inner], heads[inner] * power[rest[inner] - 1] + shorter),
            *((word[inner], heads[inner] * power[rest[inner]] + s * power[rest[inner] - 1] + shorter) for s in every),
            *((word, heads * power[rest + 1] + s * power[rest] + tail) for s in every),
        ]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)


def _word_runs(words: list[str]) -> Iterator[list[str]]:
    """Words in runs of bounded letters; a longer word is a run of its own."""
    run, letters = [], 0
    for word in words:
        if run and letters + len(word) > RUN_LETTERS:
            yield run
            run, letters = [], 0
        run.append(word)
        letters += len(word)
    if run:
        yield run


def reduced_words(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, code): the hash of each word's reduced string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            codes = [neighbourhoods(w, symbols)[1][: len(w)] for w in _word_runs(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def near_codes(samples: DataFrame, symbols: int) -> DataFrame:
    """(code, other), code <= other, for each word of samples(word, code) and every string near its reduced string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _word_runs(batch.column("word").to_pylist()):
                word, other = neighbourhoods(words, symbols)
                code = other[: len(words)][word]
                up = code <= other
                pairs = np.unique(np.stack([code[up], other[up]]), axis=1)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, pairs)), names=["code", "other"])

    return samples.select("word").mapInArrow(run, "code long, other long")


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that no size keeps from growing with the vocabulary: merged, never broadcast through the driver."""
    return df.hint("merge")


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(a, n_a, b, n_b) of words(word, n) that differ by one edit, each pair once.

    Neighbourhoods are made once per reduced word, not per word. Of two reduced words only the
    smaller one's neighbourhood is followed to the other. Reduced strings travel as 64-bit hashes; strings of
    different length with one hash bring pairs that the comparison refuses, those of one length could hide each other.
    """
    coded = materialize(reduced_words(words, symbols), "spelling-words")
    samples = coded.groupBy("code", F.length("word").alias("length")).agg(F.min("word").alias("word"))
    codes = materialize(samples, "spelling-codes")
    # A word makes some 17 rows a letter here, of which Spark knows nothing: it would size them as the words they come from.
    met = near_codes(codes, symbols).join(_merged(codes.select(F.col("code").alias("other")).distinct()), "other").distinct()
    left, right = coded.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "code"), coded.toDF("b", "n_b", "other")
    pairs = materialize(met, "spelling-codes-near").join(_merged(left), "code").join(_merged(right), "other")
    # Within one reduced word both orders would come up.
    once = (F.col("code") < F.col("other")) | (F.col("a") < F.col("b"))
    return pairs.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    drop_every: int | None = None,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least
    ``min_chars`` code points and ``min_count`` occurrences over all rows. Two words are near if one
    inserted, deleted or replaced code point makes one of the other; n_near counts them. A word's
    form is its near word with the largest n (ties: the smallest in code-point order) if that n is at
    least ``ratio`` (2 or more) times its own, else null; root follows forms to the last one. ``drop_every`` plants
    misspellings to test with: where it divides the crc32 of ``<doc_id>:<run>``, the run loses its
    code point at that crc32 modulo its length; a null id is written as nothing.

    Null and empty texts have no words. Repeated rows count again. Other columns are ignored; a table
    without words gives no rows. ``symbols`` changes the work, not the result.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more: forms must lead to ever more frequent words")
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    words = materialize(word_counts(docs, min_chars, min_count, drop_every), "spelling-counts")
    pairs = near_pairs(words, symbols)
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n_{b}").alias("n"), F.col(b).alias("near"))
    both = pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best"))
    usual = F.col("best")["minus"] <= -ratio * F.col("n")
    formed = materialize(
        words.join(_merged(best), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(usual, F.col("best")["near"]).alias("form"),
            F.when(usual, -F.col("best")["minus"]).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = forest_roots(formed.filter("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("root")), merged=True)
    found = formed.join(_merged(roots.withColumnRenamed("node", "word")), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
