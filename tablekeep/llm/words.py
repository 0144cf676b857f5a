"""Words of whole texts as flat numpy arrays, and fingerprints of words and word runs.

A word is a maximal run of characters other than space and U+0009 to U+000D. Many texts are worked
on at once: one byte buffer, one array of word starts and ends, one array telling which words
belong to which text. Batches are cut into slices of bounded bytes, never through a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SMALL_SLICE = 1 << 20  # where each byte makes many numbers or a line many objects
LONG_WORD = 64  # bytes; longer words are hashed one by one

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only; bytes of other letters are above 127
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def take(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name and first position, whatever else the table holds.

    Extra columns whose names differ only in case, or repeat, do not make the choice ambiguous.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buffer of UTF-8 bytes, offsets) of a string array; null is empty."""
    raw = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if data is None or not len(raw):
        return np.zeros(0, np.uint8), np.zeros(len(raw) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` text bytes; a longer text is a run of its own."""
    _, offsets = bytes_of(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def word_hashes(texts: pa.Array, seed: int = 0, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text)."""
    data, offsets = bytes_of(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[edge] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((n + 1,), np.dtype("<u8"), padded, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
        for k in range(0, min(LONG_WORD, int(size.max(initial=0))), 8):
            left = size - k
            on = np.flatnonzero(left > 0) if k else slice(None)
            block = eights[starts[on] + k] & _MASKS[np.minimum(left[on], 8)]
            hashes[on] = mix(hashes[on] * np.uint64(0x9E3779B97F4A7C15) + block)
    for i in np.flatnonzero(size > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def run_hashes(words: np.ndarray, per_text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``length`` words inside one text, runs per text).

    Polynomial (Rabin-Karp) fingerprints modulo 2^64 of the word hashes. Runs of doubled length are
    composed from shorter ones, so it takes about 2 log2(length) passes over the array.
    """
    counts = np.maximum(per_text - length + 1, 0)
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), counts
    base = 0x9E3779B97F4A7C55
    power, power_len = words.copy(), 1  # power[i]: run of power_len words from i
    total, total_len = None, 0
    left = length
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if total is None:
                    total, total_len = power, power_len
                else:
                    m = len(words) - total_len - power_len + 1
                    total = total[:m] * np.uint64(pow(base, power_len, 2**64)) + power[total_len : total_len + m]
                    total_len += power_len
            left >>= 1
            if left:
                m = len(words) - 2 * power_len + 1
                power = power[:m] * np.uint64(pow(base, power_len, 2**64)) + power[power_len : power_len + m]
                power_len *= 2
        total = mix(total)
    first = np.cumsum(per_text) - per_text
    return total[ranges(first, counts)], counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + counts[i] - 1, one after another."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def pack(values: np.ndarray) -> bytes:
    """Integers with small differences in few bytes: differences by byte plane, deflated."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())
