"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. The weights are learned from preference
pairs (a good document over a bad one) by logistic loss on the difference of their features, on a
bounded sample; the score quantile at the share of bad documents, both taken over all labelled
documents, becomes the threshold, which the reported score maps to a fixed number. Features are computed where the texts lie; only they travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import SMALL_SLICE, bytes_of, run_hashes, slices, take, word_hashes
from tablekeep.session import materialize

MAX_LABELLED = 20_000  # labelled documents that the weights are fitted on, at most, of each label half
PAIRS = 60_000  # preference pairs
BINS = 4096  # of a histogram that an order statistic is looked up in
RIDGE = 1e-3
CUT = 0.3  # the reported score at the threshold
FEATURES = 15

_CLASS = np.zeros(256, np.uint8)  # 0 other (letters beyond ASCII), then:
SPACE, UPPER, LOWER, DIGIT, STOP, SYMBOL, BANG, BAR = range(1, 9)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = UPPER, LOWER, DIGIT
_CLASS[[ord(c) for c in "*#$%&@^~<>=+_\\{}[]/`"]] = SYMBOL
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = STOP
_CLASS[ord("!")], _CLASS[ord("|")] = BANG, BAR


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers in about [0, 1] per text; an empty text has all zero but the last."""
    data, offsets = bytes_of(texts)
    n_texts = len(offsets) - 1
    size = np.diff(offsets)
    words, per_text = word_hashes(texts, lower=True)
    doc = np.repeat(np.arange(n_texts), per_text)
    kind = _CLASS[data]
    of = np.repeat(np.arange(n_texts), size)
    by_kind = np.bincount(of * 9 + kind, minlength=9 * n_texts).reshape(n_texts, 9).astype(float)
    solid = np.maximum(size - by_kind[:, SPACE], 1)
    letters = np.maximum(by_kind[:, UPPER] + by_kind[:, LOWER], 1)
    n_words = np.maximum(per_text, 1)

    again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]) if len(words) else np.zeros(0, bool)
    repeats = np.bincount(doc[1:][again], minlength=n_texts)

    def distinct(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))[: len(h)]
        return np.bincount(o[fresh], minlength=n_texts)

    triples, n_triples = run_hashes(words, per_text, 3)
    repeated3 = 1 - distinct(triples, np.repeat(np.arange(n_texts), n_triples)) / np.maximum(n_triples, 1)
    inside = kind != SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & ~np.append(False, inside[:-1] & ~edge[1 : len(data)]))
    end = np.flatnonzero(inside & ~(np.append(inside[1:], False) & ~edge[1:])) + 1
    length = end - begin
    short = np.bincount(doc[length <= 3], minlength=n_texts)
    last_symbol = np.bincount(doc[kind[end - 1] >= SYMBOL], minlength=n_texts) if len(end) else np.zeros(n_texts)
    all_upper = np.bincount(doc[(kind[begin] == UPPER) & (kind[np.minimum(begin + 1, end - 1)] == UPPER) & (length > 1)], minlength=n_texts) if len(end) else np.zeros(n_texts)
    rare = np.minimum(1, 10 * (by_kind[:, SYMBOL] + by_kind[:, BANG] + by_kind[:, BAR]) / solid)
    out = np.stack(
        [
            by_kind[:, SYMBOL] / solid,
            by_kind[:, BANG] / solid,
            by_kind[:, BAR] / solid,
            rare,
            by_kind[:, UPPER] / letters,
            all_upper / n_words,
            by_kind[:, DIGIT] / solid,
            by_kind[:, STOP] / solid,
            repeats / n_words,
            np.minimum(1, 5 * repeats / n_words),
            repeated3 * (n_triples > 0),
            1 - distinct(words, doc) / n_words,
            short / n_words,
            last_symbol / n_words,
            np.log1p(per_text) / 10,
        ],
        axis=1,
    )
    out[per_text == 0] = 0
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SMALL_SLICE):
            rows = features(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass
class Model:
    weights: np.ndarray
    threshold: float

    def score(self, x: Column) -> Column:
        """0 to 1; CUT where the ranking score is at the threshold."""
        rank = ranking(self.weights, x) - self.threshold
        return 1 / (1 + F.exp(-(rank + float(np.log(CUT / (1 - CUT))))))


def ranking(weights: np.ndarray, x: Column) -> Column:
    """The ranking score, linear in the features."""
    terms = [F.lit(float(w)) * x[i] for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> np.ndarray:
    """Bradley-Terry weights by Newton steps on the logistic loss of good - bad feature differences.

    Every good row is paired with bad rows in turn until there are ``pairs`` pairs. Without rows of
    both kinds all weights are zero.
    """
    w = np.zeros(FEATURES)
    if not len(good) or not len(bad):
        return w
    n = min(pairs, len(good) * len(bad))
    i = np.arange(n)
    differences = good[i % len(good)] - bad[(i + i // len(good)) % len(bad)]
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = differences.T @ p / n - ridge * w
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def order_statistic(ranks: DataFrame, place: int, bins: int = BINS) -> float:
    """The value at ``place`` (from 0) of ranks(r) in ascending order, exactly.

    The bin that holds the place is divided again until all its values are equal; a pass brings at
    most ``bins`` rows to the driver.
    """
    low, high = ranks.agg(F.min("r"), F.max("r")).first()
    while low < high:
        # The ends fall into different bins, so each pass narrows the range.
        bin_of = F.least(F.floor((F.col("r") - low) / (high - low) * bins), F.lit(bins - 1))
        inside = ranks.filter(F.col("r").between(low, high)).groupBy(bin_of.alias("bin"))
        for found in inside.agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("bin").collect():
            if place < found["n"]:
                break
            place -= found["n"]
        low, high = found["low"], found["high"]
    return low


def quantile(ranks: DataFrame, share: float, n: int) -> float:
    """Quantile of the n rows of ranks(r), linear between neighbours."""
    place = share * (n - 1)
    below = order_statistic(ranks, int(place))
    return below if place == int(place) else below + (place - int(place)) * (order_statistic(ranks, int(place) + 1) - below)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(featured: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Model from featured(doc_id, x) and labels(doc_id, quality) outside the held-out fold.

    The weights are fitted on at most ``max_labelled`` rows of each label, in the order of a hash of
    the id; the share of bad rows and the quantile are of all rows. Without rows of both labels every
    text has the score of the threshold.
    """
    marked = labels.filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = materialize(featured.join(marked, "doc_id").select("quality", "x", F.xxhash64("doc_id").alias("h")), "labelled-features")
    sample = []
    for quality in (1, 0):
        some = rows.filter(F.col("quality") == quality).orderBy("h").limit(max_labelled).select("x").toPandas()["x"]
        sample.append(np.array(some.tolist()).reshape(-1, FEATURES))
    weights = fit(*sample)
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Model(weights, 0.0)
    n = sum(counts.values())
    ranks = materialize(rows.select(ranking(weights, F.col("x")).alias("r")), "labelled-ranks")
    return Model(weights, quantile(ranks, counts[0] / n, n))


def _good_only(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SMALL_SLICE):
                ranks = features(part.column(text_col)) @ model.weights
                yield part.filter(pa.array(ranks >= model.threshold))

    return run


def drop_bad(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ranking score reaches the threshold; see ``quality_scores``.

    Documents stay where they are: their features are computed once to learn and once to filter.
    The id and text columns must be the only ones of their names.
    """
    plain = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    known = take(labels, "doc_id", "quality").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = train(plain.mapInArrow(_featured, "doc_id long, x array<double>"), known, max_labelled)
    return docs.mapInArrow(_good_only(model, text_col), docs.schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    score is between 0 and 1, higher for texts that labels(doc_id, quality) would mark 1; predicted is
    1 where it is at least 0.3. Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from
    (held_out false); labels that are null or not 0 or 1 are ignored. Null and empty texts are scored
    like any other, a text without words by the model's constant. Ids are bigint; a null id is never
    labelled. Repeated rows are scored each; other columns are ignored; an empty table gives none.
    Without labels of both kinds every score is 0.3.
    """
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    featured = materialize(docs.mapInArrow(_featured, "doc_id long, x array<double>"), "quality-features")
    model = train(featured, take(labels, "doc_id", "quality").withColumn("doc_id", F.col("doc_id").cast("bigint")), max_labelled)
    scored = featured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
