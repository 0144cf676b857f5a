"""Licence notices in text, in DataFrame operations only.

Lines, and runs of lines up to a blank one, are classified by logistic regression over their sparse
word n-grams into licence families and an unknown class. The model is trained on labelled notices of
each family and on ordinary passages of the corpus that are scored like any other; the unknown class
is calibrated on a part of them that was not fitted. A prediction counts only if a template of the
family confirms it by shared n-grams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import take
from tablekeep.session import materialize

# Labelled notices by family.
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "agpl 3.0 license", "distributed under the agpl", "gnu affero general public license"],
    "apache": ["licensed under the apache license version 2.0", "released under the apache 2.0 license", "you may not use this file except in compliance with the license", "licensed under apache 2.0", "apache 2.0 license", "apache license version 2.0", "distributed under the apache license"],
    "bsd": ["licensed under the bsd 3 clause license", "released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "bsd license", "bsd 3 clause license", "bsd 2 clause license", "distributed under the bsd license"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "cc by 4.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license", "cc by sa 4.0"],
    "cc0": ["released under cc0 1.0", "dedicated to the public domain under the cc0 1.0 license", "cc0 1.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "released under the gpl license", "this program is free software you can redistribute it under the terms of the gnu general public license", "distributed under the gpl", "licensed under the gpl", "gnu general public license", "this program is distributed in the hope that it will be useful"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "released under the lgpl license", "distributed under the lgpl", "gnu lesser general public license", "this library is distributed in the hope that it will be useful", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license", "distributed under the mit license"],
    "mpl": ["licensed under the mozilla public license version 2.0", "released under the mpl 2.0 license", "mozilla public license 2.0", "distributed under the mpl", "this source code form is subject to the terms of the mozilla public license"],
    "reserved": ["all rights reserved", "copyright all rights reserved"],
}
FAMILIES = ["unknown", *sorted(NOTICES)]
MAX_ORDINARY = 2000  # ordinary passages that the model is fitted and calibrated on, at most
FALSE_RATE = 0.001  # share of ordinary passages that calibration lets pass as licences
CONFIRM = 0.6  # share of a template's n-grams that a passage must have
SHORT = 8  # n-grams up to which a template must be there in full and be this share of the passage:
SHARE = 1 / 3
WRAPPED = 4  # lines that are joined to a passage, at most, besides all lines up to a blank one
BLANK = r"\n(?=[\x20\t\r\f]*\n)"


def ngrams(text: Column) -> Column:
    """Distinct words and word pairs, lower-cased; other than letters, digits and inner dots separate."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))
    pairs = F.transform(F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b")), 1, 1 << 30), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: F.contains(p, F.lit(" ")))))


def fit(rows: list[tuple[list[str], int]], held: list[list[str]], steps: int = 300, ridge: float = 1e-3) -> tuple[dict[str, list[float]], list[float]]:
    """(weights per n-gram, bias) of multinomial logistic regression on (n-grams, class); classes weigh the same.

    held are ordinary passages for calibration.
    """
    vocabulary = sorted({g for grams, c in rows if c for g in grams})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    y = np.zeros((len(rows), len(FAMILIES)))
    for r, (grams, c) in enumerate(rows):
        x[r, [place[g] for g in grams if g in place]] = 1
        y[r, c] = 1
    weight = (y / np.maximum(y.sum(0), 1)).sum(1, keepdims=True) / len(FAMILIES)
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = weight * (y - p / p.sum(1, keepdims=True))
        w += 2.0 * (x.T @ d - ridge * w)
        b += 2.0 * d.sum(0)
    margin = lambda grams: _margin(grams, place, w, b)
    if held:  # calibration: the unknown class gets what keeps ordinary passages below it, but labelled notices above it
        needed = float(np.quantile([margin(g) for g in held], 1 - FALSE_RATE))
        b[0] += max(0.0, min(needed, min(margin(g) for g, c in rows if c) / 2))
    return {g: w[i].round(6).tolist() for g, i in place.items()}, b.round(6).tolist()


def _margin(grams: list[str], place: dict[str, int], w: np.ndarray, b: np.ndarray) -> float:
    """By how much the best family beats the unknown class."""
    z = w[[place[g] for g in grams if g in place]].sum(0) + b
    return float(z[1:].max() - z[0])


def needed(template: list[str]) -> int:
    """n-grams of the template that a passage must have."""
    return len(template) if len(template) <= SHORT else math.ceil(CONFIRM * len(template))


def gate(templates: list[list[str]]) -> str:
    """A pattern, for lower-cased text, that every passage which some template confirms matches.

    Of each template it has words without all of which too few of the n-grams are left.
    """
    chosen: set[str] = set()
    for t in templates:
        left = list(t)
        for word in sorted((g for g in t if " " not in g), key=lambda g: (g not in chosen, -len(g), g)):
            if len(left) < needed(t):
                break
            chosen.add(word)
            left = [g for g in left if word not in g.split(" ")]
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(c) for c in sorted(chosen)) + r")(?![a-z0-9])"


def confirmed(grams: Column, templates: Column) -> Column:
    """Whether one of the templates (g, need) is in the passage to the share that counts."""
    shared = lambda t: F.size(F.array_intersect(t["g"], grams))
    return F.exists(templates, lambda t: (shared(t) >= t["need"]) & ((F.size(t["g"]) > SHORT) | (F.size(t["g"]) >= SHARE * F.size(grams))))


def template_array(templates: list[list[str]]) -> Column:
    kind = "array<struct<g:array<string>,need:int>>"
    return F.array(*[F.struct(F.array(*[F.lit(g) for g in t]).alias("g"), F.lit(needed(t)).alias("need")) for t in templates]).cast(kind)


def passages(block: Column, pattern: str) -> Column:
    """Array of (line, lines, text) of a block without inner blank lines that match the pattern: single
    lines, runs of up to WRAPPED lines, and the whole block."""

    def of(lines: Column) -> Column:
        n = F.size(lines)
        one = lambda i, w: F.struct(i.alias("line"), w.alias("lines"), F.array_join(F.slice(lines, i + 1, w), " ").alias("text"))
        runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WRAPPED), n - i)), lambda w: one(i, w))
        every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), runs))
        whole = F.when(n > WRAPPED, F.array(one(F.lit(0), n))).otherwise(F.array().cast("array<struct<line:int,lines:int,text:string>>"))
        return F.filter(F.concat(every, whole), lambda x: F.lower(x["text"]).rlike(pattern))

    return _let(F.split(block, "\n"), of)


def train(docs: DataFrame, max_ordinary: int = MAX_ORDINARY) -> tuple[dict[str, list[float]], list[float], dict[str, list[list[str]]]]:
    """Model and templates. Ordinary are passages that no template confirms, of blocks drawn by hash; the
    distinct ones of smallest hash, every second of them held back for calibration.

    The number of distinct blocks that have a gate word sets the share that is drawn, about twice
    ``max_ordinary`` blocks, so only these are cut into passages; of the passages as many are drawn, so n-grams and
    templates are worked out for these alone, and no task brings more of them with the table's size.
    """
    spark = docs.sparkSession
    notices = [(t, FAMILIES.index(f)) for f, texts in NOTICES.items() for t in texts]
    marked = spark.createDataFrame(notices, "text string, c int").select(ngrams(F.col("text")).alias("g"), "c").collect()
    templates: dict[str, list[list[str]]] = {}
    for r in marked:
        templates.setdefault(FAMILIES[r.c], []).append(r.g)
    pattern = gate([r.g for r in marked])
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.lower("text").rlike(pattern))
    blocks = texts.select(F.explode(F.split("text", BLANK)).alias("block")).filter(F.lower("block").rlike(pattern))
    n_blocks = max(blocks.select(F.xxhash64("block")).distinct().count(), 1)
    share = min(1.0, 2 * max_ordinary / n_blocks)
    blocks = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    texts = materialize(blocks.select(F.explode(passages(F.col("block"), pattern)).alias("p")).select("p.text").distinct(), "passages")
    share = min(1.0, 2 * max_ordinary / max(texts.count(), 1))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    scored = some.select("text", ngrams(F.col("text")).alias("g"))
    ordinary = scored.filter(~confirmed(F.col("g"), template_array([r.g for r in marked])))
    some = [r.g for r in ordinary.orderBy(F.xxhash64("text"), "text").limit(max_ordinary).select("g").collect()]
    rows = [(r.g, r.c) for r in marked] + [(g, 0) for g in some[::2]]
    return *fit(rows, some[1::2]), templates


def licence_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, n_notices, families, notices.

    notices lists (paragraph number from 0, family) in order, families the distinct families, sorted
    and comma-joined. Paragraphs are the lines of the whole text; a notice wrapped over several lines
    without a blank one between has the number of the first, and counts where no shorter run of the same
    lines is a notice itself.
    Null and empty texts have one empty paragraph and no notice; repeated rows are scanned each; other
    columns are ignored; an empty table gives none. Ids are passed on as they are.
    """
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    weights, bias, templates = train(docs)
    vocabulary = F.array(*[F.lit(g) for g in weights])
    table = F.array(*[_numbers(w) for w in weights.values()])
    known = F.array(*[template_array(templates.get(f, [])) for f in FAMILIES])
    pattern = gate([t for f in templates.values() for t in f])
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def scores(grams: Column) -> Column:
        places = F.transform(F.array_intersect(grams, vocabulary), lambda g: F.array_position(vocabulary, g))
        return F.aggregate(places, _numbers(bias), lambda s, p: F.zip_with(s, F.element_at(table, p.cast("int")), lambda x, y: x + y))

    def judge(grams: Column, best: Column) -> Column:
        return F.when((best > 1) & confirmed(grams, F.element_at(known, best)), F.element_at(names, best)).otherwise("unknown")

    def classify(line: Column) -> Column:
        first = lambda s: F.array_position(s, F.array_max(s)).cast("int")
        return _let(ngrams(line), lambda g: _let(scores(g), lambda s: _let(first(s), lambda best: judge(g, best))))

    def found(block: Column) -> Column:
        judged = F.transform(passages(block, pattern), lambda p: F.struct(p["lines"].alias("lines"), p["line"].alias("line"), classify(p["text"]).alias("family")))
        none = F.array().cast("array<struct<lines:int,line:int,family:string>>")
        return F.aggregate(F.array_sort(F.filter(judged, lambda p: p["family"] != "unknown")), none, _apart)

    def numbered(blocks: Column) -> Column:
        n_lines = lambda i: F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0), lambda n, x: n + F.size(F.split(x, "\n")))
        gated = F.filter(F.transform(blocks, lambda x, i: F.struct(i.alias("i"), x.alias("block"))), lambda x: F.lower(x["block"]).rlike(pattern))
        judged = F.filter(F.transform(gated, lambda x: F.struct(x["i"].alias("i"), found(x["block"]).alias("found"))), lambda x: F.size(x["found"]) > 0)
        place = lambda x: _let(n_lines(x["i"]), lambda n: F.transform(x["found"], lambda p: F.struct((n + p["line"]).alias("paragraph"), p["family"].alias("family"))))
        return F.array_sort(F.flatten(F.transform(judged, place)))

    scanned = docs.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_paragraphs"),
        F.when(F.lower("text").rlike(pattern), _let(F.split("text", BLANK), numbered))
        .otherwise(F.array().cast("array<struct<paragraph:int,family:string>>"))
        .alias("notices"),
    )
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda p: p["family"]))), ",")
    return scanned.select("doc_id", "n_paragraphs", F.size("notices").cast("bigint").alias("n_notices"), families.alias("families"), "notices")


def _apart(kept: Column, p: Column) -> Column:
    """``kept`` and the run of lines p, if they do not meet."""
    meets = F.exists(kept, lambda q: (q["line"] < p["line"] + p["lines"]) & (p["line"] < q["line"] + q["lines"]))
    return F.when(meets, kept).otherwise(F.concat(kept, F.array(p)))


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]
