"""Secrets in text, in DataFrame operations only.

Three fixed patterns give the base spans. Two character Markov models, one of random strings and
one of ordinary identifiers, add tokens whose log-likelihood ratio speaks for a random string.
The models are trained from labelled samples: random are the values of the base matches found in
the corpus and generated strings over usual alphabets; ordinary are all distinct tokens of the corpus,
over the same alphabet, outside base matches, in the forms that identifiers are written in, and
generated numbers, times, UUIDs and rows of one character.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm.words import take

# The base patterns, in the order in which kinds are listed, with the shortest length
# of the value (group) that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more: a greedy run is matched whole either way
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
TOKEN = r"[A-Za-z0-9+/_-]{6,}={0,2}"  # what the ordinary model learns from
DIGITS, HEX_DIGITS = "0123456789", "0123456789abcdef"
GENERATED = 3000  # generated strings per alphabet or form
GENERATED_ALPHABETS = (HEX_DIGITS, ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_")
SMOOTHING = 0.02  # share of every row of a model that is spread over all characters
MIN_RATIO = 12.0  # natural log; random must be about 160,000 times as likely as ordinary

SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """Array of (start, end, value) of the matches whose value passes, left to right; code points, end exclusive.

    The pieces between the matches and the matches themselves give the places: a running sum of
    their lengths. Work grows with the text and the square of the (few) matches that pass in one text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(whole.alias("m"), F.split(text, pattern, -1).alias("gap"), value.alias("v"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["v"]), F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def spans(found: Column, kind: str) -> Column:
    """The matches as spans of the kind."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def base_matches(text: Column) -> dict[str, Column]:
    """The matches of each base kind whose value is long enough."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    long = lambda kind: lambda value: F.length(value) >= LEAST[kind]
    return {
        "assign": F.when(text.rlike(ASSIGN), matches(text, ASSIGN, 2, long("assign"))).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 0, long("access"))).otherwise(none),
        "hex": F.when(text.rlike(HEX), matches(text, HEX, 0, long("hex"))).otherwise(none),
    }


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    by_kind = [spans(found, kind) for kind, found in base_matches(text).items()]
    return F.array_sort(F.concat(*by_kind))


def joined(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def random_string(alphabet: str, length: int = 32) -> Column:
    """Pseudo-random characters from the hash of the row's id and the place."""
    place = lambda i: F.pmod(F.xxhash64(F.lit(alphabet), F.col("id"), i), F.lit(len(alphabet))) + 1
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit(alphabet), place(i).cast("int"), 1))
    return F.array_join(letters, "")


def generated(spark: SparkSession, per_alphabet: int) -> DataFrame:
    """Labelled random strings (text) over the usual alphabets."""
    numbers = spark.range(per_alphabet, numPartitions=4)
    out = numbers.select(random_string(GENERATED_ALPHABETS[0]).alias("text"))
    for alphabet in GENERATED_ALPHABETS[1:]:
        out = out.union(numbers.select(random_string(alphabet).alias("text")))
    return out


def generated_ordinary(spark: SparkSession, per_form: int) -> DataFrame:
    """Labelled ordinary strings (text) that a corpus may hold too few of: numbers, times, UUIDs, rows of one character."""
    text = random_string(HEX_DIGITS)
    number = random_string(DIGITS)
    seconds = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(4_000_000_000)))
    uuid = F.regexp_replace(text, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    ruler = F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(32))
    forms = F.array(number, ruler, F.date_format(seconds, "yyyy-MM-dd'T'HH-mm-ss"), F.date_format(seconds, "yyyyMMdd_HHmmss"), uuid)
    return spark.range(per_form, numPartitions=4).select(F.explode(forms).alias("text"))


def identifiers(tokens: DataFrame) -> DataFrame:
    """Every token(text) as snake_case, CONSTANT_CASE, path, slug and camelCase, in one string."""
    plain, upper, camel = F.col("text"), F.upper("text"), F.initcap("text")
    return tokens.select(F.concat(plain, F.lit("_"), plain, F.lit("_"), upper, F.lit("_"), upper, F.lit("/"), plain, F.lit("/"), plain, F.lit("-"), plain, camel).alias("text"))


def pair_counts(strings: DataFrame) -> DataFrame:
    """(pair, n): neighbouring characters within the alphabet, over all strings(text)."""
    letters = F.split("text", "")
    rest = F.greatest(F.length("text") - 1, F.lit(0))
    pairs = strings.select(F.explode(F.zip_with(F.slice(letters, F.lit(1), rest), F.slice(letters, F.lit(2), rest), lambda a, b: F.concat(a, b))).alias("pair"))
    return pairs.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.count("*").alias("n"))


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all a, b of the alphabet.

    A share of every row is spread evenly, so a pair never seen costs the same whatever the corpus's size.
    """
    even = 1 / len(ALPHABET)

    def row(counts: dict[str, int], a: str) -> list[float]:
        n = [counts.get(a + b, 0) for b in ALPHABET]
        total = sum(n)
        return [(1 - SMOOTHING) * x / total + SMOOTHING * even if total else even for x in n]

    return [math.log(r / o) for a in ALPHABET for r, o in zip(row(random, a), row(ordinary, a))]


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """The model from labelled samples random(text) and ordinary(text): one log ratio per pair of characters.

    All strings count; what comes to the driver is two tables of at most one row per pair of the alphabet.
    """
    counts = [{r["pair"]: r["n"] for r in pair_counts(s.filter("length(text) > 1")).collect()} for s in (random, ordinary)]
    return log_ratios(*counts)


def log_ratio(value: Column, model: list[float]) -> Column:
    """Sum over the neighbouring characters of a string over the alphabet; one walk over its characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")

    def step(state: Column, letter: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), letter)
        ratio = F.when(state["before"] > 0, F.element_at(table, (state["before"] - 1) * len(ALPHABET) + place)).otherwise(F.lit(0.0))
        return F.struct(place.alias("before"), (state["sum"] + ratio).alias("sum"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, min_ratio: float = MIN_RATIO
) -> DataFrame:
    """One row per input row: doc_id, base and added (arrays of start, kind, end; kind numbers KINDS).

    base holds the spans of the fixed patterns; added the tokens of 12 or more characters, apart from
    all base spans, that the models call random. Places are code points, end exclusive. A null text
    is empty and has no spans; repeated rows are scanned each; ids are passed on as they are; other
    columns are ignored; an empty table gives none. Without ``model`` one is trained on ``docs``.
    """
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    if model is None:
        values = [F.transform(m, lambda x: x["value"]) for m in base_matches(F.col("text")).values()]
        hits = docs.select(F.explode(F.concat(*values)).alias("text"))
        rest = F.col("text")
        for pattern in (ASSIGN, ACCESS, HEX):
            rest = F.regexp_replace(rest, pattern, " ")
        tokens = docs.select(F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("text")).distinct()
        spark = docs.sparkSession
        model = train(hits.union(generated(spark, GENERATED)), identifiers(tokens).union(generated_ordinary(spark, GENERATED)))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = matches(F.col("text"), CANDIDATE, 0, lambda value: log_ratio(value, model) >= min_ratio)
    random = F.when(F.col("text").rlike(CANDIDATE), found).otherwise(none)
    scanned = docs.select("doc_id", base_spans(F.col("text")).alias("base"), spans(random, "markov").alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return scanned.select("doc_id", "base", apart.alias("added"))
