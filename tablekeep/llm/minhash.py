"""Near duplicates by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

Documents with the same shingle set form a class, and classes are compared. Each class has MinHash
minima; runs of minima make band keys, and of every minimum only the low bits are kept, packed in
bit planes. Every class is first paired with one smaller class of its buckets (stars, so a group of
any size gives no more pairs than members). Pairs whose collision-corrected estimate, counted in
bits, can reach the threshold are confirmed on the full sets; pairs with too many shingles that no
other candidate has are known to fail before. Buckets that still hold several
components are then searched further: pairs between different components only, from ever larger
parts of the bucket, until every such pair is tested. Where a bucket needs more than a few pairs a
member, its sets travel as their differences from one member, and a pair is confirmed where it
meets: near copies differ little, and only links become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.components import components, compose, forest_roots, rename
from tablekeep.llm.words import mix, run_hashes, slices, take, word_hashes
from tablekeep.session import materialize

LANES = 512  # minima per set; all of them estimate, the first BANDS * ROWS make bands
ROWS, BANDS = 6, 42  # a pair at 0.8 is missed by all bands with probability 3e-6
BITS = 2
SIGMAS = 5  # how far below the threshold an estimate may be
BLOCK = 1 << 16  # shingles hashed at once
SLICE = 1 << 20  # bytes of text worked on at once
FEW = 8  # classes of a bucket that are paired with all others, each pair a row
GROWTH = 256  # times as many in each further round

_RANDOM = np.random.default_rng(20240229)  # the same permutations everywhere
_TIMES = _RANDOM.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, LANES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one shingle where there are fewer."""
    words, per_text = word_hashes(texts, lower=True)
    runs, counts = run_hashes(words, per_text, length)
    at, first = np.cumsum(counts) - counts, np.cumsum(per_text) - per_text
    out = [np.unique(runs[s : s + n]) for s, n in zip(at, counts)]
    for i in np.flatnonzero((counts == 0) & (per_text > 0)):
        short = words[first[i] : first[i] + per_text[i]].tobytes()
        out[i] = np.array([xxhash.xxh3_64_intdigest(short, int(per_text[i]))], np.uint64)
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of every permutation over every set; sets are not empty."""
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    edges = np.append(0, np.cumsum(sizes))
    out = np.full((len(sets), LANES), np.iinfo(np.uint32).max, np.uint32)
    start = 0
    while start < len(flat):
        stop = min(start + BLOCK, len(flat))
        some = np.arange(np.searchsorted(edges, start, "right") - 1, np.searchsorted(edges, stop, "left"))
        cuts = np.maximum(edges[some], start) - start
        x = flat[start:stop]
        for k in range(LANES):
            least = np.minimum.reduceat(x * _TIMES[k] + _PLUS[k], cuts)
            out[some, k] = np.minimum(out[some, k], least)
        start = stop
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(low), 1))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return keys.view(np.int64)


def bit_planes(low: np.ndarray) -> np.ndarray:
    """Low bits of the scrambled minima: plane 0 of all lanes, then plane 1, in 64-bit words."""
    scrambled = mix(low.astype(np.uint64))
    planes = [np.packbits((scrambled >> np.uint64(b)) & np.uint64(1) != 0, axis=1).view(np.int64) for b in range(BITS)]
    return np.hstack(planes)


def similarity_estimate(a: str, b: str) -> F.Column:
    """Jaccard similarity from two columns of bit planes, corrected for bits that agree by chance."""
    words = LANES // 64
    differ = [" | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(BITS)) for w in range(words)]
    same = F.expr(f"{LANES} - (" + " + ".join(f"bit_count({d})" for d in differ) + ")")
    chance = 2.0**-BITS
    return (same / LANES - chance) / (1 - chance)


def estimate_floor(threshold: float) -> float:
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - SIGMAS * math.sqrt(p * (1 - p) / LANES) / (1 - chance)


def alone(sets: DataFrame) -> DataFrame:
    """(node, alone): how many shingles of a set none of the other sets has; sets without one are left out."""
    shingles = sets.select("node", F.explode("shingles").alias("s"))
    owners = shingles.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    return owners.filter("c = 1").groupBy("node").agg(F.count("*").alias("alone"))


def _lists(rows: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rows.ravel()))


def _signatures(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                sets = shingle_sets(part.column("text"), length)
                full = np.array([len(s) > 0 for s in sets])
                low = minima([s for s in sets if len(s)]) if full.any() else np.zeros((0, LANES), np.uint32)
                names = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
                columns = [
                    part.column("doc_id"),
                    part.column("fp"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([n >> 64 for n in names], np.uint64).view(np.int64)),
                    pa.array(np.array([n & 2**64 - 1 for n in names], np.uint64).view(np.int64)),
                    _lists(bit_planes(low), full * (BITS * LANES // 64)),
                    _lists(band_keys(low), full * BANDS),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "n", "f1", "f2", "planes", "bands"])

    return run


def _node_sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                sets = shingle_sets(part.column("text"), length)
                lists = _lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])

    return run


class _Search:
    """Confirmed links of one run, as the components they make: (node, root) for every node but the roots."""

    def __init__(self, classes: DataFrame, sets: DataFrame, threshold: float):
        self.classes, self.sets, self.threshold = classes, sets, threshold
        self.roots: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that can reach the threshold."""
        sketch = self.classes.select("node", "n", "common", "planes")
        joined = pairs.join(sketch.toDF("a", "na", "ca", "pa"), "a").join(sketch.toDF("b", "nb", "cb", "pb"), "b")
        return joined.filter(self.can_reach("na", "nb", "ca", "cb", "pa", "pb")).select("a", "b", "na", "nb")

    def can_reach(self, na: str, nb: str, ca: str, cb: str, pa: str, pb: str) -> F.Column:
        """By the bound that sizes and shingles of a single class set, which is sure, and by the estimate."""
        shared = F.least(ca, cb)
        bound = shared >= self.threshold * (F.col(na) + F.col(nb) - shared) - 1e-9
        return bound & (similarity_estimate(pa, pb) >= estimate_floor(self.threshold))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are links, compared on full sets."""
        a = self.sets.toDF("a", "sa")
        b = self.sets.toDF("b", "sb")
        shared = F.size(F.array_intersect("sa", "sb"))
        exact = pairs.join(b, "b").join(a, "a").withColumn("shared", shared)
        union = F.col("na") + F.col("nb") - F.col("shared")
        # Whole numbers: no rounding decides at the threshold itself.
        return exact.filter(100 * F.col("shared") >= round(100 * self.threshold) * union).select("a", "b")

    def differences(self, nodes: DataFrame) -> DataFrame:
        """Of each (node, center), the shingles that only one of the two sets has."""
        near = nodes.join(self.sets.toDF("node", "s"), "node").join(self.sets.toDF("center", "cs"), "center")
        return near.select("node", "center", F.array_union(F.array_except("s", "cs"), F.array_except("cs", "s")).alias("apart"))

    def linked(self, na: str, nb: str, da: str, db: str) -> F.Column:
        """Whether two sets are linked, exactly, by their differences from the same set.

        What only one of them has is what only one of the differences has.
        """
        both, apart = F.col(na) + F.col(nb), F.size(da) + F.size(db) - 2 * F.size(F.array_intersect(da, db))
        return 100 * (both - apart) >= round(100 * self.threshold) * (both + apart)

    def rooted(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.roots.toDF("node", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")

    def stars(self, members: DataFrame) -> None:
        """Tests every class against one more central class: the pivot it shares most buckets with.

        A bucket's pivot is the member with the fewest shingles that no other candidate has.
        """
        pivots = materialize(members.groupBy("key").agg(F.min(F.struct("alone", "node")).alias("p")).select("key", "p.node").toDF("key", "pivot"), "pivots")
        shared = members.select("key", "node").join(pivots, "key").filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
        best = shared.groupBy("node").agg(F.max_by("pivot", "n").alias("a")).withColumnRenamed("node", "b")
        self.roots = forest_roots(self.links(self.likely(best)).toDF("root", "node"))

    def rest(self, members: DataFrame) -> None:
        """Tests what the stars left: pairs of different components that meet in a bucket.

        In each round one class of a pair is among about ``part`` of its bucket, or is a class of the
        bucket's component of smallest root, most likely the largest. The components found lessen the
        pairs of the next round, with a larger part. When no part is left out, every pair has been
        tested or is within one component. Pairs with FEW classes are rows, confirmed on full sets;
        further ones are confirmed in the join that finds them.
        """
        sketch = self.classes.select("node", "n", "common", "planes", "bands")
        last, part = 0, FEW
        while True:
            inside = materialize(self.rooted(members.select("key", "node", "alone")), "inside")
            least = [F.min(F.struct(*by, "node")).alias(name) for name, by in (("pivot", ["root", "alone"]), ("center", ["alone"]))]
            mixed = inside.groupBy("key").agg(F.count("*").alias("left"), F.max("root").alias("high"), *least)
            mixed = mixed.filter((F.col("pivot.root") != F.col("high")) & (F.col("left") > last))
            mixed = materialize(mixed.select("key", "left", F.col("pivot.node").alias("pivot"), F.col("center.node").alias("center")), "mixed")
            if mixed.isEmpty():
                return
            draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)
            drawn = ((draw * F.col("left") < part) | (F.col("node") == F.col("pivot"))).alias("drawn")
            # A bucket of one component stays one, so the others are all that further rounds need.
            members = materialize(inside.join(mixed, "key").select("key", "node", "alone", "root", "center", drawn), "members")
            rows = members.select("key", "node", "root", "center", "drawn")
            if last:
                apart = materialize(self.differences(rows.select("node", "center").distinct()).join(sketch, "node"), "differences")
                some = materialize(rows.join(apart, ["node", "center"]), "open")
            else:
                some = materialize(rows.join(sketch, "node"), "open")
            x = some.filter("drawn").select(*(F.col(c).alias(f"x_{c}") for c in some.columns))
            agreed = F.zip_with("x_bands", "bands", lambda p, q: p == q)
            meet = (
                (F.col("key") == F.col("x_key"))
                & (F.col("root") != F.col("x_root"))
                & ((F.col("x_node") < F.col("node")) | ~F.col("drawn"))
                & self.can_reach("x_n", "n", "x_common", "common", "x_planes", "planes")
                # In the first band they share, so that a pair comes once.
                & (F.element_at("bands", F.array_position(agreed, F.lit(True)).cast("int")) == F.col("key"))
            )
            if last:
                links = some.join(x, meet & self.linked("x_n", "n", "x_apart", "apart")).select(F.col("x_node").alias("a"), F.col("node").alias("b"))
            else:
                pairs = some.join(x, meet).select(F.col("x_node").alias("a"), F.col("node").alias("b"), F.col("x_n").alias("na"), F.col("n").alias("nb"))
                links = self.links(pairs)
            links = materialize(rename(links, self.roots).toDF("a", "b"), "near-links")
            if not links.isEmpty():
                self.roots = compose(self.roots, components(links))
            last, part = part, part * GROWTH


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, threshold: float = 0.8
) -> DataFrame:
    """One row per input row: doc_id, fp (xxhash64 of the text), n_shingles, component_id, kept.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A text's set
    holds its distinct shingles of ``length`` words; with fewer words, all of them as one; without
    words (or null) it is empty and linked with nothing. Texts are linked where the shared shingles
    are at least ``threshold`` of the union. component_id is the smallest id reachable by links (null
    only where no row of the component has an id); an empty set's is its own id. kept marks the
    document with that id (of several texts under it, the one of smallest fp; repeated rows of it
    are all marked). Ids are bigint. Other columns are ignored; an empty table gives none.
    """
    docs = take(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    keyed = docs.withColumn("fp", F.xxhash64("text"))
    signed = keyed.mapInArrow(
        _signatures(length), "doc_id long, fp long, n long, f1 long, f2 long, planes array<long>, bands array<long>"
    )
    signed = materialize(signed, "minhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    classes = signed.filter("n > 0").groupBy("n", "f1", "f2").agg(first, F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    keys = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1")
    buckets = materialize(buckets.select("key", "least"), "buckets")
    members = keys.join(buckets.select("key"), "key").select("node").distinct()
    needed = members.join(classes.select("node", "first.doc_id", "first.fp"), "node")
    needed = materialize(needed, "needed")
    same = keyed["doc_id"].eqNullSafe(needed["doc_id"]) & (keyed["fp"] == needed["fp"])
    texts = keyed.join(needed.hint("shuffle_hash"), same).select("node", "text")
    sets = materialize(texts.mapInArrow(_node_sets(length), "node long, shingles array<long>").dropDuplicates(["node"]), "node-sets")

    # How many of a class's shingles another candidate has at all: no link can share more.
    candidates = classes.select("node", "n", "planes", "bands").join(needed.select("node"), "node")
    sized = candidates.join(materialize(alone(sets), "alone"), "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    candidates = materialize(sized.drop("alone"), "candidates")
    # In a bucket, a class meets none smaller than the smallest; where even that bound says no, it leaves.
    placed = candidates.select("node", "n", "common", F.explode("bands").alias("key")).join(buckets, "key")
    other = F.greatest(F.col("least"), threshold * F.col("n"))
    able = F.col("common") >= threshold * (F.col("n") + other - F.col("common")) - 1e-9
    members = materialize(placed.filter(able).select("key", "node", (F.col("n") - F.col("common")).alias("alone")), "able-members")

    search = _Search(candidates, sets, threshold)
    search.stars(members)
    search.rest(members)
    rooted = materialize(search.rooted(classes.select("node", "n", "f1", "f2", "first")), "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("lowest")), "component-ids")
    of_class = materialize(rooted.join(named, "root").select("n", "f1", "f2", "lowest"), "class-components")
    out = signed.select("doc_id", "fp", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    empty = F.col("n") == 0
    is_lowest = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("fp") == F.col("lowest.fp"))
    return out.select(
        "doc_id",
        "fp",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        (empty | is_lowest).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps.

    Rows without a word all stay. Of repeated rows (same id and text) one stays, that of the smallest
    hash of all columns.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = plain.withColumns({"id": doc_id.cast("bigint"), "fp": F.xxhash64(text)})
    kept = near_duplicates(docs, id_col, text_col, length, threshold).filter("kept").select("doc_id", "fp").distinct()
    kept = materialize(kept.toDF("kept_id", "kept_fp"), "kept")
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp"))
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*[F.col(c) for c in plain.columns])
    repeats = keyed.filter(~wordless).join(kept.hint("shuffle_hash"), same, "left_semi").groupBy("id", "fp")
    one = repeats.agg(F.min_by(whole, F.xxhash64(whole.cast("string"))).alias("r")).select("r.*")
    rows = one.unionByName(plain.filter(wordless))
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
