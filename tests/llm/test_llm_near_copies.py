"""A group of near copies whose similarities lie on both sides of the threshold."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import minhash

SCHEMA = "doc_id long, text string"


def near_copies(seed=3, n=150, width=160):
    """Copies of one text with some words replaced, at 0.7 to 0.8 of each other; every tenth is linked with the one before it."""
    rng = random.Random(seed)
    rows, text = [], []
    for i in range(n):
        anew = i == 0 or i % 10 > 0
        text = [f"w{k}" for k in range(width)] if anew else text
        for at in rng.sample(range(width), rng.randint(5, 7) if anew else 1):
            text[at] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("few", [1, 8])
def test_pairs_of_a_group_of_near_copies_are_no_rows(spark, monkeypatch, few):
    rows, tested, plain = near_copies(), [], minhash._Search.links

    def links(self, pairs):
        tested.append(pairs.count())
        return plain(self, pairs)

    monkeypatch.setattr(minhash._Search, "links", links)
    monkeypatch.setattr(minhash, "FEW", few, raising=False)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), length=2)
    want = sorted(brute.near_duplicates(rows, 2), key=repr)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == want
    # In proportion to the rows; buckets of other sizes draw other classes, so somewhat more than one draw's.
    assert sum(tested) <= 4 * (few + 2) * len(rows)


def test_differences_from_any_set_confirm_like_full_sets(spark):
    rng = random.Random(5)
    sets = [rng.sample(range(30), rng.randint(18, 28)) for _ in range(40)]
    sets += [list(range(10)), list(range(8)), list(range(100, 109)), [1]]  # the first two are at 0.8 exactly
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    search = minhash._Search(table, table, 0.8)
    for center in (0, len(sets) - 2):
        apart = search.differences(table.select("node", F.lit(center).cast("long").alias("center")))
        sized = apart.join(table.select("node", F.size("shingles").alias("n")), "node").select("node", "n", "apart")
        pairs = sized.crossJoin(sized.toDF("x_node", "x_n", "x_apart")).filter(search.linked("x_n", "n", "x_apart", "apart"))
        want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})]
        assert (40, 41) in want
        assert sorted(map(tuple, pairs.select("node", "x_node").collect())) == want
