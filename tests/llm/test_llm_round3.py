"""Spelling variants, shards and token alignment against brute force on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import alignment, components, sharding, spelling
from tablekeep.llm.queries import vocabulary

SCHEMA = "doc_id long, text string"
BYTE_BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def frame(spark, rows, partitions=3):
    """Rows with further columns whose names clash, some only in case."""
    wide = [(t, i, "x", 1.5, 7) for i, t in rows]
    return spark.createDataFrame(wide, "text string, doc_id long, TEXT string, size double, n long").repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    return brute.awkward()


def collected(found):
    return sorted(map(tuple, found.collect()), key=repr)


# ---- spelling variants


def misspelt(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀß×") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 60)
        for _ in range(12):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            new = w[:at] + ("" if kind == 0 else rng.choice("abcdeé")) + w[at + (kind < 2) :]
            words += [new.upper() if rng.random() < 0.1 else new] * rng.randint(1, 12)
    rng.shuffle(words)
    texts = [" 12,".join(words[i : i + 25]) for i in range(0, len(words), 25)]
    return [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[4]), (9, None), (10, ""), (11, "ab " * 5000 + "à" * 300)]


def variants(rows, min_chars, min_count, ratio, every):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            if every:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(around[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every,symbols", [(199, 8), (3, 2), (None, 16)])
def test_spelling_variants(spark, every, symbols):
    data = misspelt()
    got = spelling.spelling_variants(frame(spark, data), drop_every=every, symbols=symbols)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    expected = variants(data, 6, 5, 5, every)
    assert collected(got) == expected
    assert any(r[3] for r in expected) and any(r[3] and r[5] != r[3] for r in expected) == any(r[3] and r[5] != r[3] for r in collected(got))


def test_spelling_of_shared_rows_and_ties(spark, rows):
    data = rows + [(500, "abcdef " * 50 + "abcdeg " * 50 + "abcdeh " * 10)]
    got = spelling.spelling_variants(frame(spark, data), min_chars=1, min_count=2, ratio=2, drop_every=5)
    assert collected(got) == variants(data, 1, 2, 2, 5)
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, data), ratio=1)


def test_chain_of_forms(spark):
    text = " ".join(["abcdefgh"] * 5 + ["abcdefg"] * 25 + ["abcdef"] * 125 + ["abcdefghi"])
    found = {r.word: (r.form, r.root) for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], SCHEMA)).collect()}
    assert found == {"abcdefgh": ("abcdefg", "abcdef"), "abcdefg": ("abcdef", "abcdef"), "abcdef": (None, "abcdef")}


def test_neighbourhood_is_whole():
    rng = random.Random(4)
    words = ["".join(rng.choice("abyzàÿß") for _ in range(n)) for n in (1, 2, 5, 9, 1)]
    code = lambda c: zlib.crc32(bytes([ord(c)])) % 3 + 1
    value = lambda s: sum(x * int(spelling.BASE) ** (len(s) - 1 - i) for i, x in enumerate(s)) % 2**64
    word, hashes = spelling.neighbourhoods(words, 3)
    for k, w in enumerate(words):
        s = [code(c) for c in w]
        every = {tuple(s)} | {tuple(s[:i] + s[i + 1 :]) for i in range(len(s))}
        every |= {tuple(s[:i] + [x] + s[i + j :]) for x in (1, 2, 3) for j in (0, 1) for i in range(len(s) + 1 - j)}
        assert {h % 2**64 for h in hashes[word == k].tolist()} == set(map(value, every))
        assert int(hashes[k]) % 2**64 == value(s)


def test_very_long_words(spark):
    """Letters without a break in several copies of a document, and a copy with one letter less."""
    long = "".join(random.Random(8).choice("abcdefgh") for _ in range(60_000))
    rows = [(i, long if i % 2 else long[:30_000] + long[30_001:]) for i in range(40)] + [(99, long)] * 120
    found = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).select(F.length("word"), "n", "n_near", F.length("root")).collect()
    assert sorted(map(tuple, found)) == [(59_999, 20, 1, 60_000), (60_000, 140, 1, 60_000)]


def test_held_words_are_bounded(spark, monkeypatch):
    data = misspelt(2)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert collected(spelling.spelling_variants(frame(spark, data, 1), drop_every=199)) == variants(data, 6, 5, 5, 199)


# ---- shards


def test_shards_of_awkward_rows(spark, rows):
    got = sharding.shard_documents(frame(spark, rows, 5)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr
    )
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    again = sharding.shard_documents(frame(spark, rows[::-1], 2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))  # whatever the partitions
    other = sharding.shard_documents(frame(spark, rows), seed=1).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, got))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 24, 97, 1000, 1001])
def test_permutation_and_its_inverse(spark, n):
    f = sharding.Feistel(spark, n, seed=3)
    placed = spark.range(n).select("id", f.place(F.col("id")).alias("place"))
    back = placed.select("id", "place", f.row(F.col("place")).alias("row")).collect()
    assert sorted(r.place for r in back) == list(range(n)) and all(r.row == r.id for r in back)


def test_large_numbers_stay_inside(spark):
    n = 10**15 + 7
    f = sharding.Feistel.__new__(sharding.Feistel)
    f.n, f.seed, f.rounds, f.walks = n, 0, 6, 3
    f.a, f.b = 31622777, -(-n // 31622777)
    r = spark.range(n - 500, n).select("id", f.place(F.col("id")).alias("p")).select("id", "p", f.row(F.col("p")).alias("r")).collect()
    assert len({x.p for x in r}) == 500 and all(0 <= x.p < n and x.r == x.id for x in r)


def test_shuffle_is_even(spark):
    """Neighbours in the table end up in unrelated shards."""
    placed = sharding.with_shards(spark.range(4800), ["id"])
    thirds = placed.groupBy(F.expr("id div 1600").alias("third"), "shard").count().collect()
    assert len(thirds) == 72 and all(35 <= r["count"] <= 105 for r in thirds)  # 67 expected


def test_written_shards_hold_what_is_computed(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, ["doc_id"], shards=7, seed=2, tasks=3)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.filter("text <> 't' || doc_id").isEmpty()
    row = sharding.row_at(spark, 100, F.col("shard"), F.col("slot"), 7, 2)
    assert back.filter(row != F.col("doc_id")).isEmpty()


def test_no_table_of_the_vocabulary_is_broadcast(spark, monkeypatch):
    """Spark sizes neighbourhoods as the words they come from, and stored words smaller than they are in memory."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "materialize", kept)
    monkeypatch.setattr(spelling, "forest_roots", lambda parents, **_: parents.toDF("node", "root"))
    docs = spark.createDataFrame([(i, "letters lettres letter " * 5) for i in range(9)], SCHEMA)
    kept(spelling.spelling_variants(docs), "result")
    monkeypatch.undo()
    stored = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: stored(kept(df, label), label))
    roots = components.forest_roots(spark.createDataFrame([("b", "a"), ("c", "b")], "node string, root string"), merged=True)
    assert collected(roots) == [("b", "a"), ("c", "a")]
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


# ---- alignment


def aligned(rows):
    """[(doc_id, n_a, n_b, groups as text, links as id pairs)] token by token."""
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    spare = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(spare)}
    out = []
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((doc, 0, 0, None, []))
            continue
        sums = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
        if len(raw_a) > 2000:  # the same sums, one by one
            from itertools import accumulate

            sums = lambda raw: list(accumulate(map(len, raw)))
        end_a, end_b = sums(raw_a), sums(raw_b)
        groups, links, at_a, at_b = [], [], 0, 0
        place_b = {e: k for k, e in enumerate(end_b)}
        for k, e in enumerate(end_a):
            if e in place_b:
                j = place_b[e]
                groups.append(",".join(map(str, ids_a[at_a : k + 1])) + "|" + ",".join(map(str, ids_b[at_b : j + 1])))
                links.append((ids_a[k], ids_b[j]))
                at_a, at_b = k + 1, j + 1
        out.append((doc, len(ids_a), len(ids_b), ";".join(groups), links))
    return out


def expected_alignment(rows):
    docs = aligned(rows)
    count = Counter(link for d in docs for link in d[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g is not None else ""
    return sorted(
        [
            (d, a, b, len(k), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), digest(g))
            for d, a, b, g, k in docs
        ],
        key=repr,
    )


@pytest.mark.parametrize("chunk_bytes", [200, 2 << 20])
def test_alignment(spark, rows, chunk_bytes):
    data = rows + [
        (700, "<|endoftext|> <s> </s><unk> plain"),
        (701, "a ▁ b"),  # B reads it as a space
        (702, "tab\tand\r\n two  spaces   three\x00nul ﬁ 　 \U0001f600‍ naïve"),
        (703, "語" * 3000),
        (704, " "),
        (705, "\n"),
    ]
    got = alignment.align_tokens(frame(spark, data, 4), BYTE_BPE, PIECES, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = expected_alignment(data)
    assert collected(got) == expected
    assert (701, 0, 0, 0, 0, 0, 0, "") in expected and sum(r[4] for r in expected) > 3000


def test_alignment_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(alignment.align_tokens(docs, BYTE_BPE, PIECES)) == expected_alignment(data)


def test_no_stored_row_holds_a_chunk(spark, monkeypatch):
    """Spark reads thousands of stored rows at once: a row may grow with its own document, not with the chunk it lies in."""
    kept = []
    stored = alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda df, label: kept.append(stored(df, label)) or kept[-1])
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1)
    most = alignment.align_tokens(docs, BYTE_BPE, PIECES).agg(F.max("n_links"), F.sum("n_links")).first()
    long = [F.max(F.size(c)) for df in kept for c, kind in df.dtypes if kind.startswith("array")]
    assert 0 < most[0] * 100 < most[1]
    assert long and all(size <= most[0] for df in kept[:1] for size in df.agg(*long).first())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    blank = spark.createDataFrame([(None, None), (1, "")], SCHEMA)
    assert spelling.spelling_variants(empty).count() == spelling.spelling_variants(blank).count() == 0
    assert sharding.shard_documents(empty).count() == 0 and sharding.shard_documents(blank).count() == 2
    assert alignment.align_tokens(empty, BYTE_BPE, PIECES).count() == 0
    assert collected(alignment.align_tokens(blank, BYTE_BPE, PIECES)) == [(1, *[0] * 6, ""), (None, *[0] * 6, "")]


def test_sides_agree_with_the_libraries():
    """Every code point between letters, digits, spaces and itself; units known and unknown."""
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    with open(BYTE_BPE, encoding="utf-8") as f, open(PIECES, "rb") as g:
        a, b = alignment._loaded(f.read(), g.read())
    whole = tokenizers.Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # B reads U+2581 as a space, so a text that holds it has no tokens here, whatever the pieces.
    points = [c for c in range(0x3100) if c != 0x2581] + [*range(0x3100, 0xD800, 97), *range(0xE000, 0x110000, 997)]
    texts = [f"{c}a{c}b {c} 1{c}\n{c}{c}  {c}!  " for c in map(chr, points)]
    texts += [t for _, t in brute.awkward(4) if t] + ["<|endoftext|>", "<s>", "   "]
    assert a.encode(texts).to_pylist() == [e.ids for e in whole.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from what is known
        assert b.encode(texts).to_pylist() == pieces.encode(texts)
