"""One query per operator over its whole table, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm import alignment, bpe, contamination, exact, html, licenses, lines, minhash, quality, secrets, sharding, spelling, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# CRC-32 in SQL: byte values of a hexadecimal text, folded over the table of 256 remainders.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce(list_prepend(c, range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(c)))"""


def crc_of(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes; needs ``CRC_TABLE`` in scope."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    step = "lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), {step}), 4294967295)"


@query("op1_quality_scores")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op2_repeated_windows",
    r"""
WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents),
  d AS (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE regexp_split_to_array(s, '[\x20\x09-\x0D]+') END AS w FROM t),
  r AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
  g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM r),
  c AS (SELECT doc_id, i, w[i] AS word, coalesce(max(later::INT) OVER
      (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN g USING (doc_id, i)),
  k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.drop_repeated_windows(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", digest(F.col("text")).alias("kept_sha256"))


@query("op3_bpe_tokens")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary()
    tokens = bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("text")).alias("decoded_sha256"),
    )


@query("op4_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query(
    "op5_near_duplicates",
    r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
  d AS (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE regexp_split_to_array(s, '[\x20\x09-\x0D]+') END AS w FROM t),
  h AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
  c(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, documents.doc_id = m.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(r) AS component_id FROM c GROUP BY v) m USING (doc_id)
""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), length=2).drop("fp")


@query("op6_secret_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query("op7_licence_notices")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licence_notices(table(spark, folder, "documents"))


@query(
    "op8_benchmark_containment",
    r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w
    FROM documents),
  b AS (SELECT item_id, regexp_split_to_array(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w
    FROM benchmark),
  bn AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE w <> ['']),
  bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
    FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bn)),
  ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
    FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
      FROM d, (SELECT DISTINCT k FROM bn) WHERE w <> [''])),
  n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
  p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM p JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_shingles
""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op9_exact_duplicates",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 AS kept, sha256(s) AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op10_frequent_lines",
    r"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
  k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
  f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
  m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_frequent_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


@query(
    "op11_spelling_variants",
    f"""
WITH RECURSIVE {CRC_TABLE},
  z AS (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) AS wide, string_agg(chr((33 + i)::INT), '' ORDER BY i) AS plain
    FROM range(64) AS r(i)),
  d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
  h AS (SELECT run, k, {crc_of("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM d GROUP BY ALL), crc),
  w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0
      THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
  v AS (SELECT word, n, translate(word, wide, plain) AS bytes, unnest(list_distinct(list_prepend(word, list_transform(
    range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS key FROM w, z),
  p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM v AS a JOIN v AS b USING (key)
    WHERE a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1),
  g AS (SELECT word, count(*) AS n_near, max(n) AS n_best, min(near) FILTER (WHERE n = top) AS best
    FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM p) GROUP BY word),
  o AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_best >= 5 * w.n THEN best END AS form,
    CASE WHEN n_best >= 5 * w.n THEN n_best END AS form_n FROM w LEFT JOIN g USING (word)),
  r(word, root) AS (SELECT word, word FROM o UNION ALL SELECT r.word, o.form FROM r JOIN o ON o.word = r.root WHERE o.form IS NOT NULL)
SELECT o.word, o.form, r.root, o.n, o.n_near, o.form_n
FROM o JOIN r USING (word) JOIN o AS e ON e.word = r.root WHERE e.form IS NULL
""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, folder, "documents"), drop_every=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _round(i: int, moved: str, by: str, size: str) -> str:
    return f"({moved} + ('0x' || substr(sha256('0:{i}:' || {by}), 1, 15))::BIGINT % {size}) % {size} AS {moved}"


@query(
    "op12_shuffled_shards",
    f"""
WITH RECURSIVE {CRC_TABLE},
  d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc_of("coalesce(text, '')")} AS text_crc32
    FROM documents, crc),
  m AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS x FROM d),
  s AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM d)),
  c0 AS (SELECT x, n, a, b, x // b AS l, x % b AS r FROM (SELECT *, unnest(range(a * b)) AS x FROM s)),
  c1 AS (SELECT x, n, a, b, {_round(0, "l", "r", "a")}, r FROM c0),
  c2 AS (SELECT x, n, a, b, l, {_round(1, "r", "l", "b")} FROM c1),
  c3 AS (SELECT x, n, a, b, {_round(2, "l", "r", "a")}, r FROM c2),
  c4 AS (SELECT x, n, a, b, l, {_round(3, "r", "l", "b")} FROM c3),
  c5 AS (SELECT x, n, a, b, {_round(4, "l", "r", "a")}, r FROM c4),
  c6 AS (SELECT x, n, a, b, l, {_round(5, "r", "l", "b")} FROM c5),
  e AS (SELECT x, n, l * b + r AS y FROM c6),
  k(x, y, n) AS (SELECT x, y, n FROM e WHERE x < n UNION ALL SELECT k.x, e.y, k.n FROM k JOIN e ON e.x = k.y WHERE k.y >= k.n)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (y % 24)::INT AS shard, y // 24 AS slot, NULL::INT AS grown_shard
FROM m JOIN k USING (x) WHERE y < n
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op13_aligned_tokens")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
