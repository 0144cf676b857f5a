"""The pipeline stage by stage against brute force, and the registered queries on small data."""

import brute
import pytest
from compare import connect, differences

import corpus_pipeline
from tablekeep.llm import quality
from tablekeep.llm.queries import CHECKS, QUERIES, vocabulary
from tablekeep.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = documents.columns
    inputs, outputs = [], []
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = materialize(stage(spark, docs, FOLDER), "stage")
        outputs.append(docs.collect())
    assert all(rows and rows[0].__fields__ == columns for rows in outputs[:4])

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.quality_scores(documents, labels).collect()
    assert {r.doc_id for r in outputs[0]} == {r.doc_id for r in scores if r.predicted}
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in outputs[0]}
    wrong = [d for d, q in known.items() if (d in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(known)

    pairs = [(r.doc_id, r.text) for r in inputs[1]]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in outputs[1]) == sorted((i, t, len(t)) for i, t, _, _ in brute.frequent_lines(pairs, 10))

    nodes = brute.near_duplicates([(r.doc_id, r.text) for r in inputs[2]], 5)
    assert {r.doc_id for r in outputs[2]} == {i for i, n, c in nodes if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, _, _, _ in brute.contained([(r.doc_id, r.text) for r in inputs[3]], items)}
    assert {r.doc_id for r in outputs[3]} == {r.doc_id for r in inputs[3]} - bad

    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in inputs[4]}
    assert {r.doc_id for r in outputs[4]} == set(texts)
    for r in outputs[4]:
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.text) == (want, len(want), tokenizer.decode(want, skip_special_tokens=False))
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(texts)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in CHECKS:
        problem, rows = differences(spark, FOLDER, QUERIES[name], CHECKS[name], connect(FOLDER))
        assert problem is None and rows, problem
    else:
        frame = QUERIES[name](spark, FOLDER)
        source = "pages" if "main_text" in name else "documents"
        assert frame.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in (1, 2, 3, 4, 5, 6, 8, 9, 10)} <= {q.split("_")[0] + "_" for q in entry.queries()}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
