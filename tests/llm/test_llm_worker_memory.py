"""What the pipeline's Python workers hold: they are kept from stage to stage, and so is the memory of the largest."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tablekeep.llm import lines, quality

MODEL = quality.Model(np.ones(quality.FEATURES), 0.0)


def held(run, batch):
    """Peak MB beyond the batch itself, and the rows that come out."""
    run(iter([batch.slice(0, 1)]))
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, n


@pytest.mark.parametrize("run", [quality._featured, quality._good_only(MODEL, "text"), lines._counts])
def test_a_worker_holds_little_besides_its_batch(run):
    texts = ["\n".join(f"line {i} {k} of 30 or so bytes" for k in range(140)) for i in range(1000)]  # 4 MB
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)]
    peak, rows = held(run, pa.RecordBatch.from_arrays(columns, names=["doc_id", "batch", "text"]))
    assert rows >= len(texts)
    assert peak < 40


def test_one_python_worker_a_task_makes_the_tokens(spark, capsys):
    docs = spark.createDataFrame([(1, "Some words, some more"), (2, ""), (3, None)], "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert [(r.doc_id, len(r.ids), r.n_tokens) for r in out.orderBy("doc_id").collect()][1:] == [(2, 0, 0), (3, 0, 0)]
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
