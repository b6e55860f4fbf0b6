from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tessella.llm.common import shared_dir, written


def run(spark, docs):
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        sizes.append(docs.count())
    return docs, sizes


def test_odd_documents(spark, odd):
    from conftest import texts

    docs = spark.createDataFrame([(None if i == 3 else i, t, None if i % 2 else "en", None if i == 4 else f"s{i % 3}", i) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")
    out, _ = run(spark, docs)
    assert {"doc_id", "ids", "sequence_id"} <= set(out.columns)


def test_empty(spark):
    out, sizes = run(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sizes == [0] * 6


def test_stages_leave_no_large_tables(spark):
    """What holds texts, sketches or keys is deleted once no later step reads it: later stages run on the same disk."""
    passage = " ".join(f"passage{i}" for i in range(80))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 2}x{j}" for j in range(300)) + f" end{i}", "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    had = set(os.listdir(folder))
    kept = written(corpus_pipeline.near_duplicates(spark, docs, ""), "kept")
    out = corpus_pipeline.repeated_passages(spark, kept, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 12, 2))
    assert all("passage1 " not in r.text and f"end{r.doc_id}" in r.text for r in out.collect())
    left = {x.split("-")[0] for x in os.listdir(folder) if x not in had}
    assert not left & {"members", "classes", "met", "sketches", "texts", "codes", "work"}, left


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, sizes = run(spark, docs)
    assert sizes[0] >= sizes[1] > 0.9 * sizes[0] and sizes[1] > sizes[2] > 0.6 * sizes[1]
