"""The pipeline's stages against plain Python, and the queries' registration."""

import random
from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__

from .data import documents, hits, nasty, one_of_each, prose, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with copies, junk, labels and leaked benchmark passages."""
    rng = random.Random(6)
    passages = [(k, prose(rng, 30)) for k in range(6)]
    rows = nasty() + [(400 + k, prose(random.Random(k), 90 + k % 40)) for k in range(60)]
    rows += [(500 + k, rows[-1 - k][1]) for k in range(10)]
    rows += [(600 + k, " | ".join(prose(random.Random(k), 60).split())) for k in range(20)]
    leaks = [passages[k % 6][1] + " " + prose(rng, 100) + " " + passages[(k + 1) % 6][1] for k in range(8)]
    rows += [(700 + k, t) for k, t in enumerate(leaks)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(not 600 <= i < 700), 0) for i, _ in rows if i is not None and i >= 400]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, passages


def test_stages_follow_each_other(spark, corpus):
    folder, passages = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_model", "simhash", "decontaminate", "packing"
    ]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        kept[name] = (before, after)
        docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = kept["quality_rules"]
    base = [i for i, t in before if (q := quality(t))["n_words"] >= 50 and 2 * q["n_repeat_words"] <= q["n_words"]]
    bars = {i for i in base if i is not None and 600 <= i < 700}
    assert Counter(i for i, _ in after) == Counter(i for i in base if i not in bars)
    before, after = kept["quality_model"]
    assert {i for i, _ in before} - {i for i, _ in after} <= {9, 10, 11, None}
    before, after = kept["simhash"]
    assert Counter(after) == one_of_each(before)
    before, after = kept["decontaminate"]
    assert [i for i, _ in after if i is not None and i >= 700] == []
    assert Counter(after) == Counter(x for x in before if len(hits(x[1], passages)[2]) < 2)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in after}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length) for r in whole).total() == len(pieces)
    assert {r.doc_id for r in whole} == {r.doc_id for r in pieces}


def test_stages_keep_columns_and_bear_empty_tables(spark, corpus):
    folder, _ = corpus
    clashing = documents(spark, nasty(4) + [(k, prose(random.Random(k), 90)) for k in range(900, 912)])
    for docs in (clashing, clashing.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            rows = out.collect()
            assert all(r["fp"] == "x" and r["_bad_id"] == "x" for r in rows)
            docs = spark.createDataFrame(rows, out.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert pieces == []


def test_registered(spark):
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert "pipeline" in names and "bucket_avg" in names
    assert {"op1_decontaminate", "op2_quality_rules", "op5_chat_format"} <= set(__spark_entry__.oracle_sql())
