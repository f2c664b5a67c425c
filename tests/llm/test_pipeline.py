"""The pipeline's rows against its stages done one by one in memory."""

from collections import Counter

import pandas as pd

import corpus_pipeline
from quire.llm import decontaminate, near_dedup, packing, queries
from quire.llm.queries import tokenizer_path


def test_stages_and_result(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first = {r.doc_id for r in queries.op9_quality_rules(spark, sf_small).where("kept").collect()}
    step = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_small).persist()
        assert step.columns == docs.columns
        seen.append({r.doc_id for r in step.select("doc_id").collect()})
    assert seen[0] == first and seen[0] >= seen[1] >= seen[2] >= seen[3]
    texts = [r.text for r in step.select("text").collect()]
    assert max(Counter(texts).values()) == 1
    items = [decontaminate.WORD.findall(decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}
    for t in texts:
        w = decontaminate.WORD.findall(decontaminate.normalise(t))
        assert not any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12))
    packed = corpus_pipeline.run(spark, sf_small).collect()
    assert {r.doc_id for r in packed} == seen[3]


def test_workers_keep_the_state_of_one_operator():
    path, part = tokenizer_path(), pd.DataFrame({"digest": [b"1"], "text": ["some words of a text that is signed"]})
    bpe = packing.byte_bpe(path)
    assert packing.byte_bpe(path) is bpe  # serves later tasks of packing
    assert len(next(near_dedup._signed(32)(iter([part])))) == 1
    assert packing.byte_bpe(path) is not bpe  # but isn't held while others use the worker
