import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sowline.llm import bpe, decontaminate, quality, secrets, simhash
from sowline.llm.common import stored

BASE = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, seen = docs.columns, None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, BASE), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "quality_rules":
            failed = {r.doc_id for r in quality.features(spark.read.parquet(f"{BASE}/documents.parquet")).where("quality.base_failed").collect()}
            assert failed and not failed & set(after)
        if name == "simhash_near_dedup":
            texts = spark.createDataFrame(list(before.values()))
            classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(texts).collect()}
            assert set(after) == set(classes.values()) and len(after) < len(before)
        if name == "secret_scans":
            assert set(after) == set(before)
            masked = {i for i in after if after[i].text != before[i].text}
            assert masked and all(secrets.MASK in after[i].text and after[i].n_chars == len(after[i].text) for i in masked)
        seen = after
    final = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, BASE).collect()}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks=dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    assert {i: np.frombuffer(bytes(r.ids), "<u4").tolist() for i, r in final.items()} == {i: reference.encode_ordinary(r.text) for i, r in seen.items()}


def test_stages_on_an_empty_table_and_nulls(spark):
    schema = spark.read.parquet(f"{BASE}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, BASE).count() <= max(0, len(rows))
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{BASE}/benchmark.parquet")).count() == 0
