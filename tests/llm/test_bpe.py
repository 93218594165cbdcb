import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sowline.llm import bpe
from sowline.llm.common import Memo

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
TEXTS = ["", " ", "hello world", "<|endoftext|> is ordinary", "x" * 30_000, "ab" * 5000, "é́ ‿ 🙂👩‍👩‍👧 \r\n\x00\x85 1234567",
         " lead and trail  ", "a\n\n\nb", "thththetionhean" * 50]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.PerfectHash(RANKS), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(codec):
    assert len(codec.whole.keys) == len(RANKS) and None not in codec.whole.keys
    assert all(codec.whole.get(b) == r for b, r in RANKS)
    assert codec.whole.get(b"no such entry") is None and codec.whole.get(b"") is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_reference_library(codec, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_small_cache_gives_the_same(codec, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 3)
    monkeypatch.setattr(codec, "memo", Memo(1500))
    small = bpe.Codec(codec.whole, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert small.encode(text) == codec.encode(text)


def test_whole_operator(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (50, None), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, ids string").withColumnRenamed("ids", "text").selectExpr("*", "'z' as n_tokens")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out}
    want = set()
    for i, t in rows:
        ids = np.array(REFERENCE.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.add((i, len(ids) // 4, ids, (t or "").encode()))
    assert got == want
    empty = bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0


def test_query_on_driver_table(spark):
    from sowline.llm.queries import QUERIES

    base = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op10_byte_level_bpe"](spark, base).collect()}
    for r in spark.read.parquet(f"{base}/documents.parquet").collect():
        ids = np.array(REFERENCE.encode_ordinary(r.text or ""), dtype="<u4").tobytes()
        assert got[r.doc_id].n_tokens == len(ids) // 4
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
