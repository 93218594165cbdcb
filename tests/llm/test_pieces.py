import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from sowline.llm import pieces
from sowline.llm.common import Memo
from sowline.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def _texts(n, seed=5):
    rng = random.Random(seed)
    fixed = ["", " ", "  a", "a\n b\n\n", "▁▁a▁b", "é́ 日本語 \U0001F600 <s></s><unk> <0x0A>", "a" * 3000, " " * 77 + "x" + " " * 5,
             "\t\r\n \x00 x", "﻿abc", "▁", "\n", "ab\n", "the " * 2000, "\U0001F600" * 60, "x\U0001F600y" * 30]
    return fixed + ["".join(rng.choice(" ▁\nabeinorst éß日\U0001F600\t") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(codec, library):
    texts = _texts(1500)
    flat, first, agrees = codec.encode(texts)
    assert agrees
    for i, text in enumerate(texts):
        ids = flat[first[i]:first[i + 1]].tolist()
        assert ids == library.encode(text), text[:60]
        assert codec.decode(ids) == library.decode(ids) == text.replace("▁", " "), text[:60]


def test_side_by_side_equals_the_agenda(codec):
    words = sorted({w for t in _texts(800, 6) for w in codec._segments(codec.library.normalize([t]))[0].to_pylist()})
    assert codec.merge_many(words) == [b"".join(i.to_bytes(4, "little") for i in codec.merge(w)) for w in words]


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(7)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(190, 259), rng.randrange(32000), 29871]) for _ in range(rng.randrange(7))]
             for _ in range(4000)]
    want = [library.decode(ids) for ids in lists]
    assert [codec.decode(ids) for ids in lists] == want
    assert codec.decode_many(pa.array(lists, pa.list_(pa.int32()))) == want
    with pytest.raises(ValueError, match="outside"):
        codec.decode_many(pa.array([[32000]], pa.list_(pa.int32())))


def test_a_segment_that_differs_is_noticed(codec):
    assert codec._checked({"▁the": codec.merge_many(["▁the"])[0]})
    assert not codec._checked({"▁the": codec.merge_many(["▁of"])[0]})
    many = ["▁the", "▁▁▁", "▁of", "x", "\n", "▁", "▁▁a"] + [f"▁w{i}" for i in range(40)]
    ids = dict(zip(many, codec.merge_many(many)))
    assert codec._checked(ids) and not codec._checked({**ids, "▁w7": ids["▁w8"]}) and not codec._checked({**ids, "x": ids["▁w8"]})


def test_other_kinds_of_models_are_refused(codec, monkeypatch):
    monkeypatch.setattr(SentencePieceProcessor, "get_score", lambda self, i: -1.5 - i / 7)
    with pytest.raises(ValueError, match="merge"):
        pieces.Pieces(codec.library.serialized_model_proto())


def test_memo_is_bounded_in_bytes():
    memo = Memo(100_000)
    for i in range(5000):
        memo.put(f"word{i}", b"1234")
    held = len(memo.young) + len(memo.old)
    assert held * (Memo.COST + 8) <= 110_000 and memo.get("word4999") == b"1234" and memo.get("word0") is None
    memo.put("x" * 1000, b"1")
    assert memo.get("x" * 1000) is None


def test_tables_with_nulls_ties_and_clashing_columns(spark, library):
    long = "zwischen den Zeilen " * 20000
    rows = [(1, None, 5, "x"), (1, "", 5, "y"), (None, "a b", None, None), (2, "a b", 1, "x"), (2, "a b", 1, "x"), (3, long, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, agrees string")
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t, _, _ in rows)
    assert all(r.agrees and r.decoded_agrees and r.ids[-1] == 2 for r in got)
    assert sorted(map(tuple, (r.ids for r in got))) == sorted((*library.encode(t or ""), 2) for _, t, _, _ in rows)
    assert pieces.encode(docs.where("false"), MODEL).count() == 0
    assert pieces.encode(docs, MODEL, end=False).where("doc_id = 1").select("ids").collect()[0].ids == []


def test_query_equals_the_library(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{BASE}/documents.parquet").collect():
        ids = [*library.encode(r.text or ""), 2]
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in QUERIES["op11_sentencepiece"](spark, BASE).collect()}
    assert got == want
