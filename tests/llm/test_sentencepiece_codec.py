from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brevia.llm import sentencepiece_codec as S
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return S.Codec(PATH)


def check(codec, library, texts):
    ids, at = S._encoded(codec, pa.array(texts, pa.string()))
    out, out_at = codec.decode(ids, at)
    raw = out.tobytes()
    for k, text in enumerate(texts):
        want = library.encode(text or "")
        assert ids[at[k] : at[k + 1]].tolist() == want, text
        assert raw[out_at[k] : out_at[k + 1]].decode() == library.decode(want) == (text or "").replace("▁", " ")


EDGES = ["", None, " ", "  ", "     ", "a  b", " a", "the quick\nbrown\t\tfox", "日本語テスト 😀 é", "▁a▁▁b", "x" * 300 + " y", "ab" * 3000, "<s> <0x0A> </s>", "a" + " " * 37 + "b"]


def test_ids_equal_the_library(codec, library, monkeypatch):
    draw = random.Random(1)
    texts = EDGES + ["".join(draw.choice("abcdeinorst ▁\n.,é中́😀") for _ in range(draw.randint(0, 30))) for _ in range(1000)]
    texts += ["".join(draw.choice("theanordiglsyc   ") for _ in range(draw.randint(0, 60))) for _ in range(1000)]
    check(codec, library, texts)
    monkeypatch.setattr(S, "LONG", 8)  # longer words by heap
    codec.known.forget()
    check(codec, library, texts)


def test_unigram_equals_the_library(tmp_path):
    """The same vocabulary as a unigram model: the best sum of scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    draw = np.random.default_rng(0)
    for p in model.pieces:
        if p.type == S.NORMAL:
            p.score = -float(draw.uniform(1, 20))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    other, codec = sentencepiece.SentencePieceProcessor(model_file=path), S.Codec(path)
    texts = ["the end of it all", "  a  b", "Überraschung 中文 x", "internationalisation", "a\nb"]
    ids, at = S._encoded(codec, pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [other.encode(t) for t in texts]


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in S.op2_sentencepiece(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want, have = library.encode(d.text), rows.pop(d.doc_id)
        assert have.ids == want and have.n_ids == len(want) and have.round_trip
        assert have.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert have.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    assert not rows


def test_odd_tables(spark, library):
    schema = "doc_id long, text string, ids string, n_ids int"
    docs = spark.createDataFrame([(1, t, "x", 0) for t in EDGES] + [(None, "b", None, None)], schema)
    found = S.encode_documents(docs, PATH)
    assert found.count() == len(EDGES) + 1 and found.filter("not round_trip").count() == 0
    assert S.encode_documents(docs.filter(F.lit(False)), PATH).count() == 0
    there = docs.select("text", S.ids_column(F.col("text"), PATH).alias("coded"))
    for r in there.select("text", "coded", S.text_column(F.col("coded"), PATH).alias("back")).collect():
        assert r.coded == library.encode(r.text or "") and r.back == (r.text or "").replace("▁", " ")
