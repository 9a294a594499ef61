from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brevia.llm import token_output as S
from brevia.llm.textkit import text_bytes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def want(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, S.END]


def check(library, encoder, texts):
    ids, at = encoder.encode(*text_bytes(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == want(library, text), text


def test_ids_equal_the_library(library, monkeypatch):
    draw = random.Random(1)
    signs = ["'", "s", "re", "ll", "v", "e", " ", "  ", "\n", "\t", "a", "1", "!", "é", "　", "\xa0", "中", "😀", "d", "m", "t", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["", None, "don't 's 's''s  's\t's\n\n a  b", "x  ", "  ", "\n", "'ll'llx 're're 'RE 'v", "<|endoftext|> a", "123abc 4 5", "a" * 20_000]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    check(library, S.Encoder(PATH), texts)
    monkeypatch.setattr(S, "MOST_PIECES", 50)  # pieces are forgotten and learnt anew
    encoder = S.Encoder(PATH)
    check(library, encoder, texts[:200])
    check(library, encoder, texts[200:300])


def test_classes_equal_the_library(library):
    encoder = S.Encoder(PATH)
    every = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000][::7]
    for k in range(0, len(every), 2000):
        text = "\n".join(f"a{chr(c)}1{chr(c)}!" for c in every[k : k + 2000])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found = S.piece_starts(points, encoder.kind(points), np.array([0, len(points)]))
        assert found.tolist() == [x[1][0] for x in library.pre_tokenizer.pre_tokenize_str(text)]


def test_query_equals_brute_force(spark, sf_dir, library):
    found = {r.doc_id: r for r in S.op9_token_output(spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = want(library, r.text)
        have = found[r.doc_id]
        assert (have.start, have.n_tokens, have.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files(spark, sf_dir, library, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PAGE_ROWS", 10)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = str(tmp_path / "ids")
    S.write_ids(S.encode_documents(docs, PATH), to)
    part = next((tmp_path / "ids").glob("part-00000*.parquet"))
    group = pq.ParquetFile(part).metadata.row_group(0)
    by_name = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and by_name["ids.list.element"].has_dictionary_page
    assert all(c.has_offset_index and c.has_column_index for c in by_name.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = S.read_ids(spark, to, 20, 29)
    assert {r.doc_id: r.ids for r in some.collect()} == {k: want(library, texts[k]) for k in range(20, 30)}
    plan = some.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "ids:" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_odd_tables(spark, tmp_path, library):
    schema = "doc_id long, text string, ids string, n_tokens int, file string, start int"
    docs = spark.createDataFrame([(5, "b", "", 0, "", 0), (None, "z z", "", 0, "", 0), (5, "a a", "", 0, "", 0), (1, None, "", 0, "", 0), (5, "a a", "", 0, "", 0)], schema)
    for k, frame in enumerate((docs, docs.filter(F.lit(False)))):
        to = str(tmp_path / f"ids{k}")
        S.write_ids(S.encode_documents(frame, PATH), to)
        rows = S.digest(spark, to).orderBy("start").collect()
        assert [r.doc_id for r in rows] == ([None, 1, 5, 5, 5] if not k else [])
        if rows:
            assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
            assert [r.n_tokens for r in rows] == [len(want(library, t)) for t in ("z z", None, "a a", "a a", "b")]


def test_added_tokens_equal_the_library_by_default(spark):
    plain, draw = Tokenizer.from_file(PATH), random.Random(4)
    signs = ["'", "s", " ", "  ", "\n", "a", "1", "!", "中", "<|endoftext|>", "<|endoftext|>", "<|endo", "text|>"]
    texts = ["<|endoftext|>", "a <|endoftext|> b", "don'<|endoftext|>t  <|endoftext|><|endoftext|>", "<|endoftext|", ">", "", None]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    check(plain, S.Encoder(PATH, added=True), texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(list(r.ids) == want(plain, texts[r.doc_id]) for r in S.encode_documents(docs, PATH).collect())


def test_pieces_are_told_apart_by_bytes_or_by_the_library(library):
    texts = ["don't 's 中😀  é\n\n a  b x123 " * 3, "naïve — “quoted” ½ ⅷ", "<|endoftext|> a"]
    fast, slow = S.Encoder(PATH), S.Encoder(PATH)
    slow.spans[:] = 0  # bytes that don't add up
    for text in texts:
        data = text_bytes(pa.array([text]))
        assert fast.encode(*data)[0].tolist() == slow.encode(*data)[0].tolist() == want(library, text)
