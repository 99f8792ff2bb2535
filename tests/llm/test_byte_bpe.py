"""Byte-level BPE against the library, on whole tables, planted edge cases and random texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, queries

R = random.Random(13)
PARTS = ["a", "the", "s", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "1", "23", ",", "!?", "<|endoftext|>", "<|endo", "ftext|>", "é", "é", "×", "ß", "İ", "日本", "　", " ", "\u0085", " ", "​", "﻿", "😀", "Я", "२", "½", "\x1c", "\0", "᠎"]
TEXTS = [None, "", " ", "  \n ", "a", "It's 12,50!", "<|endoftext|>", "<|endo", "ftext|> x", "two  spaces\n\nand\tmore \n", "x" * 30_000, "word " * 30_000, "日本語。" * 2000, "a<|endoftext|><|endoftext|> b", "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    return byte_bpe.byte_tokenizer(None).library


def wanted(library, doc, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_cut_words_give_the_ids_of_whole_texts(library):
    codec = byte_bpe.byte_tokenizer(None)
    texts = ["".join(R.choice(PARTS) for _ in range(R.randrange(16))) for _ in range(20_000)]
    words, counts = codec.words(pa.array(texts, pa.large_string()))
    ids = iter(codec.encode(words.to_pylist()))
    for text, n, want in zip(texts, counts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b"".join(next(ids) for _ in range(n)), "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize(("slice_bytes", "bucket_words"), [(8 << 20, 200_000), (64, 3)])
def test_round_trip(spark, library, monkeypatch, slice_bytes, bucket_words):
    rows = [(i, t, "s", i) for i, t in enumerate(TEXTS)] + [(None, "no id, twice", "s", 0)] * 2 + [(3, "repeated id", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string, n_words int").repartition(3)
    monkeypatch.setattr(byte_bpe, "_BUCKET_WORDS", bucket_words)
    monkeypatch.setattr(byte_bpe, "_SLICE_BYTES", slice_bytes)
    got = byte_bpe.round_trip(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted((wanted(library, r[0], r[1]) for r in rows), key=str)
    assert byte_bpe.round_trip(docs.where("false")).count() == 0


def test_slices_hold_whole_documents(monkeypatch):
    assert byte_bpe._unpacked(byte_bpe._packed(np.array([0, 1, 70_000, 2**32 - 1]))).tolist() == [0, 1, 70_000, 2**32 - 1]
    assert byte_bpe._unpacked(byte_bpe._packed(np.zeros(0, np.int64))).tolist() == []


def test_encode_then_decode(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs).collect()}
    assert ids == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    # half a character, an id outside the vocabulary, nulls
    lists = [(1, [50256, 464]), (2, [161, 161]), (3, [464, 99_999, -4, 464]), (4, None), (5, []), (6, [None, 464])]
    got = dict(byte_bpe.decode(spark.createDataFrame(lists, "doc_id long, ids array<int>")).collect())
    assert got == {1: "<|endoftext|>The", 2: library.decode([161, 161]), 3: "TheThe", 4: None, 5: "", 6: "The"}


def test_pieces_cover_the_vocabulary(spark, library):
    table = byte_bpe.pieces(spark)
    assert table.count() == table.select(F.countDistinct("id")).first()[0] == library.get_vocab_size()


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op13_byte_bpe"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(wanted(library, d, t) for d, t in docs)
