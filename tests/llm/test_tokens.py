"""Encoding against the library on whole texts, and exact round trips."""

import os
import random

import pytest

from lodestrata.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary files")
ODD = [None, "", " ", "\n\n  \n", "it's we'll I'M 'S", "a  b   c    d　", "x\r\n\ty", "<|endoftext|> <|startoftext|>", "naïve Straße Ǆ ١٢٣ ½²", "日本語 한국어 👩‍💻 é", "\x1c\x1d a\x85b​c﻿", "\x00\x00", "a" * 3000, "1234567890" * 50, "!?!?...---===", "word " * 5000, "\U000e0001͸￿"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, block int")


def test_equals_the_library(spark, monkeypatch):
    rng = random.Random(1)
    letters = "abc ABC'\n\t 123 .,-é ß日 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(200)]
    enc = T._encoder(T.VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in T.encode(frame(spark, texts)).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(frame(spark, texts)).collect()}
    assert n == {i: len(ids) for i, ids in got.items()}
    back = {r["doc_id"]: r["text"] for r in T.decode(T.encode(frame(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_other_library_agrees(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = [x for x in ODD if x][:-1]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [r["ids"] for r in T.encode(frame(spark, texts)).orderBy("doc_id").collect()] == want


def test_blocks_of_any_size_and_empty_tables(spark, monkeypatch):
    texts = ["same words here", None, "same", ""] * 20
    base = {r["doc_id"]: r["ids"] for r in T.encode(frame(spark, texts)).collect()}
    assert len(base) == 80 and base[1] == [] and base[0] == base[4]
    blocks = list(T._blocks(iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(80)), "text": texts})])))
    assert len(blocks) == 1 and len(blocks[0].column("words")[0]) == 3
    assert T.encode(frame(spark, [])).count() == 0 and T.count_tokens(frame(spark, [])).count() == 0 and T.decode(T.encode(frame(spark, []))).count() == 0
    assert [r["ids"] for r in T.encode(frame(spark, [None, ""])).collect()] == [[], []]


def test_a_row_group_holds_one_block(spark):
    import glob

    import pyarrow.parquet as pq

    # the reader holds up to 4096 rows of a row group, and a block is megabytes.
    texts = spark.range(0, 3, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1600001) AS text")
    blocks = T.word_blocks(texts)
    groups = [m.row_group(i).num_rows for f in glob.glob(blocks._lodestrata_path.removeprefix("file://") + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert groups == [1, 1, 1]
    assert len(T._encoder(T.VOCABULARY).encode_ordinary("word " * 500)) == 501
    assert [r["n_tokens"] for r in T.count_tokens(texts).collect()] == [1600002] * 3


def test_words_of_written_blocks_are_freed(monkeypatch):
    import gc
    from collections import defaultdict

    import pyarrow as pa

    monkeypatch.setattr(T, "BLOCK_CHARS", 100)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [f"text number {i} " * 5 for i in range(50)]})
    gc.collect()
    gc.disable()  # workers make few objects that set the collector going, so cycles stay
    try:
        before = sum(isinstance(x, defaultdict) for x in gc.get_objects())
        assert sum(1 for _ in T._blocks(iter([batch]))) > 20
        assert sum(isinstance(x, defaultdict) for x in gc.get_objects()) <= before
    finally:
        gc.enable()
