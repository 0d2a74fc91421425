"""Encoding of a whole corpus with a public tokenizer (byte_bpe_50k) by distinct words.

1. Blocks: each scan task cuts its texts into pre-tokens and stores, per block of documents, the block's distinct words
   and the documents' words as positions in that list (an exploded (document, position, word) table, dictionary-encoded).
2. Words: the blocks' words are shuffled by word, and each distinct word of the corpus is encoded once.
3. Ids: the encoded words go back to their blocks, and each block's documents are put together again by position.

Nothing that grows with the corpus is broadcast or collected; what is shuffled are the distinct words of each block.
Null and empty texts have the empty list of ids. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The tokenizer's \s is Unicode's White_Space; Python's adds four separator controls, so the class is spelled out.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK_CHARS = 8_000_000


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("pos", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) to rows of one block each: documents, words per document, word positions, distinct words."""
    split = _splitter()
    ids: list[int] = []
    lens: list[int] = []
    parts: list[np.ndarray] = []
    # Numbered by a counter of its own: a factory that refers to its dictionary is a cycle, and every block's words would stay.
    words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, lens, parts, chars, words
        pos = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        out = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())),
                                          pa.ListArray.from_arrays(pa.array([0, len(pos)], pa.int32()), pa.array(pos, pa.int32())),
                                          pa.array([list(words)], pa.list_(pa.string()))], schema=_BLOCK)
        ids, lens, parts, chars = [], [], [], 0
        words = defaultdict(itertools.count().__next__)
        return out

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py() or ""
            found = split(t)
            ids.append(doc)
            lens.append(len(found))
            if found:
                parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            chars += len(t) + 64
            if chars >= BLOCK_CHARS:
                yield flush()
    if ids:
        yield flush()


def word_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The dictionary-encoded (document, position, word) table, one row per block, written once to the shared folder."""
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _blocks, "ids array<bigint>, lens array<int>, pos array<int>, words array<string>")
    return cut(out.withColumn("block", F.monotonically_increasing_id()), group_rows=1)


def encode_words(words: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of distinct pre-tokens: (word) -> (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            w = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode_ordinary(x) for x in w], pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _dictionary(blocks: DataFrame, vocabulary: str, counts_only: bool) -> DataFrame:
    """Per block the encoded words in the block's own order: ``block, toks array<array<int>>`` (or lengths only)."""
    pairs = blocks.select("block", F.posexplode("words").alias("i", "word"))
    coded = encode_words(pairs.select("word").distinct(), vocabulary=vocabulary)
    if counts_only:
        coded = coded.select("word", F.size("ids").alias("ids"))
    back = pairs.join(coded, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("toks"))
    return back.select("block", F.col("toks.ids").alias("toks"))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """One row per document: its id and the list of token ids of its whole text (empty for null and empty texts)."""
    blocks = word_blocks(docs, id_col=id_col, text_col=text_col)
    toks = _dictionary(blocks, vocabulary, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, lens, pos = (b.column(c)[k].values for c in range(3))
                table = b.column(3)[k].values
                if table is None:
                    table = pa.array([], pa.list_(pa.int32()))
                n = np.asarray(lens)
                # Positions of one block at a time; the block's size is bounded by BLOCK_CHARS and one document.
                taken = table.take(pos)
                starts = np.concatenate([[0], np.cumsum(n)])
                offsets = np.asarray(taken.offsets)[starts] - taken.offsets[0].as_py()
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten())], ["doc_id", "ids"])

    joined = blocks.select("block", "ids", "lens", "pos").join(toks, "block", "left").select("ids", "lens", "pos", "toks")
    return joined.mapInArrow(run, "doc_id bigint, ids array<int>").select(F.col("doc_id").alias(id_col), F.col("ids").alias(out))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """One row per document: its id and the number of its tokens, by the same route without building the lists."""
    blocks = word_blocks(docs, id_col=id_col, text_col=text_col)
    toks = _dictionary(blocks, vocabulary, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, lens, pos = (b.column(c)[k].values for c in range(3))
                size = np.asarray(b.column(3)[k].values if b.column(3)[k].is_valid else [], np.int64)
                total = np.concatenate([[0], np.cumsum(size[np.asarray(pos)])])
                ends = np.cumsum(np.asarray(lens))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total[ends] - total[ends - np.asarray(lens)], pa.int64())], ["doc_id", "n"])

    joined = blocks.select("block", "ids", "lens", "pos").join(toks, "block", "left").select("ids", "lens", "pos", "toks")
    return joined.mapInArrow(run, "doc_id bigint, n bigint").select(F.col("doc_id").alias(id_col), F.col("n").alias(out))


def decode(ids: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The text of each list of ids: a join with the token-byte table (50,256 rows, fixed by the vocabulary)."""
    spark = ids.sparkSession
    table = F.broadcast(spark.createDataFrame([(v, bytearray(k)) for k, v in _ranks(vocabulary).items()], "token int, piece binary"))
    flat = ids.select(id_col, F.posexplode(ids_col).alias("i", "token")).join(table, "token")
    text = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", F.hex("piece").alias("h")))).alias("p"))
    text = text.select(id_col, F.decode(F.unhex(F.array_join("p.h", "")), "UTF-8").alias("text"))
    return ids.select(id_col).join(text, id_col, "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))
