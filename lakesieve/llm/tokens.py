"""Problem 6: encoding of the whole corpus with a public byte-level BPE.

Method. tiktoken with a local rank file, loaded once per Python worker. Long texts are cut before encoding at
places where the splitting pattern always ends a piece (a blank after a character that is no blank), so the
ids are those of the whole text. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files unless another is given.
VOCABULARIES = os.environ.get("LAKESIEVE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which on a text is encoded in parts of about that length.
PART_CHARS = 1 << 16


def rank_file(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of ``text`` whose encodings, joined, are the encoding of the text.

    A cut is made before a space or line feed that follows a character that is no blank; no piece of the
    pattern spans such a place and the pattern does not look behind. Where none comes, the part stays long.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        if cut >= n:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str | None, enc: tiktoken.Encoding) -> list[int]:
    """Ids without special tokens; empty for null and empty texts. Strings of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], enc: tiktoken.Encoding) -> str:
    """The text of ids, by joining the tokens' raw bytes."""
    return enc.decode_bytes(ids).decode("utf-8", errors="replace")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.array(encode(t, enc), dtype=np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of every row's text, in full; an empty list for null and empty texts.

    A row with a null id keeps it; repeated rows come out as often as they are. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_encoder(path or rank_file()), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(encode(t, enc)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, tokens): the number of ids of every row's text; 0 for null and empty texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_counter(path or rank_file()), f"id {kind}, tokens long").withColumnRenamed("id", id_col)


def decoded(encodings: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_col, text) of (id_col, ids); an empty text for an empty list, null for null."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = [None if ids is None else decode(ids, enc) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encodings.schema[id_col].dataType.simpleString()
    return encodings.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
