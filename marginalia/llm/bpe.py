"""Byte-level BPE encoding and decoding by a local rank file.

``encode_documents`` gives every row's token ids; ``decode_documents`` turns
ids back into raw bytes. Long texts are cut at safe boundaries first: a space
between two characters that are not white space always begins a new match of
the pattern, so the parts' ids joined are the ids of the whole.
Null and empty texts have no ids. Rows are independent: repeated rows, ties and
extra columns change nothing, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

RANKS = "byte_bpe_50k.tiktoken"
#: A text of more characters is cut at the first safe boundary after as many.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)\x20(?=\S)")
_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoding per worker process and rank file."""
    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Whole text in parts that the pattern matches separately."""
    first = 0
    while len(text) - first > size:
        cut = _SAFE.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [encode_text(enc, t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of rows with ids; the raw bytes need not be valid UTF-8."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Round trip of every row: counts and digests of its ids and of the bytes decoded from them."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, digests, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(enc, text)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=names)

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
