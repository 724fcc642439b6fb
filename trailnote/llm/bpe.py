"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The ranks are read on each executor from a path (a parameter; nothing is downloaded).
Long texts are cut at safe boundaries first, so that no call holds a huge regex or merge
state: before a single space that stands between two characters other than white space. No
alternative of the pattern matches across such a place (only a leading space may join a
word), and the part before it ends in no white space, so the look-ahead of ``\\s+(?!\\S)``
sees the same. Pieces therefore encode to the ids of the whole.

Defined cases: null text counts as empty: no ids. Special-token strings are ordinary text.
Decoding gives raw bytes, never characters, so ids that end inside a character survive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from trailnote.llm.common import mapped, packed, quoted, unpacked

#: Code points after which a text is cut at the next safe boundary.
PIECE = 100_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file: lines of base64 bytes and rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, tokenizer, size: int = PIECE) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    parts = [tokenizer.encode_to_numpy(x, disallowed_special=()) for x in pieces(text, size) if x]
    return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def _mapped(make: Callable, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.columns[-1])], [*part.schema.names[:-1], *names])

    return run


def _carried(rows: DataFrame, column: str, kind: str, make: Callable, made: DataType, name: str) -> DataFrame:
    """rows with column given to make and replaced by what it makes, under name; the other columns as they are."""
    rest = [c for c in rows.columns if c not in (column, name)]
    ready = rows.select(packed(rows, column), F.col(quoted(column)).cast(kind).alias("value"))
    schema = StructType([StructField("row", ready.schema["row"].dataType), StructField(name, made)])
    return mapped(ready, _mapped(make, [name]), schema).select(*[unpacked(c) for c in rest], name)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with text replaced by ids (array<int>)."""

    def make(texts: pa.Array) -> list[pa.Array]:
        tokenizer = encoding(path, pattern)
        ids = [encode(x.as_py() or "", tokenizer) for x in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).view(np.int32)))]

    return _carried(docs, text, "string", make, ArrayType(IntegerType()), "ids")


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with ids replaced by the raw bytes they stand for. Null ids give null."""

    def make(lists: pa.Array) -> list[pa.Array]:
        tokenizer = encoding(path, pattern)
        return [pa.array([None if x is None else tokenizer.decode_bytes(x) for x in lists.to_pylist()], pa.binary())]

    return _carried(rows, ids, "array<int>", make, BinaryType(), "bytes")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each whole text in one pass."""

    def make(texts: pa.Array) -> list[pa.Array]:
        tokenizer = encoding(path, pattern)
        counts, ids_hash, bytes_hash = [], [], []
        for x in texts:
            ids = encode(x.as_py() or "", tokenizer)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
            bytes_hash.append(hashlib.sha256(tokenizer.decode_bytes(ids.tolist())).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash)]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _mapped(make, names), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
