"""Operator 6: byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are encoded one by one inside Arrow batches; a long text is first cut at safe boundaries, so the
library's regex never walks more than about ``PIECE_CHARS`` characters at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from orbitframe.llm import text as T

PIECE_CHARS = 20_000
#: A match of the pattern starts at a blank between a non-space and a letter or digit: nothing before it looks past it.
_SAFE = regex.compile(r"(?<=\S) (?=[\p{L}\p{N}])")


@lru_cache(4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _matcher(pattern: str):
    return regex.compile(pattern)


def encode(text: str, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    """Ids of one whole text, equal to tiktoken's ``encode_ordinary`` without a bound on the text's length.

    Parts between safe boundaries go to the library; a part without any boundary (one run of letters, blanks or
    symbols longer than ``piece_chars``) is split into the pattern's matches, and each match is encoded by itself.
    """
    enc = encoding(rank_file, pattern)
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > piece_chars and (cut := _SAFE.search(text, at + piece_chars)):
            end = cut.start()
        if end - at <= 2 * piece_chars:
            ids += enc.encode_ordinary(text[at:end])
        else:
            for match in _matcher(pattern).finditer(text, at, end):
                piece = match.group()
                ids += enc.encode_ordinary(piece) if len(piece) <= piece_chars else enc._encode_single_piece(piece)
        at = end
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(id, *keep, ids array<int>): token ids of every whole text; with ``decoded``, also ``raw``, the bytes that the ids decode to.

    Null and empty texts give an empty array; repeated rows are encoded each; an empty table gives an empty table.
    Other columns are dropped unless named in ``keep``, so clashing names don't matter. Map-only: no shuffle.
    """
    T.small_batches(docs)
    picked = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    schema = StructType([*docs.select(id_col, *keep).schema, StructField("ids", ArrayType(IntegerType())), *[StructField("raw", BinaryType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, _, _ in T.slices(batch.column("_text")):
                part = batch.slice(i, j - i)
                ids = [encode(x.as_py() or "", rank_file, pattern) for x in part.column("_text")]
                more = [pa.array([encoding(rank_file, pattern).decode_bytes(x) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([np.array(x, np.int32) for x in ids], pa.list_(pa.int32())), *more], schema.names)

    return picked.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, raw binary): the bytes of each id joined, also where an id is a part of a character; null ids count as none."""
    T.small_batches(encoded)
    picked = encoded.select(F.col(id_col), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [enc.decode_bytes(x.as_py() or []) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], [*part.schema.names, "raw"])

    return picked.mapInArrow(run, StructType([*picked.schema, StructField("raw", BinaryType())]))


def bpe_digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded in one pass."""
    decoded = encode_documents(docs, rank_file, pattern, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))

