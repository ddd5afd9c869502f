"""Operator 4: language identification by string kernels.

The kernel of two texts is the cosine of their blended spectra: which byte n-grams of 1 to 4 letters occur, hashed
into ``DIM`` places. Landmark texts span a Nyström subspace in which one-versus-rest kernel ridge regression is
solved. Kernel values against landmarks times their coefficients are linear in a text's spectrum, so that product
is taken once and texts are scored by one matrix product a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from orbitframe.llm import text as T
from orbitframe.llm.storage import Workspace

DIM = 1 << 14
SIZES = (1, 2, 3, 4)
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ANY_LETTER = regex.compile(r"\p{L}")
ROWS = 128
LONGEST = 1 << 17


def spectra(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit rows of n-gram presence for some whole texts; a text without n-grams has a zero row."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), np.float32)
    letters = _LETTERS[data].astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    grams = np.zeros(len(data), np.uint32)
    for size in range(1, max(SIZES) + 1):
        grams = (grams[: len(data) - size + 1] << np.uint32(8)) | letters[size - 1 :]
        if size in SIZES and len(grams):
            place = (grams * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B % 2**32)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - DIM.bit_length() + 1)
            inside = owner[: len(grams)] == owner[size - 1 :]
            out[owner[: len(grams)][inside], place[inside]] = 1
    norm = np.sqrt(out.sum(1, keepdims=True))
    return out / np.maximum(norm, 1)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, spectra): at most ``ROWS`` texts at a time."""
    for i, j, data, offsets in T.slices(column, 1 << 19):
        for a in range(0, j - i, ROWS):
            b = min(a + ROWS, j - i)
            yield i + a, i + b, spectra(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fit(texts: list[str], langs: list[str], landmarks: int = 320, ridge: float = 1e-2) -> tuple[list[str], np.ndarray]:
    """(languages, weights of DIM + 1 places by language) from labelled whole texts."""
    names = sorted(set(langs))
    if not names:
        return names, np.zeros((DIM + 1, 0), np.float32)
    x = np.concatenate([s for *_, s in _batches(pa.array(texts, pa.string()))])
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    each = [np.flatnonzero(np.array(langs) == name)[: -(-landmarks // len(names))] for name in names]
    marks = x[np.concatenate(each)]
    knm, kmm = (x @ marks.T).astype(float), (marks @ marks.T).astype(float)
    mean = knm.mean(0)
    centred = knm - mean
    coefficients = np.linalg.solve(centred.T @ centred + ridge * len(x) * kmm / len(marks) + 1e-8 * np.eye(len(marks)), centred.T @ (y - y.mean(0)))
    weights = marks.T.astype(float) @ coefficients
    return names, np.concatenate([weights, (y.mean(0) - mean @ coefficients)[None]]).astype(np.float32)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return (F.crc32(F.col(id_col).cast("string")) % folds == fold) & F.col(id_col).isNotNull()


def training_sample(docs: DataFrame, each: int = 300, most: int = 3000, longest: int = LONGEST) -> list:
    """At most ``each`` texts a language, ``most`` in all, outside the held-out fold, by the order of a hash of their ids.

    One pass finds the least hashes of every language; a second one fetches the texts chosen. Rows are told by id,
    language and the sha256 of the text, so rows of one id don't lend each other text or language; equal rows count
    once. Rows with a null id, text or language, and texts without a letter, are not learned from; nor are texts over
    ``longest`` bytes, which bounds what the driver gets. An empty table gives an empty list.
    """
    work = Workspace(docs.sparkSession, "langid")
    key = ["doc_id", "_lang", "_digest"]
    rows = docs.select("doc_id", F.col("lang").alias("_lang"), "text").where(F.col("_lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.octet_length("text") <= longest) & F.col("text").rlike(r"\p{L}")).withColumn("_digest", F.sha2("text", 256))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_digest"))
    least = work.save(rows.select(key).distinct().withColumn("_rank", rank).where(F.col("_rank") <= each), "least")
    langs = least.agg(F.count_distinct("_lang")).first()[0]
    chosen = least.where(F.col("_rank") <= max(1, most // max(1, langs))).orderBy("_rank", "_lang").limit(most).select(key)
    found = rows.join(F.broadcast(chosen), key).dropDuplicates(key).orderBy(key).select("text", "_lang").collect()  # at most ``most`` rows
    work.drop("least")
    return found


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of docs with ``lang_pred`` and ``lang_score`` (0 to 1) of every whole text.

    Null texts and texts without letters get ``und`` and score 0, as do all texts if nothing was learned; columns of
    those two names are replaced; repeated rows score alike; an empty table gives an empty result. Map-only.
    """
    T.small_batches(docs)
    docs = docs.drop("lang_pred", "lang_score")
    names, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIM + 1 rows by language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            column = batch.column(text_col)
            for i, j, x in _batches(column):
                seen = [bool(names) and bool(_ANY_LETTER.search(t.as_py() or "")) for t in column.slice(i, j - i)]
                if names:
                    f = 4 * (x @ shared.value[:-1] + shared.value[-1])
                    p = np.exp(f - f.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best, score = p.argmax(1), p.max(1)
                pred = [names[best[k]] if ok else "und" for k, ok in enumerate(seen)]
                sure = [float(score[k]) if ok else 0.0 for k, ok in enumerate(seen)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))
