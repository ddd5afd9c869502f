"""Operator 7: a quality classifier from weak labels.

Heuristic labellers vote on every text (see ``rules``); expectation-maximisation over all documents' vote patterns
estimates their accuracies. Posterior labels of a bounded sample (good or bad, whichever is likelier) train a linear
scorer over hashed words, hashed word shapes, shares and log counts, which then scores every whole text, also where
all labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orbitframe.llm import rules as R
from orbitframe.llm import text as T

BITS = 15
LONGEST = 1 << 17
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 97
DENSE = 10


def dense(found: dict[str, np.ndarray]) -> np.ndarray:
    """Log counts and shares of the labellers' features, about unit size; shares of defects once more on a scale that tells small ones apart."""
    n = np.maximum(found["n_words"], 1)
    share = lambda a, b: found[a] / np.maximum(b, 1)
    symbols, lines, words = share("n_symbols", n), share("n_dup_lines", found["n_lines"]), share("n_repeat_words", n)
    small = [x / (x + 0.1) for x in (symbols, lines, words)]
    return np.stack([np.log1p(found["n_words"]) / 8, np.minimum(share("word_chars", n) / 10, 3), np.minimum(symbols, 2), share("n_letters", found["word_chars"]), lines, words, (found["n_words"] < 20).astype(float), *small], 1)


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed places of words and of their endings' shapes, first word of each text)."""
    lower = T.LOWER[data]
    starts, ends, first = T.words(lower, offsets)
    word = T.span_hashes(lower, starts, ends) >> np.uint64(64 - BITS)
    shape = T.span_hashes(_SHAPE[data], np.maximum(starts, ends - 4), ends) >> np.uint64(64 - BITS)
    return np.stack([word, shape + np.uint64(1 << BITS)]).astype(np.int64), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[first[1:]] - total[first[:-1]]


def score(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1 of some whole texts; ``weights``: hashed places, then dense features, then the constant."""
    at, first = places(data, offsets)
    hashed = _sums(weights[at].sum(0), first) / np.sqrt(np.maximum(np.diff(first), 1) * 20)
    return 1 / (1 + np.exp(-(hashed + dense(R.features(data, offsets)) @ weights[2 << BITS : -1] + weights[-1])))


def train(texts: list[str | None], labels: list[float], rounds: int = 200, rate: float = 0.05) -> np.ndarray:
    """Logistic regression on labels from 0 to 1 by Adam over all sampled texts; no text at all gives scores of one half."""
    weights = np.zeros((2 << BITS) + DENSE + 1)
    y = np.array(labels, float)
    parts, solid = [], []
    base = 0
    for i, j, data, offsets in T.slices(pa.array(texts, pa.string())):
        at, first = places(data, offsets)
        count = np.diff(first)
        parts.append((np.repeat(np.arange(base, base + j - i), count), at, np.repeat(1 / np.sqrt(np.maximum(count, 1) * 20), count)))
        solid.append(dense(R.features(data, offsets)))
        base += j - i
    if not len(y):
        return weights
    owner, at, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], 1), np.concatenate([p[2] for p in parts])
    x = np.concatenate([np.concatenate(solid), np.ones((len(y), 1))], 1)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights[at].sum(0) * value, minlength=len(y)) + x @ weights[2 << BITS :]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        pull = (error[owner] * value)[None].repeat(2, 0)
        g = np.bincount(at.reshape(-1), pull.reshape(-1), minlength=2 << BITS)
        g = np.concatenate([g[: 2 << BITS], x.T @ error]) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def fit_quality(docs: DataFrame, labellers: dict[str, Column] | None = None, sample: int = 3000, longest: int = LONGEST) -> np.ndarray:
    """Vote on all documents, estimate accuracies, and train the scorer on ``sample`` texts of at most ``longest`` bytes by the order of a hash.

    A text is learned as good if its posterior probability is at least one half: soft labels near one half, which a
    single vote leaves, would teach the scorer to be undecided. Null texts vote as texts without words; rows that
    share id and text are learned once; an empty table gives weights that score everything one half.
    """
    labellers = labellers or R.default_rules()
    voted = R.rule_features(docs).withColumns(labellers).select("doc_id", *labellers)
    patterns = voted.groupBy(*labellers).count().collect()  # at most 3 ** labellers rows
    votes = np.array([[r[k] for k in labellers] for r in patterns], np.int64).reshape(-1, len(labellers))
    table, good = R.fit_votes(votes, np.array([r["count"] for r in patterns], float))
    keyed = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).select(F.xxhash64("doc_id", "text").alias("_key"), "text")
    chosen = keyed.select("_key").orderBy("_key").limit(sample).distinct()  # keys alone are compared, texts follow
    texts = [r.text for r in keyed.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"]).orderBy("_key").collect()]
    found = [R.features(data, offsets) for _, _, data, offsets in T.slices(pa.array(texts, pa.string()))]
    if not texts:
        return train([], [])
    pandas = {k: np.concatenate([f[k] for f in found]).tolist() for k in R.FEATURES}
    spark = docs.sparkSession
    small = spark.createDataFrame(list(zip(range(len(texts)), *pandas.values(), strict=True)), ["i", *R.FEATURES]).withColumns(labellers).orderBy("i").select(*labellers).collect()
    likely = R.posterior(np.array(small, np.int64).reshape(-1, len(labellers)), table, good) >= 0.5
    return train(texts, likely.astype(float).tolist())


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of docs and ``quality_score`` of every whole text.

    Null and empty texts score as texts without words; repeated rows score alike; a column of that name is replaced;
    an empty table gives an empty result. Map-only; the weights have a fixed size.
    """
    T.small_batches(docs)
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(text_col)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(score(shared.value, data, offsets), pa.float64())], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("quality_score", DoubleType())]))
