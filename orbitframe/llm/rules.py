"""Operator 10: quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a whole text. The vote patterns of all documents are
counted by Spark; expectation-maximisation over those counts estimates every rule's accuracy and the share of
good documents, and a document is kept if its posterior probability of being good reaches a threshold.
The table of patterns has at most 3 ** rules rows, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm import text as T
from orbitframe.llm.storage import Workspace

WINDOW = 8
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines")
_CHAR = np.ones(256, np.int64)
_CHAR[0x80:0xC0] = 0

def _letter_starts() -> np.ndarray:
    """1 at [first byte, second byte] of letters, told by their blocks: not punctuation, symbols, private use or emoji."""
    starts = np.zeros((256, 256), np.int64)
    starts[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE2), *range(0xE3, 0xEE)]] = 1
    starts[0xC3, [0x97, 0xB7]] = 0  # signs of multiplication and division
    starts[0xE2, 0xB0:0xB8] = 1  # U+2C00 to U+2DFF; signs lie below
    starts[0xE3, 0x80] = 0  # U+3000 to U+303F
    starts[0xEF, 0xA4:0xBC] = 1  # U+F900 to U+FEFF
    starts[0xF0, 0x90:] = 1
    starts[0xF0, 0x9F] = 0  # U+1F000 to U+1FFFF
    return starts.reshape(-1)


_LETTER = _letter_starts()


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _later_copies(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in a run of equal (owner, key) of two or more, is not the first of its run)."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True  # lexsort is stable: the first of a run stands first in the text
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of some whole texts, given as concatenated bytes."""
    n = len(offsets) - 1
    starts, ends, first = T.words(data, offsets)
    count = np.diff(first)
    inside = ~T.SPACE[data]
    out = {"n_words": count, "word_chars": _per_text(_CHAR[data] * inside, offsets), "n_symbols": _per_text(SYMBOLS[data], offsets), "n_letters": _per_text(_LETTER[(data.astype(np.uint16) << 8) | np.append(data[1:], np.uint8(0))[: len(data)]], offsets)}
    # lines: cut at \n and at the ends of texts
    newline = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], newline + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, newline, "right") - 1])
    fix = np.lexsort((line_start, owner))
    line_start, owner = line_start[fix], owner[fix]
    line_end = np.append(line_start[1:] - 1, len(data))
    last = np.append(owner[1:] != owner[:-1], True)
    line_end[last] = offsets[owner[last] + 1]
    worded = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    out["n_lines"] = np.bincount(owner[worded], minlength=n)
    line_start, line_end, owner = line_start[worded], line_end[worded], owner[worded]
    _, later = _later_copies(T.codes(data, line_start, line_end), owner)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)
    # words inside 8-word windows that a text has twice or more; numbers are equal only for equal words
    grams, word_owner = T.codes(data, starts, ends), np.repeat(np.arange(n), count)
    repeated = np.zeros(len(grams) + 1, np.int64)
    if len(grams) >= WINDOW:
        for step in (1, 2, 4):  # numbers of runs of 2, 4, then 8 words
            grams = T.joined(grams[:-step], grams[step:])
        at = np.flatnonzero(word_owner[: len(grams)] == word_owner[WINDOW - 1 :])
        many, _ = _later_copies(grams[at], word_owner[at])
        np.add.at(repeated, at[many], 1)
        np.add.at(repeated, at[many] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(word_owner[np.cumsum(repeated)[:-1] > 0], minlength=n)
    return out


def rule_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts of ``FEATURES``) of every whole text; null and empty texts count zero everywhere. Map-only."""
    T.small_batches(docs)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("_text")):
                found = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(found[k].astype(np.int64)) for k in FEATURES)], ["doc_id", *FEATURES])

    return picked.mapInArrow(run, f"doc_id {picked.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in FEATURES))


def default_rules() -> dict[str, Column]:
    """Votes by rule: 1 good, -1 bad, 0 abstains. Bad votes mark clear defects; good votes need clearly sound values."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 40),
        "word_length": vote((c("word_chars") < 2 * words) | (c("word_chars") > 20 * words), (c("word_chars") >= 3 * words) & (c("word_chars") <= 12 * words)),
        "symbols": vote(10 * c("n_symbols") > words, 50 * c("n_symbols") <= words),
        "letters": vote(2 * c("n_letters") < c("word_chars"), 4 * c("n_letters") >= 3 * c("word_chars")),
        "repeated_lines": vote(10 * c("n_dup_lines") > 3 * F.greatest(c("n_lines"), F.lit(1)), 20 * c("n_dup_lines") <= c("n_lines")),
        "repeated_words": vote(10 * c("n_repeat_words") > 3 * words, 20 * c("n_repeat_words") <= words),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 20.0, false_alarm: float = 0.01) -> tuple[np.ndarray, float]:
    """(P(vote | class) as [rule, class, vote + 1], share of good) by expectation-maximisation over counted vote patterns.

    Starts from rules that are right four times out of five; ``prior`` pseudo-documents of that belief keep the
    classes from swapping and make the fit defined for empty tables and for rules that never vote. Bad votes are for
    clear defects, so no rule is believed to cast one on more than ``false_alarm`` of good documents; without that
    bound a defect that no other rule sees would count as normal.
    """
    rules = votes.shape[1]
    belief = np.tile(np.array([[0.6, 0.25, 0.15], [0.1, 0.25, 0.65]]), (rules, 1, 1))
    table, good = belief.copy(), 0.8
    for _ in range(rounds):
        p = posterior(votes, table, good) * counts
        for k in range(3):
            hit = votes == k - 1
            table[:, 1, k] = (hit * p[:, None]).sum(0) + prior * belief[:, 1, k]
            table[:, 0, k] = (hit * (counts - p)[:, None]).sum(0) + prior * belief[:, 0, k]
        table /= table.sum(2, keepdims=True)
        excess = np.maximum(table[:, 1, 0] - false_alarm, 0)
        table[:, 1, 0] -= excess
        table[:, 1, 1:] *= 1 + (excess / table[:, 1, 1:].sum(1))[:, None]
        good = (p.sum() + prior * 0.8) / (counts.sum() + prior)
    return table, float(good)


def posterior(votes: np.ndarray, table: np.ndarray, good: float) -> np.ndarray:
    at = np.arange(votes.shape[1])
    odds = np.log(good / (1 - good)) + (np.log(table[at, 1, votes + 1]) - np.log(table[at, 0, votes + 1])).sum(1)
    return 1 / (1 + np.exp(-odds))


def weak_quality(docs: DataFrame, threshold: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """Features, base verdict, posterior quality and ``kept`` of every document.

    Rows are kept as they come (repeated ids each get a row); null texts have no words and fail the base test; an
    empty table gives an empty result. Input columns beyond the id and the text are ignored.
    """
    rules = rules or default_rules()
    counts = Workspace(docs.sparkSession, "rules").save(rule_features(docs), "features")  # numbers alone; texts are read once
    found = counts.withColumns(rules | {"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})
    patterns = found.groupBy(*rules).count().collect()  # at most 3 ** rules rows
    votes = np.array([[r[k] for k in rules] for r in patterns], np.int64).reshape(-1, len(rules))
    table, good = fit_votes(votes, np.array([r["count"] for r in patterns], float))
    weight = np.log(table[:, 1]) - np.log(table[:, 0])
    odds = reduce(lambda a, b: a + b, (F.element_at(F.array(*map(F.lit, map(float, weight[k]))), F.col(name) + 2) for k, name in enumerate(rules)), F.lit(float(np.log(good / (1 - good)))))
    return found.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*rules)
