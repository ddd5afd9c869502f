import re
from collections import Counter

import numpy as np

from orbitframe.llm import rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def check(df):
    want = Counter((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())
    got = rules.weak_quality(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_edge_cases(docs):
    check(docs)
    check(docs.union(docs))
    assert rules.weak_quality(docs.where("doc_id < 0")).count() == 0


def test_letters_are_no_signs():
    """Letters of any script count; emoji, curly quotes, ideographic punctuation and private characters do not."""
    for text, letters in {"aZ é ß ж 語 ひ 한 𐍈 𠀋": 10, "😀😃 “x” — × ÷ 、。 \ue000 \ufffd ½": 1, "é": 1, "": 0}.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        assert rules.features(raw, np.array([0, len(raw)]))["n_letters"].tolist() == [letters], text


def test_small_table_keeps_clean_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in check(df)}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert np.mean(good) > 0.97


def test_expectation_maximisation_finds_the_better_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    accuracy = [0.95, 0.9, 0.65]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, good = rules.fit_votes(patterns, counts.astype(float), false_alarm=1.0)
    assert abs(good - 0.7) < 0.08
    assert [abs(table[k, 1, 2] - a) < 0.06 for k, a in enumerate(accuracy)] == [True] * 3
