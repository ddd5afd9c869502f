"""Trained operators against plain versions that go document by document, window by window and word by word."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from orbitframe.llm import langid, mixing, quality, rules, toxicity
from orbitframe.llm import text as T

SF = "/root/testdata/sf0.001"
WORD = rb"[^\x20\x09-\x0D]+"


def one_hash(data: bytes) -> int:
    return int(T.span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def test_toxicity_scores(spark, docs, small):
    """Each window of each text goes through the two networks step by step."""
    net = toxicity.fit_toxicity(small, spark.read.parquet(f"{SF}/labels.parquet"))
    p = net.p
    edge = {c for c in range(256) if not (c >= 0x80 or chr(c).isalnum())}
    rows_of = {int(h): k + 1 for k, h in enumerate(net.words)}, {int(h): k + 1 for k, h in enumerate(net.grams)}

    def embed(word):
        left, right = 0, len(word)
        while left < right and word[left] in edge:
            left += 1
        while right > left and word[right - 1] in edge:
            right -= 1
        core = word[left:right] or word
        framed = b" " + core + b" "
        out = np.zeros(2 * toxicity.WIDTH)
        out[: toxicity.WIDTH] = p["word"][rows_of[0].get(one_hash(core), 0)]
        for k in range(len(framed) - toxicity.GRAM + 1):
            gram = int(T.gram_hashes(np.frombuffer(framed[k : k + toxicity.GRAM], np.uint8), toxicity.GRAM)[0])
            out[toxicity.WIDTH :] += p["gram"][rows_of[1].get(gram, 0)]
        return out

    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = toxicity.HIDDEN

    def window(inputs):
        states = []
        for d, order in (("f", range(len(inputs))), ("b", range(len(inputs) - 1, -1, -1))):
            h, seen = np.zeros(n), {}
            for t in order:
                x, g = inputs[t] @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"h{d}"]
                z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
                new = np.tanh(x[2 * n :] + r * g[2 * n :])
                h = seen[t] = (1 - z) * new + z * h
            states.append([seen[t] for t in range(len(inputs))])
        s = np.array([np.concatenate(x) for x in zip(*states)]).reshape(-1, 2 * n)
        if not len(s):
            return float(p["bias"][0])
        weight = np.exp(np.tanh(s @ p["u"]) @ p["v"])
        return float((weight / weight.sum()) @ s @ p["o"] + p["bias"][0])

    def score(text):
        plain = bytes(toxicity._PLAIN[np.frombuffer((text or "").encode(), np.uint8)])
        inputs = [embed(w) for w in re.findall(WORD, plain)]
        starts = range(0, max(1, len(inputs) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
        return sigmoid(max(window(inputs[a : a + toxicity.WINDOW]) for a in starts))

    some = docs.select("doc_id", "text").where("doc_id <> 9").union(small.select("doc_id", "text").where("doc_id < 25 and length(text) < 3000"))
    got = toxicity.score_toxicity(some, net).collect()
    assert len(got) > 20
    for r in got:
        assert r.toxicity_score == pytest.approx(score(r.text), abs=2e-4), r.doc_id


def test_language_scores(docs, small):
    """Presence kernels of pairs of texts, ridge regression in the landmarks' space, one text at a time."""
    sample = langid.training_sample(small, each=12)
    texts, langs = [r[0] for r in sample], [r[1] for r in sample]
    names, weights = langid.fit(texts, langs, landmarks=20)

    def spectrum(text):
        data = bytes(langid._LETTERS[np.frombuffer((text or "").encode(), np.uint8)])
        found = set()
        for size in langid.SIZES:
            for k in range(len(data) - size + 1):
                gram = int.from_bytes(data[k : k + size], "big")
                x = (gram * 0x9E3779B1 + size * 0x85EBCA6B) * 0xC2B2AE3D % 2**32
                found.add(x >> (32 - 14))
        return found

    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
    sets = [spectrum(t) for t in texts]
    marks = [sets[i] for name in names for i in [k for k, x in enumerate(langs) if x == name][: -(-20 // len(names))]]
    knm = np.array([[kernel(a, m) for m in marks] for a in sets])
    kmm = np.array([[kernel(a, m) for m in marks] for a in marks])
    y = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    centre = knm.mean(0)
    c = np.linalg.solve((knm - centre).T @ (knm - centre) + 1e-2 * len(sets) * kmm / len(marks) + 1e-8 * np.eye(len(marks)), (knm - centre).T @ (y - y.mean(0)))
    more = docs.select("doc_id", "text").union(small.select("doc_id", "text").where("doc_id < 40"))
    for r in langid.identify(more, (names, weights)).collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        f = 4 * ((np.array([kernel(spectrum(r.text), m) for m in marks]) - centre) @ c + y.mean(0))
        share = np.exp(f - f.max()) / np.exp(f - f.max()).sum()
        assert r.lang_score == pytest.approx(share.max(), abs=2e-3)
        if np.sort(share)[-1] - np.sort(share)[-2] > 1e-2:
            assert r.lang_pred == names[int(share.argmax())]


def plain_features(text):
    raw = (text or "").encode()
    words = re.findall(WORD, raw)
    lines = [x for x in raw.split(b"\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    signs = [(0, 0x41), (0x5B, 0x61), (0x7B, 0xC0), (0xD7, 0xD8), (0xF7, 0xF8), (0x2000, 0x2C00), (0x2E00, 0x3040), (0xE000, 0xF900), (0xFF00, 0x10000), (0x1F000, 0x20000), (0x40000, 0x110000)]
    letter = lambda c: not any(a <= ord(c) < b for a, b in signs)
    return {"n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in b"#*$%&|<>" for c in raw), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_letters": sum(map(letter, raw.decode())), "n_lines": len(lines)}


def test_quality_rules_verdict(docs, small):
    """Expectation-maximisation over documents instead of counted patterns, in plain probabilities."""
    both = docs.select("doc_id", "text").union(small.select("doc_id", "text"))
    texts = [r.text for r in both.collect()]
    votes = []
    for t in texts:
        f = plain_features(t)
        n = max(f["n_words"], 1)
        vote = lambda bad, good: -1 if bad else 1 if good else 0
        votes.append([vote(f["n_words"] < 20, f["n_words"] >= 40), vote(not 2 * n <= f["word_chars"] <= 20 * n, 3 * n <= f["word_chars"] <= 12 * n), vote(10 * f["n_symbols"] > n, 50 * f["n_symbols"] <= n), vote(2 * f["n_letters"] < f["word_chars"], 4 * f["n_letters"] >= 3 * f["word_chars"]), vote(10 * f["n_dup_lines"] > 3 * max(f["n_lines"], 1), 20 * f["n_dup_lines"] <= f["n_lines"]), vote(10 * f["n_repeat_words"] > 3 * n, 20 * f["n_repeat_words"] <= n)])
    start = {1: {-1: 0.1, 0: 0.25, 1: 0.65}, 0: {-1: 0.6, 0: 0.25, 1: 0.15}}
    table, good = [{c: dict(start[c]) for c in (0, 1)} for _ in range(6)], 0.8

    def belief(row):
        a = good * math.prod(table[k][1][v] for k, v in enumerate(row))
        b = (1 - good) * math.prod(table[k][0][v] for k, v in enumerate(row))
        return a / (a + b)

    for _ in range(50):
        p = [belief(row) for row in votes]
        for k in range(6):
            for c in (0, 1):
                weight = {v: 20 * start[c][v] + sum((q if c else 1 - q) for q, row in zip(p, votes) if row[k] == v) for v in (-1, 0, 1)}
                table[k][c] = {v: x / sum(weight.values()) for v, x in weight.items()}
            bad = table[k][1][-1]
            if bad > 0.01:
                rest = 1 - bad
                table[k][1] = {v: 0.01 if v == -1 else x * (1 + (bad - 0.01) / rest) for v, x in table[k][1].items()}
        good = (sum(p) + 16) / (len(votes) + 20)
    want = Counter()
    for t, row in zip(texts, votes):
        f = plain_features(t)
        failed = f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]
        want[(*(f[k] for k in rules.FEATURES), failed, not failed and belief(row) >= 0.5)] += 1
    assert Counter(tuple(r[k] for k in (*rules.FEATURES, "base_failed", "kept")) for r in rules.weak_quality(both).collect()) == want


def test_quality_scores(docs, small):
    """The linear scorer word by word."""
    weights = quality.fit_quality(small.select("doc_id", "text"))
    shape = lambda w: bytes(quality._SHAPE[np.frombuffer(w, np.uint8)])
    for r in quality.score_quality(docs.select("doc_id", "text").where("doc_id <> 9").union(small.select("doc_id", "text").where("doc_id < 30 and length(text) < 4000")), weights).collect():
        raw = (r.text or "").encode()
        f = plain_features(r.text)
        n = max(f["n_words"], 1)
        total = weights[-1] + sum(w * x for w, x in zip(weights[2 << quality.BITS : -1], (math.log1p(f["n_words"]) / 8, min(f["word_chars"] / n / 10, 3), min(f["n_symbols"] / n, 2), f["n_letters"] / max(f["word_chars"], 1), f["n_dup_lines"] / max(f["n_lines"], 1), f["n_repeat_words"] / n, f["n_words"] < 20, *(x / (x + 0.1) for x in (f["n_symbols"] / n, f["n_dup_lines"] / max(f["n_lines"], 1), f["n_repeat_words"] / n)))))
        hashed = 0.0
        for w in re.findall(WORD, raw):
            low = bytes(T.LOWER[np.frombuffer(w, np.uint8)])
            hashed += weights[one_hash(low) >> (64 - quality.BITS)] + weights[(one_hash(shape(w)[-4:]) >> (64 - quality.BITS)) + (1 << quality.BITS)]
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-(total + hashed / math.sqrt(n * 20)))), abs=1e-9)


def test_mixture_copies(small):
    """The multiplier of each source by bisection over its documents, then whole copies by size, largest first."""
    rows = [(r.source, len(re.findall(WORD, (r.text or "").encode()))) for r in small.collect()]
    words = Counter()
    for s, n in rows:
        words[s] += n
    want = mixing.targets(dict(words))
    got = Counter()
    for r in mixing.mix_sources(small, keep=("source",)).collect():
        got[r.source, r.size] += r.copies
        assert r.target == pytest.approx(want[r.source]) and r.source_size == words[r.source] and r.taken == r.copies * r.size <= 2 * r.size
    for s in words:
        sizes = Counter(n for x, n in rows if x == s)
        if want[s] >= 2 * words[s] * (1 - 1e-9):
            rate = lambda n: 2.0
        else:
            low, high = -1.0, 1.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(k * n * min(2, math.exp(min(mid * n, 50))) for n, k in sizes.items()) < want[s] else (low, mid)
            rate = lambda n: min(2.0, math.exp(min(low * n, 50)))  # noqa: E731, B023
        error, taken = 0.0, 0
        for n in sorted(sizes, reverse=True):
            due = sizes[n] * rate(n) + (error / n if n else 0)
            whole = min(max(math.floor(due + 0.5), 0), 2 * sizes[n]) if n else sizes[n]
            error = (due - whole) * n
            taken += whole * n
            assert abs(got[s, n] - whole) <= 1, (s, n)
        assert abs(sum(k * n for (x, n), k in got.items() if x == s) - taken) <= max(sizes)
    assert sum(got.values()) > 0
