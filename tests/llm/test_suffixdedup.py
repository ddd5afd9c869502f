import hypothesis
import hypothesis.strategies as st
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import suffixdedup as S


def brute(rows, length=50):
    """rows: (id, bytes); per row (n_bytes, n_removed, n_spans, kept)."""
    least = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i + 1 : i + length + 1] = True
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(b for b, g in zip(t, gone[1:-1]) if not g)))
    return sorted(out)


def check(df, length=50):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, min_len=length).collect())
    assert got == brute(rows, length)


def test_edge_cases(docs):
    check(docs)


def test_repeated_rows_and_empty(docs):
    check(docs.where("doc_id in (3, 4, 10)").union(docs.where("doc_id in (3, 4, 10)")))
    assert S.remove_repeats(docs.where("doc_id < 0")).count() == 0


def test_small_table(small):
    check(small)


def test_no_key_fills_a_chunk(spark, monkeypatch):
    """Rows without an id, rows of one id, and equal rows in bulk: chunks stay small and results are the same."""
    monkeypatch.setattr(S, "PART_BYTES", 4000)
    rng = np.random.default_rng(7)
    shared = "".join(map(chr, rng.integers(97, 123, 80)))
    rows = [((None, 7)[k % 2], f"{k} " + "".join(map(chr, rng.integers(97, 123, 60))) + shared) for k in range(120)]
    rows += [(None, "")] * 200 + [(9, "x " + shared)] * 90 + [(3, shared + " y")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k long")
    sizes, dealt = [], S._dealt

    def seen(picked, parts, *rest):
        sizes.extend(r["count"] for r in picked.groupBy(F.pmod("_row", F.lit(max(parts, 4)))).count().collect())
        return dealt(picked, parts, *rest)

    monkeypatch.setattr(S, "_dealt", seen)
    got = sorted((r.k, r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(df, keep=("k",)).collect())
    last = 10**9  # a null id counts as larger than all others
    want = brute([(last if d is None else d, t.encode()) for d, t in rows])
    assert len(got) == len(rows) and max(sizes) < 40
    assert sorted((last if d is None else d, n, r, t) for _, d, n, r, t in got) == [(d, n, r, t) for d, n, r, _, t in want]
    assert all((d, n) == (rows[k][0], len(rows[k][1])) for k, d, n, *_ in got)


@pytest.mark.parametrize("hot", [2, 2000])
def test_hot_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = np.random.default_rng(5)
    passage = "".join(map(chr, rng.integers(97, 123, 90)))
    texts = ["".join(map(chr, rng.integers(97, 123, 30))) + passage[k % 7 :] + "".join(map(chr, rng.integers(97, 101, 60))) for k in range(60)]
    rows = [(int(d), t) for d, t in zip(rng.permutation(60), texts)]
    df = spark.createDataFrame(rows + [(100, "a" * 400), (101, "a" * 300 + "é" * 40), (102, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(df).collect())
    assert got == [(d, n, kept) for d, _, n, _, kept in brute([(r.doc_id, (r.text or "").encode()) for r in df.collect()])]


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 100)
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = np.random.default_rng(6)
    long = "".join(map(chr, rng.integers(97, 123, 1500)))
    keys, want = S.string_runs(np.frombuffer(long.encode(), np.uint8), np.array([0, 1500]), 50), 1451
    assert keys[1].sum() == want
    a = S._repeated(np.frombuffer((long + long[300:700]).encode(), np.uint8), np.array([0, 1500]), np.array([1500, 400]), np.array([1, 2]), 50)
    assert [x.tolist() for x in a] == [[1], [0], [400]]


@hypothesis.settings(max_examples=60, deadline=None)
@hypothesis.given(st.lists(st.tuples(st.integers(0, 4), st.binary(min_size=5, max_size=40).map(lambda b: bytes(x % 3 for x in b))), min_size=1, max_size=6))
def test_longest_previous_factors(rows):
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    ends = np.cumsum([len(t) for _, t in rows])
    cap, at, ids = 5, [], []
    for (d, t), e in zip(rows, ends):
        at += range(e - len(t), e - 4)
        ids += [d] * (len(t) - 4)
    got = S.longest_previous_factors(data, np.array(at), np.array(ids), cap)
    raw = data.tobytes()
    for i, d, n in zip(at, ids, got):
        best = max([next((k for k in range(cap) if raw[i + k] != raw[j + k]), cap) for j, o in zip(at, ids) if o < d], default=0)
        assert n == best
