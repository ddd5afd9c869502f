import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitframe.llm import infilling as M


def brute(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return n, form, len(a), len(b), out


def check(df):
    made = M.fill_in_middle(df)
    got = made.select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "text", M.restored(F.col("text"), F.col("form")).alias("back"))
    want = Counter((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in df.select("doc_id", "text").collect())
    assert Counter(map(tuple, got.collect())) == want
    return made


def test_edge_cases(docs, spark):
    more = [(None, "a<P>b"), (None, "no id"), (11, "<"), (12, "<P"), (13, ">S<S>"), (14, "a" * 300_000), (15, "é" * 200_000 + "x"), (16, "\n\r <S"), (17, "日本 \U0001f600 <P <S> no")]
    rows = spark.createDataFrame(more, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "'z' as id")
    made = check(docs.union(docs).union(rows).withColumn("form", F.lit("old")))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "n_units", "form", "prefix_chars", "middle_chars"]
    assert M.fill_in_middle(docs.where("doc_id < 0")).count() == 0


def test_small_table(small):
    forms = Counter(r.form for r in check(small).collect())
    assert forms["psm"] > forms["spm"] > 0 and forms["plain"] > 0


@given(st.text("ab<é😀 \n", max_size=200), st.integers(1, 9))
def test_checkpoints_find_every_unit(text, every):
    data = np.frombuffer(text.encode(), np.uint8)
    spans = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    index = M.Checkpoints.of(data, every)
    assert (index.n_units, index.n_chars, len(index.units)) == (len(spans), len(text), -(-len(spans) // every))
    for k, at in enumerate([*spans, len(text)]):
        assert index.find(data, k) == (len(text[:at].encode()), at)


def test_checkpoints_cross_windows(monkeypatch):
    monkeypatch.setattr(M, "WINDOW", 7)
    text = "abcdefghijklmnop é日 x" * 9
    data = np.frombuffer(text.encode(), np.uint8)
    spans = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    index = M.Checkpoints.of(data, 4)
    assert [index.find(data, k) for k in range(len(spans) + 1)] == [(len(text[:a].encode()), a) for a in [*spans, len(text)]]
