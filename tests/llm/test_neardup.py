import re

import numpy as np
from pyspark.sql import functions as F

from orbitframe.llm import neardup
from orbitframe.llm.storage import Workspace


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n) and root(a) != root(b):
                    p, q = sorted((root(a), root(b)))
                    label[q] = p
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def check(df):
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == want


def test_edge_cases(docs):
    check(docs)


def test_small_table(small):
    check(small)


def test_larger_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_empty(docs):
    assert neardup.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_chain_of_copies_has_one_component(spark):
    """Neighbours in the chain are linked, its ends are not; exact copies of a third of the rows join in."""
    words = [f"t{i}" for i in range(400)]
    texts = [" ".join(words[k * 20 : k * 20 + 200]) for k in range(8)]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(200 + k, texts[3]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)


def test_likelihood_keeps_close_sets():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, (2, 120), dtype=np.uint64)
    both = [np.concatenate([common, x]) for x in own]
    r = neardup.registers(np.concatenate(both), np.array([0, len(both[0]), 2 * len(both[0])]))
    n = np.array([1020.0])
    assert neardup.likely(r[:1], r[1:], n, n, 0.75)[0]
    far = neardup.registers(np.concatenate([both[0], rng.integers(0, 2**63, 1020, dtype=np.uint64)]), np.array([0, 1020, 2040]))
    assert not neardup.likely(far[:1], far[1:], n, n, 0.75)[0]


def test_repeated_rows(docs):
    twice = docs.union(docs)
    assert neardup.near_duplicates(twice).where(F.col("doc_id") == 3).count() == 2


def test_fringe_of_a_large_group(spark):
    """Edited copies of one text: some link to its middle, some only to each other, some to nothing."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    rows, sibling = [(0, " ".join(base))], None
    for d in range(1, 90):
        w = list(sibling if sibling and d % 4 == 0 else base)
        for at in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            w[at] = f"n{rng.integers(10**6)}"
        sibling = w
        rows.append((d, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeated_rows_keep_the_bound_on_common_shingles(spark, monkeypatch):
    """Two texts share 88 common shingles of 100; one comes twice, or under one id with another text."""
    monkeypatch.setattr(neardup, "RARE", 5)
    base = [f"b{i}" for i in range(104)]
    x, y = (base[:-n] + [f"{s}{i}" for i in range(n)] for s, n in (("x", 10), ("y", 12)))
    rows = [(1, x), (1, x), (2, y)] + [(10 + k, base[:-12] + [f"f{k}_{i}" for i in range(200)]) for k in range(12)]
    for more in ([], [(1, [f"z{i}" for i in range(80)])]):
        df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows + more], "id long, _text string")
        reps = spark.createDataFrame([(d, len(shingle_set(" ".join(w)))) for d, w in rows[1:] + more], "id long, n long").persist()
        keyed = reps.select(F.lit(5).cast("long").alias("band"), "id").distinct()
        none = spark.createDataFrame([], "id long, label long"), spark.createDataFrame([], "a long, b long")
        repeated = df.groupBy("id").count().where("count > 1")
        got = neardup.crossing_pairs(keyed, *none, reps, df, repeated, 5, 75, Workspace(spark, "test"))
        assert (1, 2) in {(r.a, r.b) for r in got.collect()}


def test_large_group_of_repeated_rows(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            w[at] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(w))
    check(spark.createDataFrame([(d % 70, texts[d % 70]) for d in range(140 + 30)], "doc_id long, text string"))
