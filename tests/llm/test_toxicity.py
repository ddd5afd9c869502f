import zlib

import numpy as np

from orbitframe.llm import queries, text as T, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in label]
    toxic = [r.predicted for r in out if label[r.doc_id]]
    # some of these labels are wrong: such texts hold none of the words that mark all others
    assert np.mean(toxic) > 0.85 and np.mean([r.predicted for r in out if not label[r.doc_id]]) < 0.03


def test_edge_cases(spark, docs):
    net = toxicity.train(["you idiot " + "of the " * 20, "of the and " * 20] * 8, [1, 0] * 8)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score_toxicity(docs, net).collect()}
    assert len(got) == 11 and got[0] == got[1] == got[2] and all(0 <= x <= 1 for x in got.values())
    assert toxicity.score_toxicity(docs.where("doc_id < 0"), net).count() == 0
    empty = toxicity.fit_toxicity(docs.where("doc_id < 0"), docs.where("doc_id < 0").selectExpr("doc_id", "1 as toxic"))
    assert all(r.toxicity_score < 0.5 for r in toxicity.score_toxicity(docs, empty).collect())


def test_windows_overlap_and_cover():
    index, owner = toxicity.windows(np.array([0, 40, 40, 43]), np.arange(43))
    assert owner.tolist() == [0, 0, 0, 0, 1, 2]
    for k, (a, b) in enumerate([(0, 40), (40, 40), (40, 43)]):
        part = index[owner == k]
        assert set(part[part >= 0]) == set(range(a, b))
    assert index[1].tolist() == list(range(8, 24))


def test_gradient():
    net = toxicity.train([], [])
    rng = np.random.default_rng(0)
    x, index = rng.normal(size=(30, 2 * toxicity.WIDTH)).astype(np.float64), np.array([[*range(16)], [*range(10, 20), *[-1] * 6]])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, gx = net.run(x, index, back=True)[1](np.array([1.0, -0.5]))
    value = lambda: float(net.run(x, index) @ [1.0, -0.5])
    for p, d in [*((net.p[k], g[k]) for k in g), (x, gx)]:
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        high = value()
        p[at] = old - 1e-5
        low = value()
        p[at] = old
        assert abs((high - low) / 2e-5 - d[at]) < 2e-3 * max(1, abs(d[at]))


def test_embedding_ignores_outer_punctuation():
    data = b"idiot, idiot. (IDIOT) idiots"
    w = toxicity.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert w.at[0] == w.at[1] == w.at[2] != w.at[3]
    assert len(T.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]) == 4
