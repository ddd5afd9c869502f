import numpy as np

from orbitframe.llm import quality, queries


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op7_quality(spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.kept for r in got if label.get(r.doc_id) == 1]) > 0.98
    assert np.mean([r.kept for r in got if label.get(r.doc_id) == 0]) < 0.2


def test_edge_cases(docs):
    weights = quality.fit_quality(docs)
    got = {r.doc_id: r.quality_score for r in quality.score_quality(docs, weights).collect()}
    assert len(got) == 11 and got[0] == got[1] == got[2]
    none = docs.where("doc_id < 0")
    assert quality.score_quality(none, quality.fit_quality(none)).count() == 0
