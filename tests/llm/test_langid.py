import zlib

import numpy as np

from orbitframe.llm import langid, queries


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in out]) > 0.95


def test_edge_cases(docs):
    sample = langid.training_sample(docs)
    model = langid.fit([r[0] for r in sample], [r[1] for r in sample])
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and len(got) == 11
    assert langid.identify(docs.where("doc_id < 0"), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit([], [])).collect()} == {"und"}


def test_spectra_do_not_cross_texts():
    parts = [b"abc", b"", b"xyz zy", b"9"]
    offsets = np.cumsum([0, *map(len, parts)])
    whole = langid.spectra(np.frombuffer(b"".join(parts), np.uint8), offsets)
    for row, p in zip(whole, parts):
        assert np.array_equal(row, langid.spectra(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0])


def test_rows_of_one_id_keep_their_own_text_and_language(spark):
    rows = [(3, "alpha beta", "en"), (3, "gamma delta", None), (3, "eta theta", "fr"), (4, None, "en"), (None, "no id", "en"), (5, "123", "en")] + [(7, "again and again", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {(t, g) for i, t, g in rows if i is not None and g and t and any(c.isalpha() for c in t) and zlib.crc32(str(i).encode()) % 4 != 2}
    got = [tuple(r) for r in langid.training_sample(df)]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(langid.training_sample(df, each=1)) == len({g for _, g in want})
    assert langid.training_sample(df.where("doc_id < 0")) == []
