import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from orbitframe.llm import bpe, mixing
from tests.llm import test_neardup, test_suffixdedup

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if k < 4:
            assert docs.columns == before.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    a, b = ({d for d, _ in rows(x)} for x in seen["toxicity"])
    assert len(toxic & b) <= 0.3 * len(toxic) and len(clean - b) <= 0.02 * len(clean)
    a, b = seen["near_duplicates"]
    assert {d for d, _ in rows(b)} == {d for d, (_, _, kept) in test_neardup.brute(rows(a)).items() if kept}
    a, b = seen["suffix_dedup"]
    assert sorted(rows(b)) == [(d, kept.decode("utf-8", "ignore")) for d, *_, kept in test_suffixdedup.brute([(d, (t or "").encode()) for d, t in rows(a)])]
    a, b = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(a).collect()}
    assert sorted(d for d, _ in rows(b)) == sorted(d for d, n in copies.items() for _ in range(n))
    a, b = seen["byte_bpe"]
    text = dict(rows(a))
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = b.collect()
    assert len(got) == a.count()
    for r in got:
        assert r.ids == enc.encode_ordinary(text[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()


def test_stages_take_nulls_and_extra_columns(spark, docs):
    more = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "id as kept", "'x' as copies", "1 as n")
    more = more.union(more.selectExpr("null", "text", "lang", "source", "n_chars", "kept", "copies", "n").where("text is null"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SF)
        if name != "byte_bpe":
            assert out.columns == more.columns and (name != "near_duplicates" or out.where("doc_id is null").count() == 1)
        assert out.count() > 0 and stage(spark, more.where("doc_id < 0"), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mix_takes_rows_without_or_with_repeated_ids_once_each(spark):
    """Many rows share a null id or one id; each still comes at most twice, and sources meet their targets."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"t{k} b c d", "en", "ab"[k % 2], 9) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, df, SF)
    found = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert out.columns == df.columns and set(found) <= {(d, t, s) for d, t, _, s, _ in rows} and max(found.values()) <= 2
    want = mixing.targets({"a": 240, "b": 240})
    for s in "ab":
        assert abs(4 * sum(n for (*_, x), n in found.items() if x == s) - want[s]) <= 4


def test_cut_repeats_keeps_replacement_characters_of_the_text(spark):
    """Passages end in letters with one lead byte, so cuts split them; the text has U+FFFD of its own."""
    passage = "".join(chr(97 + (k * k) % 26) for k in range(70))
    rows = [(1, passage + "\u00e9 a"), (2, "own \ufffd " + passage + "\u00e8 tail \ufffd"), (3, "\u00e8\ufffd")]
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, df, SF).collect()}
    assert got == {1: (rows[0][1], 73), 2: ("own \ufffd  tail \ufffd", 13), 3: ("\u00e8\ufffd", 2)}


def test_near_duplicates_go_by_rows(spark):
    """Texts of one id don't go for each other, equal rows leave one, and columns may have any names."""
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (1, other), (2, words + " tail"), (3, other), (None, words), (None, "alone one two three four five"), (None, None), (4, "same one two three four five"), (4, "same one two three four five"), (None, ""), (5, "once more")]
    df = spark.createDataFrame([(d, t, "en", "a", 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _mixed long, _copies long, _copy long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in got.collect())
    assert found == Counter([(2, words + " tail"), (3, other), (None, "alone one two three four five"), (None, None), (4, "same one two three four five"), (None, ""), (5, "once more")])
    mixed = corpus_pipeline.mix(spark, df, SF)
    assert mixed.columns == df.columns and set(map(tuple, mixed.collect())) <= set(map(tuple, df.collect()))
