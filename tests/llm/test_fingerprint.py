import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import fingerprint as P
from orbitframe.llm import queries


def hashes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    key = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16)
    return sorted((P.FACTORS[0] + sum(f * key(s) for f, s in zip(P.FACTORS[1:], g))) % 2**64 for g in grams)


def kept(h):
    return [x for k, x in enumerate(h) if x < 2**61 or k < 16]


def near(a, b):
    if not a:
        return float(not b)
    bound = min(2**64 if len(x) < 16 else max(2**61 - 1, x[-1]) for x in (a, b))
    a, b = [x for x in a if x <= bound], {x for x in b if x <= bound}
    return sum(x in b for x in a) / len(a) if a else 0.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        a, b, c = kept(hashes(t)), kept(hashes(edited)), kept(hashes(n))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b), near(a, b), near(a, c)))
    return Counter(out)


def check(df):
    got = P.compare_edits(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(map(tuple, got.collect())) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_edge_cases(docs, spark):
    check(docs)
    check(docs.where("doc_id = 5"))
    check(docs.union(docs).union(spark.createDataFrame([(None, "a b"), (None, "c d e f g h"), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "'z' as id")))
    assert P.compare_edits(docs.where("doc_id < 0")).count() == 0


def test_small_table_over_many_ranges(spark, small):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        check(small.repartition(5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query_gives_each_document_once(spark):
    got = queries.op11_fingerprint(spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("doc_id").distinct().count() == 200


def test_written_fingerprints_merge_and_compare(spark):
    words = [f"w{k}" for k in range(4000)]
    texts = ["", "one two", " ".join(words[:12]), " ".join(words[:60]), " ".join(words[:2000]), " ".join(words[1000:3000]), " ".join(words)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    f = P.fingerprint(rows.withColumn("fingerprint", F.lit("old"))).select("k", "fingerprint")
    pairs = f.crossJoin(f.withColumnsRenamed({"k": "j", "fingerprint": "g"}))  # seven rows
    for r in pairs.select("*", P.merge(F.col("fingerprint"), F.col("g")).alias("m"), P.containment(F.col("fingerprint"), F.col("g")).alias("c")).collect():
        a, b = hashes(texts[r.k]), hashes(texts[r.j])
        assert r.m == "".join(f"{x:016x}" for x in kept(sorted({*a, *b})))
        assert r.c == pytest.approx(near(kept(a), kept(b)))
        if len(a) > 1000 and len(b) > 1000:
            assert abs(r.c - len({*a} & {*b}) / len(a)) < 0.1  # four standard deviations


def test_long_text_and_invalid_bytes():
    long = "Ärger über alles mögliche und noch mehr dazu " * 60_000
    assert [x.tolist() for x in P.sketches(pa.array([long, None, "a"]))] == [kept(hashes(t)) for t in (long, "", "a")]
    assert P._texts(pa.array([b"a\xff", None])) == ["a�", ""]
