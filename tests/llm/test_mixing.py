import re

import pytest
from pyspark.sql import functions as F

from orbitframe.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(df, near):
    rows = df.select("doc_id", "text", "source").collect()
    got = mixing.mix_sources(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    of = {r.doc_id: r.source for r in rows}
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
    want = mixing.targets(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert r.size == size(next(x.text for x in rows if x.doc_id == r.doc_id)) and r.source_size == totals[of[r.doc_id]]
        assert r.target == pytest.approx(want[of[r.doc_id]]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[of[r.doc_id]] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= near(totals[s])
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    return got


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets({"a": 0}) == {"a": 0} and mixing.targets({}) == {}
    t = mixing.targets({"a": 10, "b": 500, "c": 20, "d": 90})
    assert sum(t.values()) == pytest.approx(930) and t["a"] == 20


def test_small_table(small):
    check(small, lambda n: 40 + 0.01 * n)


def test_edge_cases(docs):
    check(docs.withColumn("text", F.when(F.col("doc_id") == 9, F.lit("x y")).otherwise(F.col("text"))), lambda n: 400)
    assert mixing.mix_sources(docs.where("doc_id < 0")).count() == 0


def test_repeated_rows_and_one_hot_size(spark):
    df = spark.range(600).select((F.col("id") % 500).alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") < 400, "hot").otherwise("b").alias("source"))
    got = mixing.mix_sources(df)
    by = {r.source_size: (r.t, r.g) for r in got.groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    assert got.count() == 600 and all(abs(t - g) <= 5 for t, g in by.values())
