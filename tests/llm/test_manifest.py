import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    """Levels from the leaves to the one node left."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    steps = []
    for nodes in levels[:-1]:
        run = at - at % 8
        steps.append((nodes[run:at], nodes[at + 1 : run + 8]))
        at //= 8
    return steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[k], i) + path(top, k)
            now = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                now = leaf(r, r.text and r.text.translate({c: c + 32 for c in range(65, 91)}))
            for a, b in steps:
                now = sha(*a, now, *b)
            out.append((r.doc_id, own, trees[k][-1][0], top[-1][0], sha(*(x for a, b in steps for x in a + b)), now, now == top[-1][0]))
    return Counter(out)


def check(df):
    got = M.manifest(df, altered=(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}))
    rows = got.collect()
    assert Counter(map(tuple, rows)) == brute(df.collect())
    return rows


def test_edge_cases(docs, spark):
    check(docs)
    check(docs.where("doc_id = 4"))
    extra = spark.createDataFrame([(None, None, None, None, None, "k"), (None, "no id", "en", "s", 1, "k"), (77, "Ä <B", "", "s", 1, "k"), (77, "other", "", "s", 1, "k")], docs.schema)
    rows = check(docs.union(docs).union(extra).withColumn("tree", F.lit(1)).withColumn("_group", F.lit("x")))
    assert len(rows) == 2 * docs.count() + 4
    assert M.manifest(docs.where("doc_id < 0")).collect() == []


def test_small_table(small):
    rows = check(small.repartition(7))
    assert {r.verified for r in rows} == {True, False}


@pytest.mark.parametrize("groups", [1, 700])
def test_many_blocks_and_many_groups(spark, groups):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.format_string("g%03d", F.col("id") % groups).alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    check(df)


def test_one_row_in_bulk(spark):
    check(spark.range(1500).select(F.lit(3).cast("long").alias("doc_id"), F.lit("Same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars")))


def test_siblings_by_index():
    nodes = np.frombuffer("".join(sha(str(k)) for k in range(19)).encode(), np.uint8).reshape(-1, 64)
    got = M.siblings(nodes, np.arange(19))
    for k in range(19):
        run = k - k % 8
        assert got[k].decode() == "".join(sha(str(j)) for j in range(run, min(run + 8, 19)) if j != k)
    assert [M.tree_levels(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
