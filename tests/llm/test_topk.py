import numpy as np

from orbitframe.llm import topk


def brute(rows, every=50, k=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), j) for m, (j, v) in enumerate(good) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in topk.top_inner_products(df, **more).select("query_id", "rank", "vec_id", "score").collect())


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "PIECE_BYTES", 2 * 24 * 5)
    monkeypatch.setattr(topk, "LANE_BYTES", 8 * 24 * 7)  # lanes of two pieces
    monkeypatch.setattr(topk, "STRIP_BLOCKS", 3)
    monkeypatch.setattr(topk, "TASKS", 5)  # several cells a task
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.lognormal(0, 0.7)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 24) for i in range(200)]  # one very common vector
    rows += [(2000, None), (2050, [1.0, None] * 12), (2100, [float("nan")] * 24), (2150, [1.0, 2.0]), (None, [1.0] * 24), (2200, [0.0] * 24), (2201, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df) == brute(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert got(df) == [(0, 1, 1, 256 * 512)]
    assert got(df.where("vec_id > 5")) == []
    assert got(df.where("vec_id = 1")) == []


def test_repeated_ids_and_large_components(spark):
    """Rows of the query's id but its own are candidates; products beyond 53 bits are exact."""
    rows = [(0, [3e6 + 1 / 256, 3e6]), (0, [3e6, 3e6 + 5 / 256]), (0, [3e6, 3e6 + 5 / 256]), (7, [3e6 + 3 / 256, -1.0]), (50, [-2.0, 1.0]), (51, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df) == brute(rows)
    assert got(df.union(df)) == brute(rows + rows)
    ints = df.selectExpr("cast(vec_id as int) as vec_id", "transform(embedding, x -> cast(x as float)) as embedding")
    assert got(ints) == brute([(r.vec_id, r.embedding) for r in ints.collect()])
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert got(huge) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
