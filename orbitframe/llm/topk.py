"""Operator 8: exact top-k inner products over vectors sorted by length.

Components become floor(scale * x). Vectors are packed into blocks of falling length and rotated into the eigenvectors
of their second moments, so the first coordinates carry most of a product. The block of the longest vectors gives
each query a lower bound for its k-th score; bound and length of a query say how long a vector must be to matter
(Cauchy-Schwarz). Runs of blocks are strips, runs of queries in order of that need are lanes. A strip meets a lane if
its longest vector is long enough for the lane's easiest query: these cells, a row each, are the joins through which
Spark brings blocks and queries together, all in one job. A task holds the queries of one cell and streams its blocks,
longest first: partial sums over the first coordinates plus the product of the residual lengths rule out most vectors;
the rest are scored exactly in integers and raise the bounds for the blocks that follow.

With n vectors and m queries, blocks move once a lane and queries once a strip: about 2 * n * m / (lane * strip) packed
pieces for lanes and strips of a fixed size, less what the bounds rule out. Components travel in the narrowest integers
that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import text as T
from orbitframe.llm.storage import Workspace

BLOCK, QUERY_BLOCK, HEAD = 4096, 256, 16
PIECE_BYTES = 1 << 20  # of components in one packed row
LANE_BYTES = 8 << 20  # of 64-bit components of the queries that a task holds
STRIP_BLOCKS = 256  # blocks that a task streams for them
TASKS = 1 << 15  # partitions of the cells at most; beyond, tasks take several cells one after another
_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score falling, id rising) for each query."""
    order = np.lexsort((ids, ~score, query))
    query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(query, query)
    return order[rank < k]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers; those beyond 64 bits stop at the largest or smallest of 64 bits."""
    if np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * a.shape[1] < 2.0**62:
        return np.einsum("nd,nd->n", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


class Side:
    """Vectors with their lengths, their leading coordinates after rotation, and the lengths of the rest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, basis: np.ndarray):
        self.rows, self.ids, self.v = rows, ids, v
        turned = v.astype(float) @ basis
        self.head, self.rest = turned[:, :HEAD].copy(), np.sqrt((turned[:, HEAD:] ** 2).sum(1))
        self.length = np.sqrt((turned**2).sum(1))


def search_block(q: Side, bound: np.ndarray, v: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, place of vector, score) of up to k best of one block for each query, none below the query's bound."""
    found = [(np.empty(0, np.int64),) * 3]
    longest = v.length.max(initial=0) * (1 + 1e-9) + 1e-6
    for low in range(0, len(q.rows), QUERY_BLOCK):
        some = low + np.flatnonzero(q.length[low : low + QUERY_BLOCK] * longest + 1e-6 >= bound[low : low + QUERY_BLOCK])
        if not len(some):
            continue
        most = q.head[some] @ v.head.T
        most += np.outer(q.rest[some], v.rest)
        most += np.outer(1e-9 * q.length[some], v.length) + 1e-6
        i, j = np.nonzero(most >= bound[some][:, None])
        own = q.rows[some[i]] != v.rows[j]
        i, j = some[i[own]], j[own]
        score = np.concatenate([np.empty(0, np.int64), *(exact_products(q.v[i[at : at + (1 << 14)]], v.v[j[at : at + (1 << 14)]]) for at in range(0, len(i), 1 << 14))])
        good = score >= bound[i]
        i, j, score = i[good], j[good], score[good]
        top = _best(i, v.ids[j], score, k)
        found.append((i[top], j[top], score[top]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


class Best:
    """The k best found so far for each query of a piece, and the bounds that follow."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k = bound.copy(), k
        self.query, self.row, self.id, self.score = (np.empty(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.query, self.row, self.id, self.score = (np.concatenate(x) for x in ((self.query, query), (self.row, row), (self.id, ids), (self.score, score)))
        top = _best(self.query, self.id, self.score, self.k)
        self.query, self.row, self.id, self.score = self.query[top], self.row[top], self.id[top], self.score[top]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.bound)) == self.k)
        last = self.score[np.searchsorted(self.query, full, "right") - 1]
        self.bound[full] = np.maximum(self.bound[full], _below(last))


def _below(score: np.ndarray) -> np.ndarray:
    """A float that is no larger."""
    x = score.astype(float)
    return x - np.abs(x) * 2.0**-50


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    size = np.diff(column.offsets.to_numpy())
    out[np.repeat(np.arange(len(column)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrowest(least: int, most: int) -> np.dtype:
    return next(np.dtype(t) for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)


def _pack(rows: DataFrame, dim: int, size: int, kind: np.dtype) -> DataFrame:
    """(block, ids, data, longest): blocks of up to ``size`` vectors in the order and partitions of ``rows`` (vec_id, v).

    A block's number is 2**24 times that of its partition and counts on from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = _matrix(part.column("v"), dim)
                longest = float(np.sqrt((v.astype(float) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([v.astype(kind).tobytes()], pa.binary()), pa.array([longest])], ["block", "ids", "data", "longest"])
                number += 1

    return rows.select("vec_id", "v").mapInArrow(run, "block long, ids binary, data binary, longest double")


def _integers(data: bytes, dim: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.int64)


def _numbers(block: int, count: int) -> np.ndarray:
    """Row numbers of a block."""
    return block * BLOCK + np.arange(count)


def _unpack(batches: Iterator[pa.RecordBatch], dim: int, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, vectors) of packed blocks."""
    for batch in batches:
        for block, ids, data in zip(*(batch.column(c) for c in ("block", "ids", "data")), strict=True):
            ids = np.frombuffer(ids.as_py(), np.int64)
            yield _numbers(block.as_py(), len(ids)), ids, _integers(data.as_py(), dim, kind)


def moments(blocks: DataFrame, dim: int, kind: np.dtype) -> np.ndarray:
    """The sum of outer products: one dim x dim matrix a partition, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for _, _, v in _unpack(batches, dim, kind):
            total += v.T.astype(float) @ v.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.reshape(-1))], ["i", "j", "x"])

    out = np.zeros((dim, dim))
    for i, j, x in blocks.select("block", "ids", "data").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = x
    return out


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of each vector whose id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; shorter
    vectors count as padded with zeros. A query never meets its own row, but other rows of its id; repeated rows count
    each, as queries too. Ties go to the smaller id; with fewer candidates all come; an empty table gives an empty
    result. Products are exact; components and products stop at the bounds of 64 bits.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    component = lambda c: F.greatest(F.least(F.floor(scale * c.cast("double")).cast("double"), F.lit(2.0**63 - 1024)), F.lit(-(2.0**63))).cast("long")
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, component).alias("v"))
    n, dim, least, most = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    T.small_batches(vectors)
    dim = max(dim, 1)
    kind = _narrowest(min(least or 0, 0), max(most or 0, 0))
    size = max(1, min(BLOCK, PIECE_BYTES // (kind.itemsize * dim)))
    strip = max(1, min(STRIP_BLOCKS, n // (size * 4 * spark.sparkContext.defaultParallelism)))  # blocks
    strips = -(-n // (size * strip))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    ordered = rows.withColumn("length", length).repartitionByRange(strips, F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
    blocks = work.save(_pack(ordered, dim, size, kind), "blocks")
    values, basis = np.linalg.eigh(moments(blocks, dim, kind))
    basis = basis[:, ::-1].copy()
    head = blocks.orderBy(F.desc("longest"), "block").limit(1).collect()[0]  # one block
    first = spark.sparkContext.broadcast((basis, head.block, bytes(head.ids), bytes(head.data)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with bounds from the first block, and the least length of vectors that may beat them."""
        basis, block, ids, data = first.value
        ids = np.frombuffer(ids, np.int64)
        v = Side(_numbers(block, len(ids)), ids, _integers(data, dim, kind), basis)
        for row, ids, data in _unpack(batches, dim, kind):
            pick = ids % every == 0
            q = Side(row[pick], ids[pick], data[pick], basis)
            best = Best(np.full(len(q.rows), -np.inf), k)
            i, j, score = search_block(q, best.bound, v, k)
            best.add(i, v.rows[j], v.ids[j], score)
            need = np.where(best.bound > 0, best.bound / np.maximum(q.length, 1e-300) * (1 - 1e-9), 0)  # a bound of 0 or less asks for all
            yield pa.RecordBatch.from_arrays([pa.array(q.rows), pa.array(q.ids), pa.array([r.tobytes() for r in q.v.astype(kind)], pa.binary()), pa.array(best.bound), pa.array(need)], ["row", "id", "v", "bound", "need"])

    lane = max(1, LANE_BYTES // (8 * dim))  # queries
    lanes = -(-n // (every * lane))
    by_need = blocks.select("block", "ids", "data").mapInArrow(ask, "row long, id long, v binary, bound double, need double").repartitionByRange(lanes, F.desc("need"), "row").sortWithinPartitions(F.desc("need"), "row")

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, 0  # a lane, and how much of it is taken
        most = max(1, PIECE_BYTES // (kind.itemsize * dim))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if held == lane:
                    number, held = number + 1, 0
                part = batch.slice(at, min(most, lane - held))
                at, held = at + part.num_rows, held + part.num_rows
                joined = [part.column(c).to_numpy().tobytes() for c in ("row", "id", "bound")] + [b"".join(part.column("v").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in joined), pa.array([part.column("need").to_numpy().min()])], ["lane", "row", "id", "bound", "v", "need"])

    queries = work.save(by_need.mapInArrow(pack_queries, "lane long, row binary, id binary, bound binary, v binary, need double"), "queries")
    # blocks of a strip: a partition as a rule, cut where equal lengths made it longer than twice its share
    strip_of = F.shiftright("block", 24) * 2**24 + F.floor(F.col("block").bitwiseAND(2**24 - 1) / (2 * strip))
    blocks = blocks.withColumn("strip", strip_of)
    cells = blocks.groupBy("strip").agg(F.max("longest").alias("longest")).join(queries.groupBy("lane").agg(F.min("need").alias("least")), F.col("longest") >= F.col("least")).select("strip", "lane", F.col("longest").alias("reach"), "least")
    nothing, none = F.lit(None).cast("binary"), F.lit(None).cast("long")
    asking = queries.join(cells, "lane").where(F.col("need") <= F.col("reach")).select("strip", "lane", none.alias("block"), F.col("id").alias("ids"), F.col("v").alias("data"), "row", "bound")
    asked = blocks.join(cells, "strip").where(F.col("longest") >= F.col("least")).select("strip", "lane", "block", "ids", "data", nothing.alias("row"), nothing.alias("bound"))
    tasks = min(strips * lanes, TASKS)
    place = F.pmod(F.shiftright("strip", 24) * lanes + F.shiftright("lane", 40), F.lit(tasks)).cast("int")  # cells of one strip and lane partition share a task
    met = asking.union(asked).repartitionById(tasks, place).sortWithinPartitions("strip", "lane", F.asc_nulls_first("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query in each cell; a cell's queries come first, then its blocks by falling length."""
        basis = first.value[0]
        cell, parts, q, best = None, [], None, None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.rows[best.query], q.ids[best.query], best.row, best.id, best.score)], ["query_row", "query_id", "vec_row", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                strip, lane, block, ids, data, row, bound = (batch.column(c)[r].as_py() for c in range(7))
                if (strip, lane) != cell:
                    yield from result()
                    cell, parts, q, best = (strip, lane), [], None, None
                if block is None:
                    parts.append((row, ids, bound, data))
                    continue
                if best is None:
                    row, own, bound, values = (b"".join(x) for x in zip(*parts, strict=True))
                    q = Side(np.frombuffer(row, np.int64), np.frombuffer(own, np.int64), _integers(values, dim, kind), basis)
                    best, parts = Best(np.frombuffer(bound, float), k), []
                ids = np.frombuffer(ids, np.int64)
                v = Side(_numbers(block, len(ids)), ids, _integers(data, dim, kind), basis)
                i, j, score = search_block(q, best.bound, v, k)
                if len(i):
                    best.add(i, v.rows[j], v.ids[j], score)
        yield from result()

    found = work.save(met.mapInArrow(search, _FOUND), "found")
    work.drop("blocks", "queries")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))  # at most k rows a strip
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
