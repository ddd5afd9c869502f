"""Operator 12: a Merkle manifest of a dataset, a tree a group and one over the groups.

Leaves are numbered within their group and cut into aligned blocks of ``SPAN = FANOUT ** LEVELS``. A block is one
contiguous matrix of 64 hexadecimal digits a row: reshaped by the fanout its rows are hashed level by level, and every
sibling of every leaf is found by index arithmetic. Tops of blocks are the leaves of the next, far smaller round, until
each group has one node; those are the leaves of the last tree. No task sees more than a block, whatever a group's size.

Equal ids of one group are ordered by their leaves, null ids come first; equal rows in bulk are split among ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.storage import Workspace

FANOUT, LEVELS = 8, 3
SPAN = FANOUT**LEVELS
_PART = 1 << 12
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hex(raw: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes as rows of 64 hexadecimal digits."""
    return np.stack((_DIGITS[raw >> 4], _DIGITS[raw & 15]), 2).reshape(len(raw), -1)


def _hashed(parts: list[bytes]) -> np.ndarray:
    return _hex(np.frombuffer(b"".join(hashlib.sha256(p).digest() for p in parts), np.uint8).reshape(-1, 32))


def tree_levels(n: int) -> int:
    """Rounds of hashing until one node of ``n`` remains."""
    rounds = 0
    while n > 1:
        n, rounds = -(-n // FANOUT), rounds + 1
    return rounds


def block_levels(leaves: np.ndarray, rounds: int) -> list[np.ndarray]:
    """The matrices of a block from its leaves up: ``rounds`` of them above the leaves; short last runs are hashed as they are."""
    out = [leaves]
    for _ in range(rounds):
        nodes = out[-1]
        whole = len(nodes) // FANOUT
        raw, width = nodes.tobytes(), 64 * FANOUT
        out.append(_hashed([raw[k * width : (k + 1) * width] for k in range(whole + (len(nodes) > whole * FANOUT))]))
    return out


def siblings(nodes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each node numbered in ``at``: the digits of the others in its run, left to right."""
    run = at - at % FANOUT
    other = np.arange(FANOUT - 1)
    place = run[:, None] + other + (other >= (at % FANOUT)[:, None])
    size = 64 * (np.minimum(run + FANOUT, len(nodes)) - run - 1)
    found = nodes[np.minimum(place, len(nodes) - 1)].reshape(len(at), -1)
    return [row.tobytes()[:n] for row, n in zip(found, size.tolist(), strict=True)]


def fold(digest: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a node's digits give with the siblings of each level and its place among them."""
    for place, others in steps:
        digest = hashlib.sha256(b"".join((others[: 64 * place], digest, others[64 * place :]))).hexdigest().encode()
    return digest


def _packed(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes((place, len(others) // 64)) + others for place, others in steps)


def _unpacked(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        out.append((place, path[at + 2 : at + 2 + 64 * n]))
        at += 2 + 64 * n
    return out


_BLOCK = "tree long, block long, n long, ids binary, raw binary, changed binary, top binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a block: its members' ids (zero and a mark where null), digests and changed digests in order, and its top node."""
    table = table.sort_by("pos")
    raw = b"".join(table.column("digest").to_pylist())
    n = table.column("n")[0].as_py()
    ids = table.column("id").combine_chunks()
    marked = np.stack((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)), 1)
    changed = b"".join(v or d for v, d in zip(table.column("changed").to_pylist(), table.column("digest").to_pylist(), strict=True))
    top = block_levels(_hex(np.frombuffer(raw, np.uint8).reshape(-1, 32)), min(LEVELS, tree_levels(n)))[-1]
    return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "ids": [marked.tobytes()], "raw": [raw], "changed": [changed], "top": [bytes.fromhex(top.tobytes().decode())]}, pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "raw", "changed", "top"))]))


def _blocks(nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """A written row a block of nodes (tree, pos, n, id, digest, changed)."""
    return work.save(nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("tree", "block").applyInArrow(_build, _BLOCK), name)


def _members(row: dict) -> Iterator[tuple[np.ndarray, list[bytes], list[list[tuple[int, bytes]]]]]:
    """(numbers in the block, digits, steps to the block's top) of a block's nodes, some at a time."""
    rounds = min(LEVELS, tree_levels(row["n"]))
    levels = block_levels(_hex(np.frombuffer(row["raw"], np.uint8).reshape(-1, 32)), rounds)
    for a in range(0, len(levels[0]), _PART):
        at = np.arange(a, min(a + _PART, len(levels[0])))
        steps: list[list[tuple[int, bytes]]] = [[] for _ in at]
        for k in range(rounds):
            up = at // FANOUT**k
            for one, place, others in zip(steps, (up % FANOUT).tolist(), siblings(levels[k], up), strict=True):
                one.append((place, others))
        yield at, [row.tobytes() for row in levels[0][at]], steps


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, pos, path) of every node of blocks that come with the path above them."""
    for batch in batches:
        for row in batch.to_pylist():
            for at, _, steps in _members(row):
                paths = [_packed(s) + (row["above"] or b"") for s in steps]
                yield pa.RecordBatch.from_pydict({"tree": pa.array([row["tree"]] * len(at), pa.int64()), "pos": pa.array(at + SPAN * row["block"], pa.int64()), "path": pa.array(paths, pa.binary())})


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("tree", "pos", "n", F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("binary").alias("changed"))


def _climb(tops: DataFrame, most: int, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """((tree, pos, path) of nodes (tree, pos, n, digest) up to their tree's root, (tree, digest) of the roots); ``most``: the largest n."""
    if most <= 1:
        return tops.select("tree", "pos", F.lit(b"").alias("path")), tops.select("tree", "digest")
    blocks = _blocks(_nodes(tops), work, name)
    above, roots = _climb(blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest")), -(-most // SPAN), work, f"{name}-")
    met = blocks.join(above.withColumnsRenamed({"pos": "block", "path": "above"}), ["tree", "block"])
    return met.select("tree", "block", "n", "raw", "above").mapInArrow(_steps, "tree long, pos long, path binary"), roots


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs and folded roots of every member of blocks that come with the path above them, their subroot and the root."""
    for batch in batches:
        for row in batch.to_pylist():
            above = _unpacked(row["above"])
            tail = b"".join(others for _, others in above)
            changed = _hex(np.frombuffer(row["changed"], np.uint8).reshape(-1, 32))
            ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
            subroot, root = row["subroot"].hex(), row["root"].hex()
            for at, leaves, steps in _members(row):
                proofs = [hashlib.sha256(b"".join([*(others for _, others in s), tail])).hexdigest() for s in steps]
                folded = [fold(fold(c.tobytes(), s), above).decode() for c, s in zip(changed[at], steps, strict=True)]
                m = len(at)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at, 0], mask=ids[at, 1] > 0), "leaf": pa.array(leaves).cast(pa.string()), "subroot": pa.array([subroot] * m), "root": pa.array([root] * m), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})


def encoded(*fields: Column) -> Column:
    """Fields one after another: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(encoded(*fields), 256))


def _numbered(leaves: DataFrame, work: Workspace, group: str, spread: bool) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, pos and n; (tree, n)): trees are numbered by group, nulls first, and leaves within theirs by id and digest.

    ``spread``: ranges may end within equal rows, which keeps them even however often a row repeats.
    """
    order = ["_group", "id", "digest", *(["salt"] if spread else [])]
    rows = leaves.withColumnRenamed(group, "_group")
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = work.save(dealt.drop("salt").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "sorted")
    sizes = dealt.groupBy("_group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))  # at most a row a range and a row a group
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_group", "_range", "_first", before.alias("_before"), F.sum("_size").over(Window.partitionBy("_group")).alias("n"))
    groups = work.save(offsets.groupBy("_group").agg(F.first("n").alias("n")).repartitionByRange("_group").sortWithinPartitions("_group").select("_group", "n", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "groups")
    begun = groups.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    begun = begun.select("_range", "_first", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range of groups
    trees = groups.join(begun, "_range").select("_group", "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))
    places = offsets.join(trees.select(F.col("_group").alias("_g"), "tree"), F.col("_group").eqNullSafe(F.col("_g"))).select("_range", "tree", "n", "_first", "_before", F.col("_group").alias("_g"))
    met = dealt.join(places, (dealt["_range"] == places["_range"]) & dealt["_group"].eqNullSafe(places["_g"]))
    return met.select("tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n", "id", "digest", "changed"), trees.select("tree", "n")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "lang", altered: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes ``fields``; ``altered`` gives the rows to check as if fields of theirs held other values. Nulls are
    values like others, null groups and ids come first, repeated rows are leaves of their own, other columns are passed
    over, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "manifest")
    leaf = leaf_digest(*(F.col(f) for f in fields))
    other = F.lit(None).cast("binary")
    if altered:
        where, put = altered
        other = F.when(where, leaf_digest(*(put.get(f, F.col(f)) for f in fields)))
    leaves = docs.select(F.col(group).alias("_tree"), F.col(id_col).cast("long").alias("id"), leaf.alias("digest"), other.alias("changed"))
    nodes, trees = _numbered(leaves, work, "_tree", spread=True)
    size = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    if not size["trees"]:
        return spark.createDataFrame([], RESULT)
    blocks = _blocks(nodes, work, "blocks")
    tops = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest"))
    inner, subroots = _climb(tops, -(-size["most"] // SPAN), work, "tops")
    subroots = work.save(subroots, "subroots")
    outer, root = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size["trees"]).cast("long").alias("n"), "digest"), size["trees"], work, "roots")
    root = bytes(root.first()["digest"])
    up = inner.withColumnsRenamed({"pos": "block", "path": "_inner"}).join(outer.select(F.col("pos").alias("tree"), F.col("path").alias("_outer")), "tree").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    up = up.select("tree", "block", F.concat("_inner", "_outer").alias("above"), "subroot")
    met = blocks.join(up, ["tree", "block"]).select("n", "ids", "raw", "changed", "above", "subroot", F.lit(root).alias("root"))
    return met.mapInArrow(_finish, RESULT)
