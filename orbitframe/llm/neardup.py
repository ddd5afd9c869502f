"""Operator 2: near-duplicate groups from SetSketch registers, confirmed on full shingle sets.

1. Every text becomes a set of hashed five-word shingles. Its sketch holds one register per hash function: the
   smallest exponential variable over the set, truncated to the exponent of base ``BASE``. The maximum of two
   sketches' registers is the sketch of the union, and registers of similar sets collide.
2. Texts with equal sets, told by a cryptographic digest of the sets' words, collapse to one representative, so groups
   of exact copies stop mattering.
3. Representatives that share a band of four registers are candidates: first each with two leaders of its band,
   then, for bands whose members are not yet all in one component, members of different components, less those
   that the counts of their rare shingles rule out.
   At similarity 0.75 a pair misses all 40 bands with probability below 3e-7.
4. The joint likelihood of two sketches drops candidates that are clearly too far apart; the rest are confirmed
   on the full sets of words, compared as bytes, and components follow the confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm import text as T
from orbitframe.llm.components import connected_components
from orbitframe.llm.storage import Workspace

#: A base near 1 leaves about ten bits in a register, so unrelated sets of one size hardly ever share a band.
BANDS, ROWS, BASE = 40, 4, 1.005
REGISTERS = BANDS * ROWS
RARE = 20
_PART = 1 << 16
_SEEDS = np.random.default_rng(11).integers(1, 2**32, (REGISTERS, 2), dtype=np.uint32) | np.uint32(1)


class Shingles:
    """The distinct shingles of some whole texts; a text of fewer than ``size`` words has its whole sequence as one.

    ``code``: numbers equal exactly where the words are, within these texts; ``hashes``: equal for equal words
    anywhere. Both are sorted by hash within each text; ``first``: where each text's begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = 5):
        self.data, self.size = T.LOWER[data], size
        self.starts, self.ends, first = T.words(self.data, offsets)
        n, count = len(self.starts), np.diff(first)
        owner = np.repeat(np.arange(len(count)), count)
        take = np.minimum(first[1:][owner] - np.arange(n), size)  # words from here on that belong to the shingle
        use = np.flatnonzero((take == size) | ((count[owner] < size) & (np.arange(n) == first[:-1][owner])))
        word, hashed = T.codes(self.data, self.starts, self.ends), T.span_hashes(self.data, self.starts, self.ends)
        code, hashes = word[use], T.mix(hashed[use])
        for k in range(1, size):
            at, more = np.minimum(use + k, n - 1), take[use] > k
            code = T.joined(code, np.where(more, word[at], n))
            hashes = T.mix(hashes + np.where(more, hashed[at], np.uint64(0)) + np.uint64(k))
        owner = owner[use]
        order = np.lexsort((code, hashes, owner))
        code, owner = code[order], owner[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        self.code, self.hashes, self.word, self.take = code[new], hashes[order][new], use[order][new], take[use][order][new]
        self.first = np.searchsorted(owner[new], np.arange(len(count) + 1))

    def digests(self) -> list[bytes | None]:
        """Of each text's set: a cryptographic digest of its shingles' words in their order, which follows the set alone."""
        length = self.ends - self.starts + 1  # a word and a blank
        at = np.cumsum(length) - length
        words = np.full(int(length.sum()), 32, np.uint8)
        words[T.places(at, length - 1)] = self.data[T.places(self.starts, length - 1)]
        edge = np.append(at, len(words))
        begin, end = edge[self.word], edge[self.word + self.take]
        out: list[bytes | None] = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            digest = hashlib.blake2b(digest_size=16)
            for i in range(a, b, _PART):
                j = min(i + _PART, b)
                digest.update(words[T.places(begin[i:j], end[i:j] - begin[i:j])].tobytes())
            out.append(digest.digest() if b > a else None)
        return out


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers of each non-empty set, as uint16 rows."""
    at = first[:-1]
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(at), REGISTERS), np.uint32)
    value, other = np.empty_like(low), np.empty_like(low)
    for k, (a, b) in enumerate(_SEEDS):
        np.multiply(low, a, out=value)
        np.multiply(high, b, out=other)
        np.add(value, other, out=value)
        least[:, k] = np.minimum.reduceat(value, at)
    x = -np.log1p(-(least + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, digest, sketch): set size, a 128-bit cryptographic digest of the set, and its registers (null if empty). Map-only."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("_text")):
                found = Shingles(data, offsets, size)
                n = np.diff(found.first)
                some = np.flatnonzero(n)
                sketch = [None] * (j - i)
                if len(some):
                    for row, r in zip(some, registers(found.hashes, np.append(found.first[some], len(found.hashes))), strict=True):
                        sketch[row] = r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n), pa.array(found.digests(), pa.binary()), pa.array(sketch, pa.binary())], ["id", "n", "digest", "sketch"])

    return picked.mapInArrow(run, "id long, n long, digest binary, sketch binary")


def bands(reps: DataFrame) -> DataFrame:
    """(band, id): a row for each representative and band, keyed by a hash of the band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
                keys = T.mix(T.mix(np.ascontiguousarray(rows).view(np.uint64)[:, :, 0]) + np.arange(BANDS, dtype=np.uint64))
                ids = np.repeat(part.column("id").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["band", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "band long, id long")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, slack: float = 14.0) -> np.ndarray:
    """Whether two sketches may belong to sets at least so similar, by the joint likelihood of their registers.

    With u, v the shares of the two set sizes and p(x) = -log_b(1 - x (b - 1) / b), a register of the first is
    larger with probability p(u - v J), of the second with p(v - u J). A pair goes only if its best likelihood
    exceeds that at ``similarity`` by ``slack`` (about 5.3 standard deviations) and lies below it.
    """
    most = np.minimum(na, nb) / np.maximum(na, nb)
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = na / (na + nb)
    v = 1 - u

    def log_likelihood(j):
        p = lambda x: -np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-9))

    here = log_likelihood(np.minimum(similarity, most))
    best = np.max([log_likelihood(np.minimum(j, most)) for j in np.linspace(0, similarity, 31)], axis=0)
    return (most >= similarity - 1e-9) & (best - here < slack)


def plausible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sketches don't rule the link out."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("sa", "sb"))
                ok = likely(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| of their full shingle sets."""
    texts = docs.select("id", "_text")
    both = pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("_text", "ta"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("_text", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            ok = [np.empty(0, bool)]
            (one, at), (two, to) = T.raw(batch.column("ta")), T.raw(batch.column("tb"))
            ends = np.cumsum(np.diff(at) + np.diff(to))
            for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // T.SLICE_BYTES)) + 1):
                if len(part):  # both sides' texts, numbered together
                    i, j = part[0], part[-1] + 1
                    offsets = np.concatenate([at[i : j + 1] - at[i], to[i + 1 : j + 1] - to[i] + at[j] - at[i]])
                    found = Shingles(np.concatenate([one[at[i] : at[j]], two[to[i] : to[j]]]), offsets, size)
                    n = np.diff(found.first)
                    pair = np.repeat(np.tile(np.arange(len(part)), 2), n)
                    both = np.sort((pair.astype(np.uint64) << np.uint64(32)) | found.code.astype(np.uint64))
                    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(part))
                    ok.append(100 * shared >= percent * (n[: len(part)] + n[len(part) :] - shared))
            keep = pa.array(np.concatenate(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def leader_pairs(keyed: DataFrame, work: Workspace) -> DataFrame:
    """Each member of a band with the band's smallest id and with its hub, the member that meets most others over all bands.

    Band sizes and leaders are joined, so that a skewed band can be split.
    """
    sizes = keyed.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
    shared = work.save(keyed.join(sizes, "band"), "shared")
    central = shared.groupBy("id").agg(F.sum("size").alias("meets"))
    hubs = shared.join(central, "id").groupBy("band").agg(F.max(F.struct("meets", -F.col("id"))).alias("m")).select("band", (-F.col("m.col2")).alias("hub"))
    met = shared.join(hubs, "band")
    pairs = met.select(F.explode(F.array(*(F.struct(F.least(x, "id").alias("a"), F.greatest(x, "id").alias("b")) for x in ("low", "hub")))).alias("p"))
    return pairs.select("p.a", "p.b").where("a < b").distinct()


def crossing_pairs(keyed: DataFrame, labels: DataFrame, tested: DataFrame, reps: DataFrame, texts: DataFrame, repeated: DataFrame, size: int, percent: int, work: Workspace) -> DataFrame:
    """Untested pairs that share a band but not a component and whose shingles don't rule a link out.

    Let a shingle be rare if at most ``RARE`` of the texts in question have it. A pair that shares a rare shingle
    comes from the short list of that shingle. Any other pair shares at most the smaller number of shingles that are
    not rare, which excludes nearly all texts at the fringe of a large group. For the rest, members of a band's
    largest component are one side and all other members meet them and each other; nothing is emitted within a
    component, however large. Texts of one id, listed in ``repeated``, count as one text with all their shingles.
    """
    held = keyed.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = held.groupBy("band", "label").count()
    mixed = sizes.groupBy("band").agg(F.count("*").alias("k"), F.max_by("label", "count").alias("main")).where("k > 1").select("band", "main")
    members = work.save(held.join(mixed, "band"), "members")
    asked = members.select("id", "label").distinct().join(repeated.select("id", F.lit(True).alias("many")), "id", "left")
    asked = asked.withColumn("many", F.coalesce("many", F.lit(False)))
    rows = work.save(shingle_rows(texts.join(asked, "id"), size), "shingles")
    joint = rows.where("many").distinct()
    rows = rows.where("not many").union(joint)
    rare = rows.groupBy("shingle").count().where(F.col("count") <= RARE)
    lists = work.save(rows.join(rare, "shingle"), "rare_lists")
    few = lists.where("count > 1").select("shingle", "id", "label")
    other = few.select("shingle", F.col("id").alias("x"), F.col("label").alias("lx"))
    through_rare = few.join(other, "shingle").where("id < x and label <> lx").select(F.col("id").alias("a"), F.col("x").alias("b"))
    total = F.coalesce("all", "n")  # of all texts of the id
    common = reps.select("id", "n").join(lists.groupBy("id").agg(F.count("*").alias("k")), "id", "left").join(joint.groupBy("id").agg(F.count("*").alias("all")), "id", "left")
    common = common.select("id", "n", F.least("n", total - F.coalesce("k", F.lit(0))).alias("common"))
    common = common.where(100 * F.col("common") >= percent * F.col("n")).join(members.groupBy("id").agg(F.collect_set("band").alias("bands")), "id")  # at most BANDS each
    able = work.save(members.join(common, "id"), "able")
    others = able.where("label <> main").select("band", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("common").alias("cx"), F.col("bands").alias("bx"))
    most = F.least("common", "cx")
    once = F.array_min(F.array_intersect("bands", "bx")) == F.col("band")
    met = others.join(able, "band").where((F.col("lx") != F.col("label")) & (100 * most >= percent * (F.col("n") + F.col("nx") - most)) & once)
    through_bands = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
    return through_rare.union(through_bands).distinct().join(tested, ["a", "b"], "left_anti")


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(shingle, id, label, many): a row for each shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("_text"), 1 << 18):
                found = Shingles(data, offsets, size)
                rows = pa.array(np.repeat(np.arange(i, j), np.diff(found.first)))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes.view(np.int64)), batch.column("id").take(rows), batch.column("label").take(rows), batch.column("many").take(rows)], ["shingle", "id", "label", "many"])

    return texts.select("id", "label", "many", "_text").mapInArrow(run, "shingle long, id long, label long, many boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate components of whole texts.

    Null, empty and wordless texts have an empty set and stay alone; equal sets (repeated rows, exact copies) are
    linked; component_id is the smallest id reachable, and exactly that document is kept. Ids are integers; rows
    without one take no part, have no component and are kept; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    T.small_batches(docs)
    work = Workspace(spark, "neardup")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    sketched = work.save(sketch_documents(docs, id_col, text_col, size), "sketches")
    groups = sketched.where("n > 0 and id is not null").groupBy("digest", "n").agg(F.min(F.struct("id", "sketch")).alias("m"))
    reps = work.save(groups.select("digest", "n", "m.id", "m.sketch"), "representatives")
    keyed = bands(reps)
    pairs = work.save(plausible(leader_pairs(keyed, work), reps, percent / 100).hint("rebalance"), "pairs")
    links = work.save(confirmed(pairs, texts, size, percent).hint("rebalance"), "links")
    labels = connected_components(links, work, "first")
    # bands whose members are not all in one component yet
    repeated = sketched.where("id is not null").groupBy("id").count().where("count > 1")
    more = work.save(plausible(crossing_pairs(keyed, labels, pairs, reps, texts, repeated, size, percent, work), reps, percent / 100).hint("rebalance"), "more_pairs")
    if more.take(1):
        more_links = work.save(confirmed(more, texts, size, percent).hint("rebalance"), "more_links")
        labels = connected_components(links.union(more_links), work, "second")
        work.drop("first")
    work.drop("shared", "pairs", "links", "members", "shingles", "rare_lists", "able", "more_pairs", "more_links")
    found = reps.join(labels, "id", "left").select("digest", "n", F.coalesce("label", "id").alias("component_id"))
    out = sketched.join(found, ["digest", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
