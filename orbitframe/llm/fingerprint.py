"""Operator 11: document fingerprints as threshold-scaled sketches.

A text is the set of its five-word shingles, A-Z in lower case; with fewer words its whole sequence is one shingle. Its
fingerprint holds every shingle hash below a fixed fraction of all hash values, and in any case its ``LEAST`` smallest
ones, so short texts are held whole. Fingerprints of any two texts can be merged and compared below the lower of their
bounds, where both are complete: containment is estimated without bias however unequal the texts are.

A word's key is 48 bits of its md5; a shingle's hash is a sum of its words' keys with fixed odd factors modulo 2 ** 64.
A fingerprint is written as the ascending hashes, sixteen hexadecimal digits each. Texts without words have an empty
one, like only to each other (1) and to nothing else (0). Null texts count as empty, invalid bytes as U+FFFD.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orbitframe.llm import text as T

#: One hash in so many is kept, and of every text so many at least.
ONE_IN, LEAST, SIZE = 8, 16, 5
LIMIT = 2**64 // ONE_IN
#: The summand and the factors of a shingle's words.
FACTORS = [int(hashlib.sha256(f"shingle {k}".encode()).hexdigest()[:16], 16) | 1 for k in range(SIZE + 1)]


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """48 bits of each word's md5, taken once for each distinct word."""
    size = ends - starts
    at = np.append(0, np.cumsum(size))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[T.places(starts, size)])])
    coded = words.dictionary_encode()
    keys = np.array([int.from_bytes(hashlib.md5(w).digest()[:6], "big") for w in coded.dictionary.to_pylist()], np.uint64)
    return keys[coded.indices.to_numpy()] if len(keys) else keys


def sketches(column: pa.Array) -> list[np.ndarray]:
    """Of every whole text: its kept hashes, ascending."""
    out: list[np.ndarray] = []
    for i, j, data, offsets in T.slices(column):
        data = T.LOWER[data]
        starts, ends, first = T.words(data, offsets)
        keys, count = word_keys(data, starts, ends), np.diff(first)
        owner, n = np.repeat(np.arange(j - i), count), len(starts)
        left = np.repeat(first[1:], count) - np.arange(n)  # words from here to the text's end
        use = np.flatnonzero((left >= SIZE) | ((np.repeat(count, count) < SIZE) & (left == np.repeat(count, count))))
        hashes = np.full(len(use), FACTORS[0], np.uint64)
        for k in range(SIZE):
            hashes += np.where(left[use] > k, keys[np.minimum(use + k, n - 1)], np.uint64(0)) * np.uint64(FACTORS[k + 1])
        order = np.lexsort((hashes, owner[use]))
        hashes, owner = hashes[order], owner[use][order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        begin = np.searchsorted(owner, np.arange(j - i + 1))
        keep = (hashes < LIMIT) | (np.arange(len(owner)) - begin[owner] < LEAST)
        kept, edge = hashes[keep], np.searchsorted(owner[keep], np.arange(j - i + 1))
        out.extend(kept[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    return out


def _bound(h: np.ndarray) -> int:
    """The hash up to which a fingerprint is complete."""
    if len(h) < LEAST:
        return 2**64 - 1
    return max(LIMIT - 1, int(h[-1]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the first text's shingles that the second has; 0 where no hash can tell."""
    if not len(a):
        return float(not len(b))
    bound = np.uint64(min(_bound(a), _bound(b)))
    a, b = a[: np.searchsorted(a, bound, "right")], b[: np.searchsorted(b, bound, "right")]
    if not len(a) or not len(b):
        return 0.0
    return float((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).mean())


def _written(h: np.ndarray) -> str:
    return h.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of docs and the fingerprint of every whole text; a column of that name is replaced. Map-only."""
    T.small_batches(docs)
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_written(h) for h in sketches(batch.column(text_col))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, StringType())]))


def _hashes(written: Column) -> Column:
    return F.when(F.length(written) > 0, F.transform(F.sequence(F.lit(0), F.floor(F.length(written) / 16).cast("int") - 1), lambda k: F.substr(written, 16 * k + 1, F.lit(16)))).otherwise(F.array().cast("array<string>"))


def _upto(h: Column) -> Column:
    return F.when(F.size(h) < LEAST, F.lit("f" * 16)).otherwise(F.greatest(F.lit(f"{LIMIT - 1:016x}"), F.element_at(h, -1)))


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two texts' shingles."""
    both = F.array_sort(F.array_union(_hashes(a), _hashes(b)))
    return F.array_join(F.filter(both, lambda h, k: (h < f"{LIMIT:016x}") | (k < LEAST)), "")


def _once(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values, each evaluated once: a lambda's argument is."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f), 0)


def containment(a: Column, b: Column) -> Column:
    """``likeness`` of written fingerprints: the share of the first one's shingles that the second has."""
    share = lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.nullif(F.size(s["x"]), F.lit(0))
    below = lambda s: _once(share, x=F.filter(s["x"], lambda h: h <= s["bound"]), y=s["y"])
    common = _once(lambda s: _once(below, x=s["x"], y=s["y"], bound=F.least(_upto(s["x"]), _upto(s["y"]))), x=_hashes(a), y=_hashes(b))
    return F.when(F.length(a) == 0, (F.length(b) == 0).cast("double")).otherwise(F.coalesce(common, F.lit(0.0)))


def _texts(column: pa.Array) -> list[str]:
    return [(v or b"").decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(ids: pa.Array, texts: list[str], nexts: list[str], own: list[np.ndarray], others: list[np.ndarray]) -> dict:
    edited = [_edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    made = sketches(pa.array(edited, pa.string()))
    return {"doc_id": ids, "n_chars": pa.array(map(len, texts), pa.int64()), "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), "fingerprint": pa.array(map(_written, own), pa.string()), "edited_fingerprint": pa.array(map(_written, made), pa.string()), "near_edited": pa.array(map(likeness, own, made), pa.float64()), "near_next": pa.array(map(likeness, own, others), pa.float64())}


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_Key = tuple[bool, int, bytes]


def _keys(batch: pa.RecordBatch) -> list[_Key]:
    """The order of rows: null ids first, then by id, then by the digest of the text."""
    return [(i is not None, i or 0, bytes(d)) for i, d in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)]


def _deal(batches: Iterator[pa.RecordBatch], first: list[_Key]) -> Iterator[pa.RecordBatch]:
    """Rows with their range, and once more, as the one that follows the range before, those that begin a range.

    Equal rows that begin several ranges are dealt among these, the first of each task to the last of them, so that a
    range's rows are followed by what it was told whichever of the equal ones it holds.
    """
    met: dict[_Key, int] = {}
    for batch in batches:
        place, take, follows = [], [], []
        for i, key in enumerate(_keys(batch)):
            low, high = bisect_left(first, key), bisect_right(first, key) - 1
            if high < low or high < 0:  # between two first keys
                place.append(max(high, 0)), take.append(i), follows.append(False)
                continue
            seen = met.get(key, 0)
            met[key] = seen + 1
            place.append(high - seen % (high - low + 1)), take.append(i), follows.append(False)
            if not seen:
                for k in range(low, high + 1):
                    place.append((k - 1) % len(first)), take.append(i), follows.append(True)
        rows = batch.take(pa.array(take, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(follows), *rows.columns], ["range", "follows", *batch.schema.names])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted ranges, each with the one after it; the last rows of a range are what follows it."""
    ids, texts, own, at, over = [], [], [], None, False
    for batch in batches:
        came = _texts(batch.column("text"))
        made, ranges, follows, new = sketches(pa.array(came, pa.string())), batch.column("range").to_pylist(), batch.column("follows").to_pylist(), batch.column("doc_id").to_pylist()
        ready: list[tuple] = []
        for k, text in enumerate(came):
            if ranges[k] != at:
                ids, texts, own, at, over = [], [], [], ranges[k], False
            if over:  # equal rows of several tasks follow one range
                continue
            if texts:
                ready.append((ids.pop(), texts.pop(), text, own.pop(), made[k]))
            over = follows[k]
            if not over:
                ids, texts, own = [new[k]], [text], [made[k]]
        if ready:
            i, text, following, mine, others = map(list, zip(*ready))
            yield pa.RecordBatch.from_pydict(_compared(pa.array(i, pa.int64()), text, following, mine, others))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document held against its edited text and against the document that follows it.

    Documents follow each other by id, nulls first, then by the sha256 of their texts; the first follows the last, and
    a single one itself. The edited text ends with the beginning of the next one. Result: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Other columns are passed over; repeated rows
    follow one another; an empty table gives an empty result.

    Ids and digests alone are sorted first, which gives the least key of each range, a row a range. Whole texts then
    move once, into ranges that are sorted and read as a stream of neighbours, each with the text that begins the next
    range. Equal rows in bulk are dealt among all ranges that they fill.
    """
    spark = docs.sparkSession
    T.small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("salt")).repartitionByRange(ranges, "doc_id", "digest", "salt")
    least = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "digest")).alias("key")).collect()  # a row a range
    first = sorted((r.key.doc_id is not None, r.key.doc_id or 0, bytes(r.key.digest)) for r in least)
    if not first:
        return spark.createDataFrame([], _RESULT)
    dealt = rows.mapInArrow(lambda batches: _deal(batches, first), "range int, follows boolean, doc_id long, text string, digest binary")
    return dealt.repartitionById(len(first), "range").sortWithinPartitions("range", "follows", "doc_id", "digest").select("range", "follows", "doc_id", "text").mapInArrow(_stream, _RESULT)
