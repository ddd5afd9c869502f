"""Operator 1: removal of repeated byte strings by longest-previous-factor arrays over a distributed suffix order.

A byte goes if a string of ``min_len`` bytes that covers it also starts in a document with a smaller id.

Only strings with a chance of repeating are sorted. The least hash among a string's ``ANCHOR``-byte grams is its
key: equal strings have equal keys, and neighbouring strings mostly share one, so a text falls into runs of strings.

1. Documents are dealt into chunks of a few MB by a hash of their id and text; rows that repeat both in bulk go once
   and their result is spread over them at the end. Every chunk sends its distinct keys, packed by
   key range; each range answers which keys occur in two documents or more.
2. Chunks send a cryptographic digest of each run with such a key and the least id that has it; each range answers whose id is the
   least of all. Equal runs under larger ids are later copies as a whole.
3. Chunks send the bytes of the runs that they have first to the key's range. A range sorts the suffixes of its runs
   (cut at ``min_len``), and previous and next smaller document ids in that order give each suffix its longest
   previous factor; strings whose factor reaches ``min_len`` are later copies. Keys of very many runs are dealt by
   the hash of each string instead, so no range grows with one frequent passage.
4. Chunks take the answers back and cut the bytes out.

A chunk sends each key and each run once, however many copies it holds, so hot passages cost a row a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from orbitframe.llm import text as T

ANCHOR = 20
PART_BYTES, MOST_BYTES = 4 << 20, 32 << 20  # of a chunk and of a range, which grow with the root of the input up to the second
SEGMENT = 1 << 20
BLOCK = 200_000
HOT = 2000
ROW_BYTES = 100  # that a row takes besides its text
_NO_ID = np.iinfo(np.int64).max
_BYTE = np.uint64(1) << (np.arange(1, 8, dtype=np.uint64) * np.uint64(8))


def string_runs(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, key) of the runs of consecutive strings of one text that share their key."""
    found = []
    for low in range(0, max(0, len(data) - min_len + 1), SEGMENT):
        high = min(low + SEGMENT, len(data) - min_len + 1)
        keys = _least(T.gram_hashes(data[low : high + min_len - 1], min(ANCHOR, min_len)), max(1, min_len - ANCHOR + 1))[: high - low]
        at = np.arange(low, high)
        owner = np.searchsorted(offsets, at, "right")
        whole = at + min_len <= offsets[owner]
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new & whole)
        after = np.flatnonzero(new | ~whole)
        end = np.append(after, len(at))[np.searchsorted(after, start, "right")]
        found.append((at[start], end - start, T.mix(keys[start])))  # mixed anew: least hashes crowd at the low end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 if there is none."""
    padded = np.append(values, np.iinfo(np.int64).min)  # index -1 reads the sentinel
    link = np.arange(-1, len(values) - 1)
    active = np.flatnonzero(padded[link] >= values)
    while len(active):
        link[active] = link[link[active]]
        active = active[padded[link[active]] >= values[active]]
    return link


def longest_previous_factors(data: np.ndarray, at: np.ndarray, ids: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix start in ``at`` (``cap`` bytes follow it): how long a prefix also starts under a smaller id, up to ``cap``."""
    words = -(-cap // 8)
    padded = np.append(data, np.zeros(8 * words, np.uint8)).astype(np.uint64)
    for width in (1, 2, 4):
        padded = (padded[:-width] << np.uint64(8 * width)) | padded[width:]
    key = [padded[at + 8 * k] for k in range(words)]
    if cap % 8:
        key[-1] = key[-1] >> np.uint64(64 - 8 * (cap % 8))
    order = np.argsort(key[0], kind="stable")
    tied = np.zeros(len(at) + 1, bool)
    tied[1:-1] = key[0][order][1:] == key[0][order][:-1]
    some = np.flatnonzero(tied[:-1] | tied[1:])  # ranks that the first eight bytes don't settle
    if len(some):
        part = order[some]
        order[some] = part[np.lexsort([k[part] for k in key[::-1]])]
    rank_ids, key = ids[order], [k[order] for k in key]
    before = _nearest_smaller(rank_ids)
    after = len(at) - 1 - _nearest_smaller(rank_ids[::-1])[::-1]
    longest = np.zeros(len(at), np.int64)
    for other, exists in ((before, before >= 0), (after, after < len(at))):
        i = np.flatnonzero(exists)
        for k in range(words):  # only where all bytes before agree
            size = min(8, cap - 8 * k)
            differ = key[k][i] ^ key[k][other[i]]
            same = np.where(differ == 0, size, size - 1 - np.searchsorted(_BYTE, differ, "right"))
            longest[i] = np.maximum(longest[i], 8 * k + same)
            i = i[differ == 0]
    out = np.empty(len(at), np.int64)
    out[order] = longest
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their byte lengths, then their bytes."""
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows in a fixed order, with bytes, offsets and ids (null ids last)."""
    T.release_memory()
    table = table.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
    data, offsets = T.raw(table.column("_text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return table, data[offsets[0] : offsets[-1]], offsets - offsets[0], table.column("_id").fill_null(_NO_ID).to_numpy()


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2 ** bits key ranges in sorted keys."""
    return np.searchsorted(keys, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)


def _rows(chunk: int, blobs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in blobs], pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64()), "blob": pa.array([b for _, b in blobs], pa.large_binary()).cast(pa.binary())})


def _send_keys(table: pa.Table, min_len: int, bits: int) -> pa.Table:
    chunk = table.column("_chunk")[0].as_py()
    _, data, offsets, _ = _chunk(table)
    keys, counts = np.unique(string_runs(data, offsets, min_len)[2], return_counts=True)
    keys, counts = keys >> np.uint64(8), np.minimum(counts, HOT).astype(np.uint16)  # 56 bits are sent as 4, 2 and 1 bytes
    cut = _ranges(keys << np.uint64(8), bits)
    parts = zip(np.split(keys, cut), np.split(counts, cut), strict=True)
    return _rows(chunk, [(p, _pack(k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16), (k >> np.uint64(48)).astype(np.uint8), c)) for p, (k, c) in enumerate(parts) if len(k)])


def _answers(part: int, chunks: pa.Array, blobs: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array([part] * len(blobs), pa.int64()), "chunk": chunks, "blob": pa.array(blobs, pa.binary())})


def _answer_keys(table: pa.Table) -> pa.Table:
    """For each chunk's keys: 0 in one run only, 1 in several, 2 in very many."""
    table = table.sort_by("chunk")
    sent = [_unpack(b.as_py(), np.uint32, np.uint16, np.uint8, np.uint16) for b in table.column("blob")]
    low, mid, high, counts = (np.concatenate([x[k] for x in sent]) for k in range(4))
    keys = low | (mid.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(48))
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts)[at]
    kind = (total > 1).astype(np.uint8) + (total >= HOT).astype(np.uint8)
    return _answers(table.column("part")[0].as_py(), table.column("chunk"), [a.tobytes() for a in np.split(kind, np.cumsum([len(x[0]) for x in sent])[:-1])])


def _digests(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Two rows of 64 bits: a cryptographic digest of each run's bytes, so that equal digests mean equal runs."""
    raw = memoryview(data)
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + lengths).tolist(), strict=True)])
    return np.ascontiguousarray(np.frombuffer(found, np.uint64).reshape(-1, 2).T)


class _Runs:
    """A chunk's runs that may repeat, each once by content and least id; strings of very frequent keys stand alone."""

    def __init__(self, table: pa.Table, min_len: int, kinds: np.ndarray | None, answers: np.ndarray | None = None):
        _, self.data, offsets, ids = _chunk(table)
        start, count, key = string_runs(self.data, offsets, min_len)
        if kinds is None:  # in the order of runs already
            kind = answers
        else:
            kind = kinds[np.unique(key >> np.uint64(8), return_inverse=True)[1]] if len(key) else np.empty(0, np.uint8)
        self.kind = kind
        hot = kind == 2
        single = T.places(start[hot], count[hot])
        start, count, key = (np.concatenate(x) for x in ((start[kind == 1], single), (count[kind == 1], np.ones(len(single), np.int64)), (key[kind == 1], T.span_hashes(self.data, single, single + min_len))))
        lengths, owner = count + min_len - 1, ids[np.searchsorted(offsets, start, "right") - 1]
        content = _digests(self.data, start, lengths)
        order = np.lexsort((start, owner, content[1], content[0]))
        self.start, self.lengths, self.key, self.owner = (x[order] for x in (start, lengths, key, owner))
        self.content = content[:, order]
        self.new = np.ones(len(order), bool)
        self.new[1:] = (self.content[:, 1:] != self.content[:, :-1]).any(0)
        self.group = np.cumsum(self.new) - 1


def _blob_of(answers: pa.Table) -> bytes:
    return b"".join(b.as_py() for b in answers.sort_by("part").column("blob"))


def _send_contents(table: pa.Table, answers: pa.Table, min_len: int, bits: int) -> pa.Table:
    if not table.num_rows:
        return _rows(0, [])
    chunk = table.column("_chunk")[0].as_py()
    runs = _Runs(table, min_len, np.frombuffer(_blob_of(answers), np.uint8))
    high, low, owner = *runs.content[:, runs.new], runs.owner[runs.new]
    cut = _ranges(high, bits)
    blobs = []
    for p, (h, c, o) in enumerate(zip(*(np.split(x, cut) for x in (high, low, owner)), strict=True)):
        mine = runs.kind if p == chunk % 2**bits else runs.kind[:0]  # comes back with the answer
        if len(c) or len(mine):
            blobs.append((p, _pack(h, c, o, mine)))
    return _rows(chunk, blobs)


def _answer_contents(table: pa.Table) -> pa.Table:
    """For each chunk's runs: whether the id sent is the least of all. Kinds go back as they came."""
    table = table.sort_by("chunk")
    sent = [_unpack(b.as_py(), np.uint64, np.uint64, np.int64, np.uint8) for b in table.column("blob")]
    high, low, owner = (np.concatenate([x[k] for x in sent]) for k in range(3))
    order = np.lexsort((owner, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = np.empty(len(order), bool)
    first[order] = owner[order] == owner[order][new][np.cumsum(new) - 1] if len(order) else new
    parts = np.split(first.astype(np.uint8), np.cumsum([len(x[0]) for x in sent])[:-1])
    return _answers(table.column("part")[0].as_py(), table.column("chunk"), [_pack(a, x[3]) for a, x in zip(parts, sent, strict=True)])


def _send_runs(table: pa.Table, answers: pa.Table, min_len: int, bits: int) -> pa.Table:
    if not table.num_rows:
        return _rows(0, [])
    chunk = table.column("_chunk")[0].as_py()
    back = [_unpack(b.as_py(), np.uint8, np.uint8) for b in answers.sort_by("part").column("blob")]
    first, kind = (np.concatenate([np.empty(0, np.uint8), *(x[k] for x in back)]) for k in (0, 1))
    r = _Runs(table, min_len, None, kind)
    least = r.owner == (r.owner[r.new][r.group] if len(r.owner) else r.owner)
    ours = least & (first[r.group] == 1) if len(r.owner) else least
    gone = _merged(r.start[~ours], (r.start + r.lengths)[~ours])
    order = np.flatnonzero(ours)
    order = order[np.argsort(r.key[order], kind="stable")]
    start, lengths, key, owner = (x[order] for x in (r.start, r.lengths, r.key, r.owner))
    cut = _ranges(key, bits)
    blobs = []
    for p, (s, n, k, o) in enumerate(zip(*(np.split(x, cut) for x in (start, lengths, key, owner)), strict=True)):
        mine = gone if p == chunk % 2**bits else gone[:0]
        if len(s) or len(mine):
            blobs.append((p, _pack(r.data[T.places(s, n)], n.astype(np.int32), s, k, o, mine)))
    return _rows(chunk, blobs)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans joined where they overlap, as rows (start, end); spans of neighbouring texts only touch."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] >= end[:-1])
    return np.stack([start[new], np.append(end[:-1][new[1:]], end[-1])], 1)


def _answer_runs(table: pa.Table, min_len: int) -> pa.Table:
    table = table.sort_by("chunk")
    sent = [_unpack(b.as_py(), np.uint8, np.int32, np.int64, np.uint64, np.int64, np.int64) for b in table.column("blob")]
    chunks = table.column("chunk").to_numpy()
    gone = [[x[5].reshape(-1, 2)] for x in sent]
    data, lengths, start, key, owner = (np.concatenate([x[k] for x in sent]) for k in range(5))
    lengths = lengths.astype(np.int64)
    source = np.repeat(np.arange(len(sent)), [len(x[1]) for x in sent])
    at = np.cumsum(lengths) - lengths
    order = np.argsort(key, kind="stable")
    bounds = T.runs(key[order])  # blocks hold whole keys
    block = (np.cumsum(lengths[order])[bounds] - lengths[order][bounds]) // (4 * BLOCK)
    first = T.runs(block)
    for low, high in zip(first, [*first[1:], len(bounds)], strict=False):
        rows = order[bounds[low] : bounds[high] if high < len(bounds) else len(order)]
        copies = _repeated(data, at[rows], lengths[rows], owner[rows], min_len)
        src, b, e = source[rows[copies[0]]], start[rows[copies[0]]] + copies[1], start[rows[copies[0]]] + copies[2]
        by = np.argsort(src, kind="stable")
        for k, piece in zip(np.unique(src), np.split(by, np.flatnonzero(np.diff(src[by])) + 1), strict=False):
            gone[k].append(np.stack([b[piece], e[piece]], 1))
    out = [_merged(*np.concatenate(x).T) for x in gone]
    return pa.table({"chunk": pa.array(chunks), "blob": pa.array([x.astype(np.int64).tobytes() for x in out], pa.binary())})


def _repeated(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, owner: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, begin, end) of the parts of runs that later copies make up; equal runs are sorted once."""
    low, high = int(at.min()), int((at + lengths).max())
    if high - low > 4 * int(lengths.sum()):  # take the block's own bytes
        data, at = data[T.places(at, lengths)], np.cumsum(lengths) - lengths
    else:
        data, at = data[low:high], at - low
    content = T.codes(data, at, at + lengths)
    order = np.lexsort((owner, content))
    new = np.ones(len(order), bool)
    new[1:] = content[order][1:] != content[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the equal run with the smallest id
    whole = np.flatnonzero(owner > owner[head])
    reps = order[new]
    strings = lengths - min_len + 1
    factor = longest_previous_factors(data, T.places(at[reps], strings[reps]), np.repeat(owner[reps], strings[reps]), min_len)
    base = np.empty(len(order), np.int64)
    base[reps] = np.cumsum(strings[reps]) - strings[reps]
    rest = np.flatnonzero(owner == owner[head])
    copied = factor[T.places(base[head[rest]], strings[rest])] >= min_len
    run = np.repeat(rest, strings[rest])
    place = T.places(np.zeros(len(rest), np.int64), strings[rest])
    edge = np.ones(len(run) + 1, bool)
    edge[1:-1] = (copied[1:] != copied[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(edge[:-1] & copied)
    last = np.flatnonzero(edge[1:] & copied)
    return np.concatenate([whole, run[first]]), np.concatenate([np.zeros(len(whole), np.int64), place[first]]), np.concatenate([lengths[whole], place[last] + min_len])


def _cut(table: pa.Table, answers: pa.Table, names: list[str], characters: bool) -> pa.Table:
    """Each row's counts and kept bytes from the spans that go; besides the bytes, memory follows the spans."""
    table, data, offsets, _ = _chunk(table)
    gone = np.frombuffer(b"".join(b.as_py() for b in answers.column("blob")), np.int64).reshape(-1, 2)
    owner = np.searchsorted(offsets, gone[:, 0], "right") - 1  # spans never cross a text's end
    if characters and len(gone):  # a character goes if any of its bytes goes
        gone, low, high = gone.copy(), offsets[owner], offsets[owner + 1]
        inside = np.append((data & 0xC0) == 0x80, False)  # not the first byte of a character
        while (back := inside[gone[:, 0]] & (gone[:, 0] > low)).any():
            gone[:, 0] -= back
        while (on := inside[gone[:, 1]] & (gone[:, 1] < high)).any():
            gone[:, 1] += on
    order = np.lexsort((gone[:, 0], owner))
    start, owner = gone[order, 0], owner[order]
    end = np.maximum.accumulate(gone[order, 1])
    new = np.append(True, (start[1:] > end[:-1]) | (owner[1:] != owner[:-1])) if len(start) else np.empty(0, bool)
    start, owner, end = start[new], owner[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(new) else end
    spans = np.bincount(owner, minlength=table.num_rows)
    removed = np.zeros(table.num_rows, np.int64)
    np.add.at(removed, owner, end - start)
    size = np.diff(offsets)
    edges = np.concatenate([[0], np.stack([start, end], 1).reshape(-1), [len(data)]])
    keep = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
    kept = np.append(0, np.cumsum(size - removed))
    raw = pa.Array.from_buffers(pa.large_binary(), table.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(data[keep])]).cast(pa.binary())
    return pa.table([*(table.column(x) for x in names), pa.array(size), pa.array(removed), pa.array(spans), raw], [*names, "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, keep: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(doc_id, *keep, n_bytes, n_removed, n_spans, kept binary): every whole text without later copies.

    Null texts count as empty; rows with equal ids never remove each other; a null id counts as larger than all
    others, ids being compared by value, so rows of one id may lie in any chunk; rows come out as often as they come in; an empty table gives an empty result. Columns other than the
    id, the text and ``keep`` are dropped first, so clashing names don't matter. With ``characters``, spans are widened
    to whole UTF-8 characters.
    """
    T.small_batches(docs)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    part_bytes = max(PART_BYTES, min(MOST_BYTES, int((1024 * size) ** 0.5)))  # keeps what a chunk sends to a range near a KB up to 1 TB
    parts = max(1, -(-size // part_bytes))
    bits = max(6, int(parts - 1).bit_length()) if size > SEGMENT else 2
    rows = docs.select(F.xxhash64(id_col, text_col).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *keep)
    weight = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + ROW_BYTES)
    bulk = rows.groupBy("_row").agg(F.count("*").alias("_n"), F.ceil(weight / (part_bytes / 8)).alias("_parts")).where("_n > 1 and _parts > 1").drop("_n")
    if not bulk.take(1):
        return _dealt(rows, parts, bits, min_len, characters, list(keep)).withColumnRenamed("_id", id_col)
    met = rows.join(bulk, "_row")
    once = met.groupBy("_row", "_id", "_text").agg(F.first("_parts").alias("_parts"))
    single = rows.join(bulk, "_row", "left_anti")
    both = single.withColumn("_parts", F.lit(0).cast("long")).unionByName(once, allowMissingColumns=True)
    cut = _dealt(both, parts, bits, min_len, characters, ["_row", "_parts", *keep])
    counts = ["n_bytes", "n_removed", "n_spans", "kept"]
    shares = cut.where("_parts > 0").select("_row", "_id", *counts, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    repeats = met.select("_row", F.col("_id").alias("_own"), *keep, F.pmod(F.monotonically_increasing_id(), "_parts").alias("_part"))
    spread = repeats.join(shares.withColumnsRenamed({"_row": "_r", "_part": "_p"}), (F.col("_row") == F.col("_r")) & (F.col("_part") == F.col("_p")) & F.col("_own").eqNullSafe(F.col("_id")))
    out = ["_id", *keep, *counts]
    return cut.where("_parts = 0").select(out).union(spread.select(out)).withColumnRenamed("_id", id_col)


def _dealt(rows: DataFrame, parts: int, bits: int, min_len: int, characters: bool, names: list[str]) -> DataFrame:
    """(_id, *names, n_bytes, n_removed, n_spans, kept) of rows (_row, _id, _text, *names), dealt into chunks by ``_row``."""
    picked = rows.select(F.pmod("_row", F.lit(max(parts, 4))).alias("_chunk"), "_id", "_text", *names)
    sent = "part long, chunk long, blob binary"
    keys = picked.groupBy("_chunk").applyInArrow(lambda t: _send_keys(t, min_len, bits), sent)
    answers = keys.groupBy("part").applyInArrow(_answer_keys, sent)
    contents = picked.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _send_contents(t, a, min_len, bits), sent)
    firsts = contents.groupBy("part").applyInArrow(_answer_contents, sent)
    runs = picked.groupBy("_chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(lambda t, a: _send_runs(t, a, min_len, bits), sent)
    gone = runs.groupBy("part").applyInArrow(lambda t: _answer_runs(t, min_len), "chunk long, blob binary")
    names = ["_id", *names]
    counts = [StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
    schema = StructType([*picked.select(*names).schema, *counts, StructField("kept", BinaryType())])
    return picked.groupBy("_chunk").cogroup(gone.groupBy("chunk")).applyInArrow(lambda t, a: _cut(t, a, names, characters), schema)
