"""Whole texts as byte buffers: slicing Arrow batches, splitting words and hashing with numpy.

All helpers work on the concatenated UTF-8 bytes of a few documents at a time, so memory follows
the slice (or the longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def small_batches(df: DataFrame) -> None:
    """Let this session's Arrow batches hold about ``BATCH_BYTES``, as rows hold whole texts; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give memory that this worker process no longer uses back to the system: workers go on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``most`` bytes."""
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer, zeros following the end; nothing is copied but the bytes."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _further(lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(spans, first lane of each, number of each lane in its span, lanes) after the first eight bytes, some spans at a time."""
    count = (ends[long] - starts[long] - 1) // 8
    for part in np.split(np.arange(len(long)), np.flatnonzero(np.diff(np.cumsum(count) // _STEP)) + 1):
        if len(part):
            rows, n = long[part], count[part]
            begin = np.cumsum(n) - n
            number = np.arange(n.sum()) - np.repeat(begin - 1, n)
            at = np.repeat(starts[rows], n) + 8 * number
            yield rows, begin, number, lanes[at] & _MASK[np.minimum(np.repeat(ends[rows], n) - at, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Every eight bytes are mixed with their place before they are added up, so no two spans of one length collide for
    the way they are built. Hashes choose candidates and features; where equality decides a result, use ``codes``.
    """
    lanes, size = _lanes(data), ends - starts
    start = np.uint64(pow(_BASE, seed + 2, 2**64))
    out = mix((lanes[starts] & _MASK[np.minimum(size, 8)]) + start)
    for rows, begin, number, lane in _further(lanes, starts, ends, np.flatnonzero(size > 8)):
        out[rows] += np.add.reduceat(mix(lane + number.astype(np.uint64) * np.uint64(_BASE) + start), begin)
    return mix(out ^ (size.astype(np.uint64) * np.uint64(_BASE)))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes from ``a`` and those from ``b`` (of ``other``, if given) on agree for ``size`` bytes, pair by pair."""
    lanes, mask = _lanes(data), _MASK[np.minimum(size, 8)]
    against = lanes if other is None else _lanes(other)
    out = (lanes[a] & mask) == (against[b] & mask)
    for rows, begin, number, lane in _further(lanes, a, a + size, np.flatnonzero(out & (size > 8))):
        n = np.diff(np.append(begin, len(number)))
        place = np.repeat(b[rows], n) + 8 * number
        out[rows] = np.logical_and.reduceat((against[place] & _MASK[np.minimum(np.repeat((b + size)[rows], n) - place, 8)]) == lane, begin)
    return out


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of byte spans, equal exactly where the bytes are: every span is compared with the first of its hash."""
    at = dense(span_hashes(data, starts, ends))
    first = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    head, size = first[at], ends - starts
    if ((size[head] == size) & same_spans(data, starts[head], starts, np.minimum(size, size[head]))).all():
        return at
    known: dict[bytes, int] = {}  # two texts of one hash
    raw = data.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def dense(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal where the values are."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers below 2 ** 32, equal exactly where both parts are."""
    return dense((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` bytes, by doubling; empty if there is none. They choose keys and features, not results."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    part, width, out, done = _BYTES[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] + part[done : done + n] * np.uint64(pow(_BASE, done, 2**64))
                done += width
        if width * 2 > size:
            return mix(out[: len(data) - size + 1])
        part = part[:-width] + part[width:] * np.uint64(pow(_BASE, width, 2**64))
        width *= 2


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)
