"""Operator 9: token ids in binary shards, compressed by Re-Pair grammars.

Documents in order of their ids fill Parquet files, so any store that Spark writes will do; a row is a shard of about
``SHARD_IDS`` ids with a grammar of its own. Frequent pairs of neighbouring ids become nonterminals, round after round
until no pair is frequent; a row holds the rules, the length each symbol expands to, the symbols in
planes of bytes, and for each document how many symbols and ids it has. Pairs never cross a document's end, so any document
is decoded without its neighbours, and any range of its ids by the expansion lengths without the rest of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm import text as T

SHARD_IDS = 1 << 19
FILE_BYTES, MOST_FILE_BYTES = 8 << 20, 512 << 20  # of text; files grow with the root of the input up to the second
SLICE_BYTES = 1 << 21
LEAST = 6  # a rule costs two ids and a length
PREFIX = 32
SCHEMA = "file int, shard int, n_docs int, n_nulls int, n_ids long, keys binary, id_counts binary, symbol_counts binary, width int, first_rule int, rules binary, lengths binary, symbols binary"
#: Bytes that begin characters whose class bytes don't show (all but ASCII without 1C-1F, and Latin letters up to U+024F).
_STRANGE = np.zeros(256, bool)
_STRANGE[[*range(0x1C, 0x20), 0xC2, *range(0xCA, 256)]] = True
_WHITE = b" \t\n\x0b\x0c\r"
CACHE_PIECES = 1_500_000
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-level split pattern start in texts of ASCII and Latin letters.

    Runs of letters, digits or signs take one blank before them along; a run of white space before them leaves its
    last character by itself; 's 't 're 've 'm 'll 'd stand alone where the quote starts a match.
    """
    n, kind = len(data), _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    low = np.flatnonzero(start)
    high = np.append(low[1:], n)
    space = (kind[low] == _SPACE) & ~edge[high]  # more follows in the text
    last = high[space] - 1
    start[last] = True
    start[last[data[last] == 0x20] + 1] = False
    quote = low[(kind[low] == _SIGN) & (high - low == 1) & (data[low] == 39) & start[low] & ~edge[high]]
    quote = quote[kind[quote + 1] == _LETTER]
    one, two = data[quote + 1], np.where(edge[np.minimum(quote + 2, n)], 0, data[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == 101) & np.isin(one, (114, 118))) | ((one == 108) & (two == 108))
    start[quote[short | long] + 1] = False
    for at in (quote[short] + 2, quote[long] + 3):
        start[at[at < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Whole texts to ids by the tokenizers library, asked once for each distinct match of its split pattern.

    Texts that hold a special token of the file, or letters whose class bytes don't show, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.length = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.length[number] = len(token)  # a character of a token is a byte
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        """Known pieces: sorted hashes with their rows; by row, where bytes and ids end. Arrays keep room to grow."""
        self.known, self.rows, self.count = np.empty(0, np.uint64), np.empty(0, np.int32), 0
        self.bytes, self.ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after another, number of ids of each).

        Pieces of a blank and what follows it are sent as one text, which splits into them again, and so are pieces
        without white space, each with a line's end behind it; ids are told apart by their lengths in bytes. Runs of
        white space are sent by themselves.
        """
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = np.array([1 if t[0] not in _WHITE else 0 if t[0] == 0x20 and len(t) > 1 and t[1] not in _WHITE else 2 for t in texts], np.int8)
        blank, bare, alone = (np.flatnonzero(kind == k) for k in range(3))
        joined = [b"".join(texts[k] for k in blank.tolist()), b"".join(texts[k] + b"\n" for k in bare.tolist())]
        found = [x.ids for x in self.tokenizer.encode_batch_fast([*(t.decode() for t in joined), *(texts[k].decode() for k in alone.tolist())], add_special_tokens=False)]
        count, parts, order = np.empty(len(texts), np.int64), [], []
        for rows, ids, ends in ((blank, found[0], 0), (bare, found[1], 1)):
            ids = np.array(ids, np.uint32)
            last = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size[rows] + ends))
            count[rows] = np.diff(last, prepend=-1) - ends
            parts.append(np.delete(ids, last) if ends else ids)
            order.append(np.repeat(rows, count[rows]))
        count[alone] = list(map(len, found[2:]))
        parts.append(np.fromiter(chain.from_iterable(found[2:]), np.uint32))
        order.append(np.repeat(alone, count[alone]))
        return np.concatenate(parts)[np.argsort(np.concatenate(order), kind="stable")], count

    def _learn(self, texts: list[bytes]) -> None:
        """Bytes and ids of new pieces go behind those known."""
        ids, count = self._encode(texts)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        low, high = self.count, self.count + len(texts)
        self.ends, self.bounds = _roomy(self.ends, high + 1), _roomy(self.bounds, high + 1)
        self.ends[low + 1 : high + 1] = self.ends[low] + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.bounds[low + 1 : high + 1] = self.bounds[low] + np.cumsum(count)
        self.bytes, self.flat = _roomy(self.bytes, self.ends[high]), _roomy(self.flat, self.bounds[high])
        self.bytes[self.ends[low] : self.ends[high]] = raw
        self.flat[self.bounds[low] : self.bounds[high]] = ids
        self.count = high

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Rows of distinct pieces, new ones learned; None if a piece has the hash of another one."""
        hashes, size = T.span_hashes(data, starts, ends), ends - starts
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == hashes[order][hit]
        old, row = order[hit], np.empty(len(hashes), np.int32)
        row[old] = self.rows[place[hit]]
        begin, end = self.ends[row[old]], self.ends[row[old] + 1]
        if (end - begin != size[old]).any() or not T.same_spans(data, starts[old], begin, size[old], self.bytes).all():
            return None
        new = order[~hit]
        if len(new):
            raw = data.tobytes()
            row[new] = self.count + np.arange(len(new), dtype=np.int32)
            self._learn([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.known = np.insert(self.known, place[~hit], hashes[new])
            self.rows = np.insert(self.rows, place[~hit], row[new])
        return row

    def plain(self, texts: list[str]) -> list[bool]:
        """Which texts hold no special token and only characters whose class their bytes show."""
        data, offsets = T.raw(pa.array(texts, pa.string()))
        strange = _STRANGE[data]
        for lead, low, high in ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC9, 0x90, 0xBF)):
            at = np.flatnonzero(data == lead)
            strange[at[(data[at + 1] >= low) & (data[at + 1] <= high)]] = True
        odd = np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1
        fine = np.ones(len(texts), bool)
        fine[odd] = False
        return [bool(ok) and not any(x in t for x in self.special) for ok, t in zip(fine, texts, strict=True)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = self.plain(texts)
        data, offsets = T.raw(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()))
        starts = pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        at = T.codes(data, starts, ends)
        sample = np.empty(int(at.max()) + 1 if len(at) else 0, np.int64)
        sample[at] = np.arange(len(at))
        if self.count + len(sample) > CACHE_PIECES:
            self._clear()
        row = self._rows(data, starts[sample], ends[sample])
        if row is None:
            return [self._whole(t) for t in texts]
        begin = self.bounds[row][at]
        count = self.bounds[row + 1][at] - begin
        ids = self.flat[T.places(begin, count)]
        cut = np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]
        rest = iter(np.split(ids, cut[1:-1]))
        return [next(rest) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    """The array with at least ``size`` places."""
    return array if len(array) >= size else np.append(array, np.zeros(max(size - len(array), len(array) // 2), array.dtype))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def repair(ids: np.ndarray, starts: np.ndarray, first_rule: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, symbols, first symbol of each document): rounds go on until no pair is seen ``least`` times.

    A round replaces all frequent pairs at once; of overlapping occurrences the ones at even places of a run are
    taken. That leaves no occurrence of a frequent pair, so the next round looks at pairs with a new symbol only.
    """
    head = np.zeros(len(ids) + 1, bool)
    head[starts] = True
    symbols, head, rules, fresh = ids.astype(np.uint32), head[:-1], [], 0
    number = first_rule
    while len(symbols) > 1:
        new = symbols >= fresh
        maybe = np.flatnonzero((new[:-1] | new[1:]) & ~head[1:])
        pair = (symbols[maybe].astype(np.uint64) << np.uint64(32)) | symbols[maybe + 1]
        place = ((symbols[maybe] * np.uint32(0x9E3779B1)) ^ (symbols[maybe + 1] * np.uint32(0x85EBCA6B))) >> np.uint32(14)
        often = np.bincount(place, minlength=1 << 18)[place] >= least
        maybe, pair = maybe[often], pair[often]
        kinds, at, count = np.unique(pair, return_inverse=True, return_counts=True)
        good = np.flatnonzero(count >= least)
        if not len(good):
            break
        name = np.full(len(kinds), -1)
        name[good] = number + np.arange(len(good))
        chosen = name[at] >= 0
        where, name = maybe[chosen], name[at][chosen]
        run = np.maximum.accumulate(np.where(np.append(True, np.diff(where) != 1), np.arange(len(where)), 0))
        even = (np.arange(len(where)) - run) % 2 == 0
        where, name = where[even], name[even]
        symbols[where] = name
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols, head = symbols[keep], head[keep]
        rules.append(np.stack([kinds[good] >> np.uint64(32), kinds[good] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        fresh, number = number, number + len(good)
    return np.concatenate([np.empty((0, 2), np.uint32), *rules]), symbols, np.flatnonzero(head)


def expansions(rules: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """(all rules' ids one after another, length of each). A rule's parts are ids or earlier rules."""
    size = np.ones(len(rules), np.int64)
    inner = rules.astype(np.int64) - first_rule
    done = 0
    while done < len(rules):  # a level at a time: rules whose parts are all known
        ready = (inner[done:] < done).all(1)
        level = done + (len(ready) if ready.all() else int(np.argmin(ready)))
        size[done:level] = np.where(inner[done:level] >= 0, size[np.maximum(inner[done:level], 0)], 1).sum(1)
        done = level
    flat = np.arange(first_rule, first_rule + len(rules))
    while len(hit := np.flatnonzero(flat >= first_rule)):
        count = np.ones(len(flat), np.int64)
        count[hit] = 2
        out = np.repeat(flat, count)
        place = (np.cumsum(count) - count)[hit]
        pairs = rules[flat[hit] - first_rule]
        out[place], out[place + 1] = pairs[:, 0], pairs[:, 1]
        flat = out
    return flat.astype(np.uint32), size


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of any run of symbols."""
    if not len(rules):
        return symbols.astype(np.uint32)
    flat, size = expansions(rules, first_rule)
    begin = np.cumsum(size) - size
    rule = symbols.astype(np.int64) - first_rule
    inside = rule >= 0
    length = np.where(inside, size[np.maximum(rule, 0)], 1)
    start = np.where(inside, begin[np.maximum(rule, 0)], len(flat) + np.cumsum(~inside) - 1)
    source = np.concatenate([flat, symbols[~inside].astype(np.uint32)])
    ends = np.cumsum(length)
    return source[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of what a run of symbols stands for.

    Expansion lengths tell where each symbol's ids lie, so only symbols that reach into the range are opened.
    """
    at, flat = 0, symbols.astype(np.int64)
    while True:
        rule = flat - first_rule
        size = np.where(rule >= 0, lengths[np.maximum(rule, 0)] if len(lengths) else 1, 1)
        stop = at + np.cumsum(size)
        low, high = np.searchsorted(stop, begin, "right"), np.searchsorted(stop - size, end, "left")
        at, flat, rule = int((stop - size)[low]) if low < len(flat) else end, flat[low:high], rule[low:high]
        if not (rule >= 0).any():
            return flat[begin - at : end - at].astype(np.uint32) if begin < end else np.empty(0, np.uint32)
        count = np.where(rule >= 0, 2, 1)
        out = np.repeat(flat, count)
        place = (np.cumsum(count) - count)[rule >= 0]
        out[place], out[place + 1] = rules[rule[rule >= 0]].T
        flat = out


def planes(symbols: np.ndarray) -> tuple[int, bytes]:
    """(bytes a symbol, the symbols): their low 16 bits, then their further bytes, as many as the largest has, each by itself."""
    width = max(2, (int(symbols.max(initial=0)).bit_length() + 7) // 8)
    return width, b"".join([symbols.astype("<u2").tobytes(), *((symbols >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(2, width))])


def from_planes(width: int, packed: bytes) -> np.ndarray:
    n = len(packed) // width
    out = np.frombuffer(packed, "<u2", n).astype(np.uint32)
    for k in range(2, width):
        out |= np.frombuffer(packed, np.uint8, n, k * n).astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_shard(file: int, shard: int, keys: list, ids: list[np.ndarray], first_rule: int) -> dict:
    counts = np.array([len(x) for x in ids], np.int64)
    rules, symbols, starts = repair(np.concatenate(ids), np.cumsum(counts) - counts, first_rule)
    _, size = expansions(rules, first_rule)
    width, packed = planes(symbols)
    nulls = sum(k is None for k in keys)  # they come first
    return {"file": file, "shard": shard, "n_docs": len(ids), "n_nulls": nulls, "n_ids": int(counts.sum()), "keys": np.array(keys[nulls:], np.int64).tobytes(), "id_counts": counts.tobytes(), "symbol_counts": np.diff(np.append(starts, len(symbols))).astype(np.int64).tobytes(), "width": width, "first_rule": first_rule, "rules": rules.tobytes(), "lengths": size.astype(np.uint32).tobytes(), "symbols": packed}


def read_document(row: dict, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Random access: ids ``begin`` to ``end`` (its last by default) of the k-th document of a shard."""
    symbols = from_planes(row["width"], row["symbols"])
    ends, size = np.cumsum(np.frombuffer(row["symbol_counts"], np.int64)), int(np.frombuffer(row["id_counts"], np.int64)[k])
    end = size if end is None else min(end, size)
    rules, lengths = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    return expand_range(symbols[ends[k - 1] if k else 0 : ends[k]], rules, lengths, row["first_rule"], begin, end)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary: int = 50_257, files: int | None = None) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ids (null first).

    Null and empty texts hold the end id alone; repeated rows are written each, equal ids in order of their texts;
    an empty table gives a folder without rows. Ids must be integers; other columns are ignored. Files follow the
    bytes of the texts; rows of one id may fill many.
    """
    T.small_batches(docs)
    picked = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("_text"))
    if not files:
        size = picked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        files = max(4, -(-size // max(FILE_BYTES, min(MOST_FILE_BYTES, int((size << 17) ** 0.5)))))
    ordered = picked.repartitionByRange(files, "key", F.substring("_text", 1, PREFIX)).sortWithinPartitions("key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        file, shard, held = TaskContext.get().partitionId(), 0, []
        rows = lambda part: pa.RecordBatch.from_pylist([pack_shard(file, shard, [k for k, _ in part], [x for _, x in part], vocabulary)], schema=arrow)
        size = 0
        for batch in batches:
            for i, j, _, _ in T.slices(batch.column("_text"), SLICE_BYTES):
                texts = [x or "" for x in batch.column("_text").slice(i, j - i).to_pylist()]
                for key, ids in zip(batch.column("key").slice(i, j - i).to_pylist(), enc.ids(texts), strict=True):
                    held.append((key, np.concatenate([ids, end])))
                    size += len(ids) + 1
                    if size >= SHARD_IDS:
                        yield rows(held)
                        shard, held, size = shard + 1, [], 0
        if held:
            yield rows(held)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    ordered.mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): documents from the files, with their place in the sequence of all ids."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()  # a row a file
    begins, total = {}, 0
    for r in sizes:
        begins[r.file], total = total, total + r.n
    first = spark.createDataFrame(sorted(begins.items()), "file int, begin long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("file").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("file", "shard", "n_ids").withColumn("before", before).join(F.broadcast(first), "file").select("file", "shard", (F.col("begin") + F.col("before")).alias("begin"))
    work = shards.join(placed, ["file", "shard"]).select("begin", "n_nulls", "keys", "id_counts", "width", "first_rule", "rules", "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = expand(from_planes(row["width"], row["symbols"]), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), row["first_rule"])
                counts, keys = np.frombuffer(row["id_counts"], np.int64), np.frombuffer(row["keys"], np.int64)
                keys = pa.concat_arrays([pa.nulls(row["n_nulls"], pa.int64()), pa.array(keys)])
                offsets = np.append(0, np.cumsum(counts))
                raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(row["begin"] + offsets[:-1]), pa.array(counts), raw], ["doc_id", "start", "n_tokens", "ids"])

    return work.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
