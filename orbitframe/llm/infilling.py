"""Operator 13: fill-in-the-middle, with cuts found through a sparse index of checkpoints.

Units are runs of A-Z letters and single other code points. While a text's units are counted, every ``EVERY``-th one
leaves a checkpoint: its number, its byte and its code point. A cut is found by binary search among the checkpoints
and a short scan from there on, so no list of all units is held, however long the text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orbitframe.llm import text as T

EVERY, WINDOW = 256, 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MADE = ("n_units", "form", "prefix_chars", "middle_chars")


def _starts(part: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(where a unit begins, where a code point begins) among some bytes; ``inside``: the byte before is a letter."""
    letter, lead = _LETTER[part], (part & 0xC0) != 0x80
    before = np.append(inside, letter[:-1])
    return lead & ~(letter & before), lead


@dataclass(frozen=True)
class Checkpoints:
    """Places of every so many units of a text, and its sizes."""

    units: np.ndarray
    bytes: np.ndarray
    chars: np.ndarray
    n_units: int
    n_chars: int

    @classmethod
    def of(cls, data: np.ndarray, every: int = EVERY) -> Checkpoints:
        units, chars, inside, marks = 0, 0, False, []
        for a in range(0, len(data), WINDOW):
            start, lead = _starts(data[a : a + WINDOW], inside)
            at = np.flatnonzero(start)
            pick = at[-units % every :: every]
            if len(pick):
                marks.append((units + -units % every + every * np.arange(len(pick)), a + pick, chars + np.cumsum(lead)[pick] - 1))
            units, chars, inside = units + len(at), chars + int(lead.sum()), bool(_LETTER[data[min(a + WINDOW, len(data)) - 1]])
        held = (np.concatenate(x) for x in zip(*marks)) if marks else (np.zeros(0, np.int64) for _ in range(3))
        return cls(*held, units, chars)

    def find(self, data: np.ndarray, unit: int) -> tuple[int, int]:
        """(byte, code point) where a unit begins; the text's end for the number behind the last one."""
        if unit >= self.n_units:
            return len(data), self.n_chars
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        byte, char, left = int(self.bytes[k]), int(self.chars[k]), unit - int(self.units[k])
        inside = False  # a unit begins here whatever precedes it
        while True:
            start, lead = _starts(data[byte : byte + WINDOW], inside)
            at = np.flatnonzero(start)
            if left < len(at):
                return byte + int(at[left]), char + int(lead[: at[left]].sum())
            left, char, inside = left - len(at), char + int(lead.sum()), bool(_LETTER[data[min(byte + WINDOW, len(data)) - 1]])
            byte += WINDOW


def rearranged(data: np.ndarray, draws: tuple[int, int, int, int], plain: int, spm: int) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, units, form, code points of the prefix, of the middle) of one text."""
    raw, index = data.tobytes(), Checkpoints.of(data)
    n = index.n_units
    if not raw or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= 100 - plain:
        return raw, n, "plain", None, None
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (p, pc), (q, qc) = index.find(data, low), index.find(data, high)
    prefix, middle, suffix = raw[:p], raw[p:q], raw[q:]
    if draws[3] % 100 < spm:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), n, "spm", pc, qc - pc
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), n, "psm", pc, qc - pc


def _draws(seed: int, key: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """All columns of docs with the text rearranged, and ``n_units``, ``form``, ``prefix_chars``, ``middle_chars``.

    Cuts and forms follow from seed and id alone: ``plain`` texts in a hundred stay as they are, and so do empty ones
    (null counts as empty) and those that hold a marker; of the others ``spm`` in a hundred begin with the suffix.
    Repeated rows come out alike; rows without an id share one draw; columns of the four names are replaced; an empty
    table gives an empty result. Map-only.
    """
    T.small_batches(docs)
    docs = docs.drop(*_MADE)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, ids = names.index(text_col), batch.column(id_col)
            for i, j, data, offsets in T.slices(batch.column(text_col)):
                made = [rearranged(data[offsets[k] : offsets[k + 1]], _draws(seed, ids[i + k].as_py()), plain, spm) for k in range(j - i)]
                text, n, form, prefix, middle = zip(*made)
                columns = list(batch.slice(i, j - i).columns)
                columns[place] = pa.array(text, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], [*names, *_MADE])

    kinds = StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema])
    return docs.mapInArrow(run, StructType([*kinds, *(StructField(c, StringType() if c == "form" else LongType()) for c in _MADE)]))


def restored(text: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` came from."""
    part = F.split(text, "<[PSM]>")
    return F.when(form == "plain", text).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
