"""Binary frames of equal size as a Spark data source: partitions are runs of frames whose bytes follow from the header.

The format is that of Fortran records, each between two copies of its length: a CORD header, titles, the number of
atoms, and for each frame a cell of six numbers, if any, and the x, the y and the z of all atoms as 32-bit floats. All
frames take the same number of bytes, so frame f of a file is found without reading any other. Runs of frames, or of
the atoms of a very large frame, are partitions; filters on ``frame_index`` and ``atom_index`` choose among them.

A folder of such files is one trajectory, its files following each other by name. Files are opened through pyarrow, in
tasks, so their store must be one that pyarrow reaches and that driver and executors share.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

CELL = ("a", "b", "c", "alpha", "beta", "gamma")
#: Bytes of frames in a partition, and of coordinates in a written file.
RUN_BYTES = 64 << 20
_BATCH = 1 << 16
_ATOMS = "frame_index int, step long, time double, atom_index long, x double, y double, z double"
_FRAMES = "frame_index int, step long, time double, n_atoms long, " + ", ".join(f"{c} double" for c in CELL)


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` is a local one too."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def data_files(path: str) -> list[arrow_fs.FileInfo]:
    """The file at a path, or the files of a folder by name; names that begin with a dot or an underscore are passed over."""
    where, inner = located(path)
    found = where.get_file_info(inner)
    if found.type == arrow_fs.FileType.Directory:
        found = [f for f in where.get_file_info(arrow_fs.FileSelector(inner)) if f.is_file and f.base_name[0] not in "._"]
        return sorted(found, key=lambda f: f.base_name)
    if found.type != arrow_fs.FileType.File:
        raise FileNotFoundError(path)
    return [found]


@dataclass(frozen=True)
class Layout:
    """What a file's header says, and where its frames are."""

    order: str
    begin: int
    n_atoms: int
    n_frames: int
    start: int
    every: int
    delta: float
    cell: bool
    fourth: bool

    @property
    def frame_bytes(self) -> int:
        return (56 if self.cell else 0) + (3 + self.fourth) * (4 * self.n_atoms + 8)

    def axis(self, frame: int, k: int, atom: int = 0) -> int:
        """The byte of an atom's x, y or z."""
        return self.begin + frame * self.frame_bytes + (56 if self.cell else 0) + k * (4 * self.n_atoms + 8) + 4 + 4 * atom

    @classmethod
    def of(cls, file: pa.NativeFile, size: int) -> Layout:
        head = file.read(92)
        order = next((o for o in "<>" if len(head) == 92 and struct.unpack(o + "i", head[:4])[0] == 84 and head[4:8] == b"CORD"), None)
        if order is None:
            raise ValueError("the file does not begin with a CORD header")
        numbers = struct.unpack(order + "20i", head[8:88])
        start, every, fixed, charmm = numbers[1], numbers[2], numbers[8], numbers[19] != 0
        delta = struct.unpack(order + "f", head[44:48])[0] if charmm else struct.unpack(order + "d", head[44:52])[0]
        if every <= 0 or not np.isfinite(delta):
            raise ValueError("the header's interval of steps or its time step is no positive number")
        if fixed:
            raise ValueError("files with fixed atoms have frames of different sizes and are not read")
        (titles,) = struct.unpack(order + "i", file.read(4))
        file.seek(92 + titles + 8)
        length, n_atoms = struct.unpack(order + "ii", file.read(8))
        if length != 4 or n_atoms <= 0:
            raise ValueError("the number of atoms is missing")
        begin = 92 + titles + 8 + 12
        found = cls(order, begin, n_atoms, 0, start, every, float(delta), charmm and numbers[10] != 0, charmm and numbers[11] == 1)
        if not found.cell and size >= begin + 56:  # some writers leave the flag out; six doubles are no x of an atom
            file.seek(begin)
            (first,) = struct.unpack(order + "i", file.read(4))
            found = cls(**(found.__dict__ | {"cell": first == 48 and 4 * n_atoms != 48}))
        frames, rest = divmod(size - begin, found.frame_bytes)
        if rest:
            raise ValueError(f"{rest} bytes follow the last whole frame")
        return cls(**(found.__dict__ | {"n_frames": frames}))


def _cell(values: tuple[float, ...]) -> list[float]:
    """a, b, c, alpha, beta, gamma of the record a, gamma, b, beta, alpha, c; angles may be held as cosines."""
    a, gamma, b, beta, alpha, c = values
    angles = [alpha, beta, gamma]
    if all(abs(v) <= 1 for v in angles):
        angles = [90.0 - float(np.degrees(np.arcsin(v))) for v in angles]
    return [a, b, c, *angles]


@dataclass
class Run(InputPartition):
    """Frames of a file, or some atoms of one of them; ``shift`` is the number of frames in the files before."""

    path: str
    layout: Layout
    shift: int
    first: int
    last: int
    atom: int = 0
    to_atom: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict, cells: bool):
        self.path, self.cells, self.run_bytes = options["path"], cells, int(options.get("runbytes", RUN_BYTES))
        self.bounds = {"frame_index": (0, 1 << 62), "atom_index": (0, 1 << 62)}
        self.among: dict[str, set[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name not in self.bounds or (self.cells and name != "frame_index"):
                yield f
                continue
            low, high = self.bounds[name]
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value + 1)
            elif isinstance(f, In):
                self.among[name] = set(f.value) & self.among.get(name, set(f.value))
            elif isinstance(f, GreaterThanOrEqual):
                low = max(low, f.value)
            elif isinstance(f, GreaterThan):
                low = max(low, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                high = min(high, f.value + 1)
            elif isinstance(f, LessThan):
                high = min(high, f.value)
            else:
                yield f
            self.bounds[name] = low, high

    def _chosen(self, low: int, high: int) -> list[tuple[int, int]]:
        """Runs of the frames from low to high that filters leave."""
        low, high = max(low, self.bounds["frame_index"][0]), min(high, self.bounds["frame_index"][1])
        if "frame_index" not in self.among:
            return [(low, high)] if low < high else []
        runs: list[tuple[int, int]] = []
        for f in sorted(x for x in self.among["frame_index"] if low <= x < high):
            runs[-1:] = [(runs[-1][0], f + 1)] if runs and runs[-1][1] == f else [*runs[-1:], (f, f + 1)]
        return runs

    def partitions(self) -> list[Run]:
        where, out, shift = located(self.path)[0], [], 0
        for info in data_files(self.path):
            with where.open_input_file(info.path) as file:
                layout = Layout.of(file, info.size)
            low_atom, high_atom = max(0, self.bounds["atom_index"][0]), min(layout.n_atoms, self.bounds["atom_index"][1])
            each = 56 if self.cells else max(1, 12 * (high_atom - low_atom))
            for a, b in self._chosen(shift, shift + layout.n_frames):
                if not self.cells and low_atom >= high_atom:
                    continue
                if each <= self.run_bytes:
                    step = max(1, self.run_bytes // each)
                    out += [Run(info.path, layout, shift, k - shift, min(k + step, b) - shift, low_atom, high_atom) for k in range(a, b, step)]
                else:  # a frame that fills several partitions
                    step = max(1, self.run_bytes // 12)
                    out += [Run(info.path, layout, shift, f - shift, f - shift + 1, k, min(k + step, high_atom)) for f in range(a, b) for k in range(low_atom, high_atom, step)]
            shift += layout.n_frames
        return out or [Run("", Layout("<", 0, 1, 0, 0, 1, 0.0, False, False), 0, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        with located(self.path)[0].open_input_file(partition.path) as file:
            for frame in range(partition.first, partition.last):
                yield from (self._cells if self.cells else self._atoms)(file, partition, frame)

    def _head(self, p: Run, frame: int) -> tuple[int, int, float]:
        step = p.layout.start + p.layout.every * frame
        return p.shift + frame, step, p.layout.delta * step

    def _cells(self, file: pa.NativeFile, p: Run, frame: int) -> Iterator[pa.RecordBatch]:
        index, step, time = self._head(p, frame)
        cell: list[float | None] = [None] * 6
        if p.layout.cell:
            file.seek(p.layout.begin + frame * p.layout.frame_bytes)
            raw = file.read(56)
            if struct.unpack(p.layout.order + "i", raw[:4])[0] != 48:
                raise ValueError(f"frame {index} has no cell where its header says so")
            cell = _cell(struct.unpack(p.layout.order + "6d", raw[4:52]))
        yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([step], pa.int64()), pa.array([time]), pa.array([p.layout.n_atoms], pa.int64()), *(pa.array([v], pa.float64()) for v in cell)], ["frame_index", "step", "time", "n_atoms", *CELL])

    def _atoms(self, file: pa.NativeFile, p: Run, frame: int) -> Iterator[pa.RecordBatch]:
        index, step, time = self._head(p, frame)
        among = self.among.get("atom_index")
        for k in range(3):
            file.seek(p.layout.axis(frame, k) - 4)
            if struct.unpack(p.layout.order + "i", file.read(4))[0] != 4 * p.layout.n_atoms:
                raise ValueError(f"frame {index} does not hold the coordinates of {p.layout.n_atoms} atoms")
        for a in range(p.atom, p.to_atom, _BATCH):
            n = min(_BATCH, p.to_atom - a)
            place = []
            for k in range(3):
                file.seek(p.layout.axis(frame, k, a))
                place.append(np.frombuffer(file.read(4 * n), p.layout.order + "f4").astype(np.float64))
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, index, np.int32)), pa.array(np.full(n, step, np.int64)), pa.array(np.full(n, time)), pa.array(np.arange(a, a + n)), *map(pa.array, place)], ["frame_index", "step", "time", "atom_index", *"xyz"])
            yield batch if among is None else batch.filter(pa.array(np.isin(np.arange(a, a + n), sorted(among))))


class _Stream(DataSourceStreamReader):
    """Frames of a folder as files come to it; the offset is the number of frames that have been read."""

    def __init__(self, options: dict, cells: bool):
        self.options, self.cells = options, cells

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        where, frames = located(self.options["path"])[0], 0
        for info in data_files(self.options["path"]):
            with where.open_input_file(info.path) as file:
                frames += Layout.of(file, info.size).n_frames
        return {"frames": frames}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        if start["frames"] >= end["frames"]:
            return []
        reader = _Reader(self.options, self.cells)
        reader.bounds["frame_index"] = start["frames"], end["frames"]
        return reader.partitions()

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return _Reader(self.options, self.cells).read(partition)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, with the first frame, the number of frames and of atoms of each."""

    files: list[tuple[str, int, int, int]]


class _Writer(DataSourceArrowWriter):
    """Tasks write whole files of consecutive frames into a folder of their own; the commit names them by their first frames."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.delta, self.overwrite = options["path"], float(options.get("delta", 1.0)), overwrite
        self.run_bytes, self.parts = int(options.get("runbytes", RUN_BYTES)), f"_parts-{uuid.uuid4().hex}"

    def _file(self, frames: list[tuple[int, np.ndarray, tuple | None]]) -> bytes:
        first, n_atoms, boxed = frames[0][0], len(frames[0][1]), frames[0][2] is not None
        record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
        numbers = [len(frames), first, 1, len(frames), *[0] * 5, struct.unpack("<i", struct.pack("<f", self.delta))[0], int(boxed), *[0] * 8, 24]
        out = [record(b"CORD" + struct.pack("<20i", *numbers)), record(struct.pack("<i", 1) + b"frames".ljust(80)), record(struct.pack("<i", n_atoms))]
        for _, places, box in frames:
            if box is not None:
                a, b, c, alpha, beta, gamma = box
                out.append(record(struct.pack("<6d", a, gamma, b, beta, alpha, c)))
            out += [record(np.ascontiguousarray(places[:, k]).tobytes()) for k in range(3)]
        return b"".join(out)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, folder = located(f"{self.path}/{self.parts}")
        where.create_dir(folder)
        files: list[tuple[str, int, int, int]] = []
        frames: list[tuple[int, np.ndarray, tuple | None]] = []
        at, rows, box = None, [], None

        def whole() -> None:
            ids = np.concatenate([r[0] for r in rows])
            if not np.array_equal(ids, np.arange(len(ids))):
                raise ValueError(f"frame {at} does not hold atoms 0, 1, 2 ... once each, in order")
            frames.append((at, np.concatenate([r[1] for r in rows]), box))

        def flush() -> None:
            name = f"{folder}/{uuid.uuid4().hex}"
            with where.open_output_stream(name) as out:
                out.write(self._file(frames))
            files.append((name, frames[0][0], len(frames), len(frames[0][1])))
            frames.clear()

        for batch in batches:
            index = batch.column("frame_index").to_numpy()
            ids = batch.column("atom_index").to_numpy()
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).astype("<f4")
            for part in np.split(np.arange(len(index)), np.flatnonzero(np.diff(index)) + 1):
                if not len(part):
                    continue
                if at != index[part[0]]:
                    if rows:
                        whole()
                    if frames and (frames[-1][0] + 1 != index[part[0]] or sum(f[1].nbytes for f in frames) >= self.run_bytes or len(frames[-1][1]) != len(frames[0][1])):
                        flush()
                    at, rows = int(index[part[0]]), []
                    values = [batch.column(c)[part[0]].as_py() for c in CELL if c in batch.schema.names]
                    box = tuple(values) if len(values) == 6 and None not in values else None
                    if frames and (frames[0][2] is None) != (box is None):
                        flush()
                rows.append((ids[part], places[part]))
        if rows:
            whole()
        if frames:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        ends = [first + n for _, first, n, _ in files]
        if any(end > f[1] for end, f in zip(ends, files[1:])) or len({f[3] for f in files}) > 1:
            self.abort(messages)
            raise ValueError("frames come twice, or hold different numbers of atoms")
        where, folder = located(self.path)
        if self.overwrite:
            for info in where.get_file_info(arrow_fs.FileSelector(folder)):
                if info.is_file:
                    where.delete_file(info.path)
        for name, first, _, _ in files:
            where.move(name, f"{folder}/frames-{first:012d}.dcd")
        where.delete_dir(f"{folder}/{self.parts}")

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = located(f"{self.path}/{self.parts}")
        if where.get_file_info(folder).type == arrow_fs.FileType.Directory:
            where.delete_dir(folder)


class FrameSource(DataSource):
    """``format("dcd")``: rows of atoms, or of frames and their cells with the option ``cells``."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return _FRAMES if self.options.get("cells") == "true" else _ATOMS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self.options.get("cells") == "true")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options), self.options.get("cells") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Let the session read and write this format, and hand filters to it (``spark.sql.python.filterPushdown.enabled``)."""
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_frames(spark: SparkSession, path: str, cells: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(frame_index, step, time, atom_index, x, y, z), or with ``cells`` (frame_index, step, time, n_atoms, a ... gamma).

    Filters of frame_index and atom_index are taken before anything but headers is read. Files that are cut off, have
    another header or fixed atoms are errors; a folder without files gives no rows.
    """
    register(spark)
    return spark.read.format("dcd").option("cells", str(cells).lower()).option("runBytes", str(run_bytes)).load(path)


def stream_frames(spark: SparkSession, path: str, cells: bool = False) -> DataFrame:
    """The frames of a folder as a stream: each trigger reads those of the files that came since, named behind the ones before.

    Files must come whole, as ``write_frames`` and a move bring them.
    """
    register(spark)
    return spark.readStream.format("dcd").option("cells", str(cells).lower()).load(path)


def write_frames(coords: DataFrame, path: str, delta: float = 1.0, run_bytes: int = RUN_BYTES) -> None:
    """Frames (frame_index, atom_index, x, y, z and, if held, a ... gamma) as a folder of files that ``read_frames`` takes for one.

    Atoms must be numbered from 0 in each frame. A frame is put together in one task; consecutive frames share files of
    about ``run_bytes``. A null coordinate is written as no number; an empty table gives an empty folder.
    """
    register(coords.sparkSession)
    boxed = [c for c in CELL if c in coords.columns]
    rows = coords.select(F.col("frame_index").cast("int"), F.col("atom_index").cast("long"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xyz"), *(F.col(c).cast("double") for c in boxed))
    rows.repartitionByRange("frame_index").sortWithinPartitions("frame_index", "atom_index").write.format("dcd").option("delta", str(delta)).option("runBytes", str(run_bytes)).mode("append").save(path)
