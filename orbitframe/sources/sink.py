"""Sections of lines as a Spark data sink: tasks write and count their lines, the commit adds heads that hold the counts.

A written folder holds part files whose names follow the sections and their lines; ``sources.lines`` reads it as one
file. Nothing is counted in a job of its own, and no line passes through the driver. Files of failed or repeated
attempts are never named by a commit and go with the folder that attempts write to. Files are opened through pyarrow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from orbitframe.sources.trajectory import located


@dataclass(frozen=True)
class Section:
    """Lines (value) in the order of whole-number columns, between lines that stay; ``{n}`` in these is the number of its entries.

    A line is one entry, or as many as the column ``entries`` says. ``{n0}``, ``{n1}`` ... are the numbers of the first,
    second ... section.
    """

    lines: DataFrame | None
    order: tuple[str, ...] = ()
    head: tuple[str, ...] = ()
    tail: tuple[str, ...] = ()
    entries: str | None = None


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name, section, place among the section's, entries)."""

    files: list[tuple[str, int, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], f"_parts-{uuid.uuid4().hex}"
        self.fixed = [(options[f"head{k}"], options[f"tail{k}"]) for k in range(int(options["sections"]))]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, folder = located(f"{self.path}/{self.parts}")
        where.create_dir(folder)
        place, out, files = TaskContext.get().partitionId(), None, []
        try:
            for batch in batches:
                sections = batch.column("_part")
                for k in pc.unique(sections).to_pylist():  # a task's rows are sorted by section
                    rows = batch.filter(pc.equal(sections, k))
                    if not files or files[-1][1] != k:
                        if out:
                            out.close()
                        files.append((f"{folder}/{uuid.uuid4().hex}", k, place, 0))
                        out = where.open_output_stream(files[-1][0])
                    text = "\n".join(rows.column("value").to_pylist())
                    out.write(text.encode() + b"\n")
                    files[-1] = (*files[-1][:3], files[-1][3] + (pc.sum(rows.column("_entries")).as_py() or 0))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = located(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1:3])
        counts = [sum(f[3] for f in files if f[1] == k) for k in range(len(self.fixed))]
        for info in where.get_file_info(arrow_fs.FileSelector(folder)):
            if info.is_file:  # what was there before
                where.delete_file(info.path)
        for name, k, place, _ in files:
            where.move(name, f"{folder}/part-{k:03d}-1-{place:07d}.txt")
        for k, both in enumerate(self.fixed):
            for at, text in zip((0, 2), both):
                for j, n in enumerate(counts):
                    text = text.replace(f"{{n{j}}}", str(n))
                if text:
                    with where.open_output_stream(f"{folder}/part-{k:03d}-{at}.txt") as out:
                        out.write(text.replace("{n}", str(counts[k])).encode() + b"\n")
        where.delete_dir(f"{folder}/{self.parts}")

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = located(f"{self.path}/{self.parts}")
        if where.get_file_info(folder).type == arrow_fs.FileType.Directory:
            where.delete_dir(folder)


class SectionSink(DataSource):
    """``format("sections")``, for writing only."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return "_part int, value string, _entries long"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_sections(spark: SparkSession, path: str, *sections: Section) -> None:
    """Write sections one after another as one text; what the folder held before goes when all is written.

    A null line is blank; a section without lines leaves its head and tail. Rows that agree in all order columns come in
    any order.
    """
    spark.dataSource.register(SectionSink)
    options = {"sections": str(len(sections))} | {f"{side}{k}": "\n".join(getattr(s, side)) for k, s in enumerate(sections) for side in ("head", "tail")}
    width = max((len(s.order) for s in sections), default=0)
    rows = []
    for k, s in enumerate(sections):
        if s.lines is not None:
            key = [F.col(c).cast("long") for c in s.order] + [F.lit(0).cast("long")] * (width - len(s.order))
            entries = F.lit(1).cast("long") if s.entries is None else F.col(s.entries).cast("long")
            rows.append(s.lines.select(F.lit(k).alias("_part"), *(c.alias(f"_k{j}") for j, c in enumerate(key)), F.coalesce("value", F.lit("")).alias("value"), entries.alias("_entries")))
    keys = ["_part", *(f"_k{j}" for j in range(width))]
    every = reduce(DataFrame.union, rows) if rows else spark.createDataFrame([], ", ".join(f"{c} {'int' if c == '_part' else 'long'}" for c in keys) + ", value string, _entries long")
    every.orderBy(keys).select("_part", "value", "_entries").write.format("sections").options(**options).mode("append").save(path)
