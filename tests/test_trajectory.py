"""Frames of equal size: found by the header, chosen by filters, written in runs."""

import os
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.sources import trajectory as R


def frame_file(path, frames, n, start=0, every=5, delta=0.5, cell=True, order="<", titles=2, cosines=False):
    rng = np.random.default_rng(7)
    record = lambda b: struct.pack(order + "i", len(b)) + b + struct.pack(order + "i", len(b))
    delta_bits = struct.unpack(order + "i", struct.pack(order + "f", delta))[0]
    out = record(b"CORD" + struct.pack(order + "20i", frames, start, every, *[0] * 6, delta_bits, int(cell), *[0] * 8, 24))
    out += record(struct.pack(order + "i", titles) + b"t".ljust(80 * titles)) + record(struct.pack(order + "i", n))
    places = rng.normal(size=(frames, n, 3)).astype("f4")
    for f in range(frames):
        if cell:
            angles = (0.5, 0.0, -0.5) if cosines else (60.0, 90.0, 120.0)
            out += record(struct.pack(order + "6d", 10.0 + f, angles[2], 20.0, angles[1], angles[0], 30.0))
        for k in range(3):
            out += record(places[f, :, k].astype(order + "f4").tobytes())
    path.write_bytes(out)
    return places


@pytest.mark.parametrize("order", "<>")
def test_frames_and_cells(spark, tmp_path, order):
    p = tmp_path / "a.dcd"
    places = frame_file(p, 9, 11, start=100, order=order, cosines=order == ">")
    got = R.read_frames(spark, str(p), run_bytes=400).collect()
    assert sorted((r.frame_index, r.step, r.time, r.atom_index, r.x, r.y, r.z) for r in got) == [(f, 100 + 5 * f, 0.5 * (100 + 5 * f), i, *map(float, places[f, i])) for f in range(9) for i in range(11)]
    cells = R.read_frames(spark, f"file://{p}", cells=True).orderBy("frame_index").collect()
    assert [(r.frame_index, r.n_atoms, r.a, r.b, r.c) for r in cells] == [(f, 11, 10.0 + f, 20.0, 30.0) for f in range(9)]
    assert [round(v, 9) for v in cells[0][7:]] == [60.0, 90.0, 120.0]


def test_filters_choose_the_bytes_that_are_read(spark, tmp_path):
    p = tmp_path / "a.dcd"
    places = frame_file(p, 12, 5)
    raw = bytearray(p.read_bytes())
    size = 56 + 3 * 28
    begin = len(raw) - 12 * size
    for f in range(12):  # whoever reads another frame finds no record there
        if f not in (5, 6, 7):
            raw[begin + f * size : begin + (f + 1) * size] = b"\xee" * size
    p.write_bytes(raw)
    some = R.read_frames(spark, str(p)).where("frame_index between 5 and 7")
    assert sorted((r.frame_index, r.atom_index, r.x) for r in some.collect()) == [(f, i, float(places[f, i, 0])) for f in (5, 6, 7) for i in range(5)]
    assert R.read_frames(spark, str(p)).where("frame_index in (5, 7) and atom_index >= 3 and x < 1e9").count() == 4
    assert R.read_frames(spark, str(p), cells=True).where("frame_index = 6").first().a == 16.0
    assert R.read_frames(spark, str(p)).where("frame_index > 30").count() == 0
    with pytest.raises(Exception, match="does not hold the coordinates"):
        R.read_frames(spark, str(p)).where("frame_index <= 5").collect()
    reader = R._Reader({"path": str(p), "runbytes": "120"}, False)
    left = list(reader.pushFilters([R.GreaterThanOrEqual(("frame_index",), 5), R.LessThan(("frame_index",), 8), R.GreaterThan(("x",), 0.0)]))
    assert [f.attribute for f in left] == [("x",)]
    assert [(r.first, r.last) for r in reader.partitions()] == [(5, 7), (7, 8)]
    reader = R._Reader({"path": str(p), "runbytes": "24"}, False)
    list(reader.pushFilters([R.In(("frame_index",), (6, 9))]))
    assert [(r.first, r.atom, r.to_atom) for r in reader.partitions()] == [(f, a, min(a + 2, 5)) for f in (6, 9) for a in (0, 2, 4)]


def test_files_that_are_refused(spark, tmp_path):
    p = tmp_path / "a.dcd"
    frame_file(p, 3, 4)
    whole = p.read_bytes()
    for raw, why in ((whole[:-5], "follow the last whole frame"), (b"x" * 200, "CORD"), (whole[:44] + struct.pack("<f", float("inf")) + whole[48:], "time step"), (whole[:40] + struct.pack("<i", 2) + whole[44:], "fixed atoms"), (b"", "CORD")):
        p.write_bytes(raw)
        with pytest.raises(Exception, match=why):
            R.read_frames(spark, str(p)).collect()
    with pytest.raises(Exception, match="nothing"):
        R.read_frames(spark, str(tmp_path / "nothing")).collect()
    os.makedirs(tmp_path / "empty")
    assert R.read_frames(spark, str(tmp_path / "empty")).count() == 0


def test_no_cell_and_one_atom(spark, tmp_path):
    p = tmp_path / "a.dcd"
    places = frame_file(p, 4, 1, cell=False)
    assert [r.z for r in R.read_frames(spark, str(p)).orderBy("frame_index").collect()] == [float(v) for v in places[:, 0, 2]]
    assert R.read_frames(spark, str(p), cells=True).first().a is None


def test_written_frames_come_back(spark, tmp_path):
    n, frames = 50, 23
    coords = spark.range(n * frames).select(F.floor(F.col("id") / n).cast("int").alias("frame_index"), (F.col("id") % n).alias("atom_index"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"))
    boxed = coords.withColumns({"a": 5.0 + F.col("frame_index"), "b": F.lit(6.0), "c": F.lit(7.0), "alpha": F.lit(90.0), "beta": F.lit(80.0), "gamma": F.lit(70.0)})
    path = str(tmp_path / "out")
    R.write_frames(boxed.repartition(7), path, delta=2.0, run_bytes=3000)
    assert len(os.listdir(path)) > 4 and all(f.startswith("frames-") for f in os.listdir(path))
    want = sorted((r.frame_index, r.atom_index, *(float(np.float32(v)) for v in (r.x, r.y, r.z))) for r in coords.collect())
    assert sorted((r.frame_index, r.atom_index, r.x, r.y, r.z) for r in R.read_frames(spark, path).collect()) == want
    cells = R.read_frames(spark, path, cells=True).orderBy("frame_index").collect()
    assert [(r.frame_index, r.time, r.a, r.gamma) for r in cells] == [(f, 2.0 * f, 5.0 + f, 70.0) for f in range(frames)]
    shutil.copy(f"{path}/{sorted(os.listdir(path))[0]}", tmp_path / "one.dcd")
    assert R.read_frames(spark, str(tmp_path / "one.dcd")).where("frame_index = 0").count() == n
    R.write_frames(coords.limit(0), str(tmp_path / "none"))
    assert R.read_frames(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="once each, in order"):
        R.write_frames(coords.where("atom_index <> 3"), str(tmp_path / "gap"))
    with pytest.raises(Exception, match="numbers of atoms"):
        R.write_frames(coords.where("frame_index > 20 or atom_index < 9"), str(tmp_path / "uneven"))
    assert R.read_frames(spark, str(tmp_path / "uneven")).count() == 0


def test_a_growing_folder_as_a_stream(spark, tmp_path):
    path, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(path)

    def trigger():
        query = R.stream_frames(spark, str(path)).select("frame_index", "atom_index", "x").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted((r.frame_index, r.atom_index, r.x) for r in spark.read.schema("frame_index int, atom_index long, x double").parquet(out).collect())

    first = frame_file(path / "frames-0.dcd", 4, 3)
    want = [(f, i, float(first[f, i, 0])) for f in range(4) for i in range(3)]
    assert trigger() == want
    second = frame_file(path / "frames-1.dcd", 2, 3, cell=False)
    want += [(4 + f, i, float(second[f, i, 0])) for f in range(2) for i in range(3)]
    assert trigger() == want
    assert trigger() == want
