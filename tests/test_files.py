"""Whole systems through files, the sink's counts, and reading rules of single formats."""

import os

import pytest
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Box, cell_vectors, cell_volume
from orbitframe.operators import neighbors, topology
from orbitframe.sources import amber, sections, structures, systems
from orbitframe.sources.sink import Section, write_sections
from orbitframe.universe import Universe


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def system(spark, n=40, frames=3):
    atoms = spark.range(n).select(F.col("id").alias("atom_index"), F.concat(F.lit("C"), F.col("id") % 10).alias("name"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("resid"), F.lit("ALA").alias("resname"), F.lit("S").alias("segid"), F.lit("A").alias("chain_id"), F.lit("C").alias("element"), F.lit(12.011).alias("mass"), F.lit(0.5).alias("charge"), F.lit("CT").alias("atom_type"))
    coords = spark.range(n * frames).select(F.floor(F.col("id") / n).cast("int").alias("frame_index"), (F.col("id") % n).alias("atom_index"), *(F.round(F.rand(k) * 9, 3).alias(c) for k, c in enumerate("xyz")))
    bonds = spark.range(n - 1).select(F.col("id").alias("atom1"), (F.col("id") + 1).alias("atom2"))
    boxes = spark.range(frames).select(F.col("id").cast("int").alias("frame_index"), *(F.lit(v).alias(c) for c, v in zip(systems.CELL, (10.0, 11.0, 12.0, 90.0, 90.0, 90.0))))
    return Universe(atoms, coords, bonds, boxes)


def lines(path):
    return "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if not f.startswith("."))


@pytest.mark.parametrize("kind", ["pdb", "pdbqt", "pqr", "gro", "xyz", "crd", "mol2", "config", "history"])
def test_systems_come_back(spark, tmp_path, kind):
    u, path = system(spark), str(tmp_path / f"s.{kind}")
    systems.write_system(u, path, frame=1)
    got = systems.read_system(spark, path, kind=None if kind != "history" else "config") if kind != "history" else None
    if kind == "history":
        systems.write_system(u, str(tmp_path / "s.xyz"))
        got = systems.read_system(spark, str(tmp_path / "s.xyz"), path)
    places = {(r.frame_index, r.atom_index): (r.x, r.y, r.z) for r in u.coords.collect()}
    found = {(r.frame_index, r.atom_index): (r.x, r.y, r.z) for r in got.coords.collect()}
    if kind == "history":
        assert found.keys() == places.keys() and all(found[k] == pytest.approx(places[k], abs=1e-9) for k in places)
    else:
        assert {k[1] for k in found} == set(range(40)) and all(found[0, k] == pytest.approx(places[1, k], abs=6e-4) for k in range(40))
    if kind != "history":
        assert {r.name for r in got.atoms.collect()} == {f"C{k}" for k in range(10)}
    if kind in ("pdb", "mol2"):
        assert {(r.atom1, r.atom2) for r in got.bonds.collect()} == {(k, k + 1) for k in range(39)}
    if kind in ("pdb", "pdbqt", "gro", "config", "history"):
        assert {tuple(round(r[c], 4) for c in systems.CELL) for r in got.boxes.collect()} == {(10.0, 11.0, 12.0, 90.0, 90.0, 90.0)}
    os.listdir(path)
    assert not any(f.startswith("_parts") for f in os.listdir(path))


def test_topologies_with_frames(spark, tmp_path):
    u = system(spark)
    systems.write_system(u, str(tmp_path / "s.psf"))
    systems.write_system(u, str(tmp_path / "s.crd"))
    got = systems.read_system(spark, str(tmp_path / "s.psf"), str(tmp_path / "s.crd"))
    assert got.bonds.count() == 39 and got.frame(0).where("mass = 12.011 and x is not null").count() == 40
    assert systems.read_system(spark, str(tmp_path / "s.psf")).coords.where("x is null").count() == 40
    data = put(tmp_path, "a.data", "t\n\n2 atoms\n\n0 5 xlo xhi\n0 6 ylo yhi\n0 7 zlo zhi\n\nMasses\n\n1 12.0\n\nAtoms\n\n9 3 1 0.5 1 2 3\n4 2 1 -0.5 4 5 6\n\nBonds\n\n1 1 9 4\n")
    dump = put(tmp_path, "a.dump", "".join(f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 20\n0 5\nITEM: ATOMS id x y z\n9 9 {t} 0\n4 4 {t} 0\n" for t in (1, 2)))
    got = systems.read_system(spark, data, dump)
    assert sorted((r.frame_index, r.atom_index, r.x) for r in got.coords.collect()) == [(0, 0, 4.0), (0, 1, 9.0), (1, 0, 4.0), (1, 1, 9.0)]
    assert [tuple(r) for r in got.bonds.collect()] == [(1, 0)] and {r.b for r in got.boxes.collect()} == {20.0}
    with pytest.raises(ValueError, match="no kind"):
        systems.read_system(spark, "a.what")
    with pytest.raises(ValueError, match="no atoms"):
        systems.read_system(spark, "a.dcd")
    with pytest.raises(ValueError, match="no frames"):
        systems.read_system(spark, data, "a.psf")
    with pytest.raises(ValueError, match="not written"):
        systems.write_system(u, str(tmp_path / "s.itp"))


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    os.makedirs(path)
    put(tmp_path / "out", "part-old", "gone\n")
    rows = spark.range(1000).select((999 - F.col("id")).alias("k"), F.concat(F.lit("l"), 999 - F.col("id")).alias("value"), (F.col("id") % 2).alias("e")).repartition(5)
    write_sections(spark, path, Section(rows, ("k",), ("first {n}", "next {n1}"), ("end {n0}",), entries="e"), Section(spark.createDataFrame([(1, None), (0, "z")], "k int, value string"), ("k",)), Section(None, head=("none {n}",)))
    assert lines(path) == "first 500\nnext 2\n" + "".join(f"l{k}\n" for k in range(1000)) + "end 500\nz\n\nnone 0\n"
    bad = rows.withColumn("value", F.when(F.col("k") == 700, F.raise_error(F.lit("no room"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no room"):
        write_sections(spark, path, Section(bad, ("k",)))
    assert lines(path).startswith("first 500")  # a failed write leaves what was there


def test_serials_of_stars(spark, tmp_path):
    atom = "ATOM  {:>5}  CA  ALA A   1       0.000   0.000   0.000  1.00  0.00           C\n"
    p = put(tmp_path, "a.pdb", "".join(atom.format(s) for s in ("*****", "99998", "99999", "*****", "*****", "7")) + "CONECT999999999899999\n")
    assert [r.serial for r in structures.read_pdb(spark, p).orderBy("atom_index").collect()] == [None, 99998, 99999, 100000, 100001, 7]


def test_gromos_boxes_that_are_refused(spark, tmp_path):
    text = "TIMESTEP\n 1 0.5\nEND\nPOSITIONRED\n 1 2 3\nEND\nGENBOX\n {}\n 4 5 6\n 90 90 90\n {}\n 0 0 0\nEND\n"
    assert amber.read_gromos_box(spark, put(tmp_path, "a.trc", text.format(1, "0 0 0"))).first().c == 6.0
    for kind, moved, why in ((-1, "0 0 0", "octahedra"), (5, "0 0 0", "unknown kind"), (1, "0 0.5 0", "shifted")):
        with pytest.raises(Exception, match=why):
            amber.read_gromos_box(spark, put(tmp_path, "a.trc", text.format(kind, moved))).collect()
    assert amber.read_gromos_box(spark, put(tmp_path, "a.trc", text.format(0, "0 0 0"))).count() == 0


def test_lammps_styles_and_corner(spark, tmp_path):
    for name, row, style in (("full", "7 2 1 0.5 1 2 3", None), ("", "7 2 1 0.5 1 2 3 0 0 0", None), ("charge", "7 1 0.5 1 2 3", None), ("", "7 2 1 1 2 3", None), ("atomic", "7 1 1 2 3", None), ("x y z q type id", "1 2 3 0.5 1 7", None), ("full", "0.5 3 2 1 1 7", "q z y x type id")):
        p = put(tmp_path, "a.data", f"Atoms of a title\n\n1 atoms\n\nAtoms # {name}\n\n{row}\n")
        r = sections.read_lammps_data(spark, p, style).first()
        assert (r.id, r.atom_type, r.x, r.y, r.z) == (7, "1", 1.0, 2.0, 3.0)
        assert r.charge == (0.5 if "0.5" in row else None) and r.resid == (2 if " 2 1 " in row and row.startswith("7") else 1)
    with pytest.raises(Exception, match="lacks"):
        sections.read_lammps_data(spark, p, "id x y z").collect()
    for cols, x in (("x", 3.0), ("xs", 0.0), ("xu", 3.0)):
        p = put(tmp_path, "a.dump", f"ITEM: TIMESTEP\n1\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n2 12\n0 10\n0 10\nITEM: ATOMS id {cols} {cols.replace('x', 'y')} {cols.replace('x', 'z')}\n1 {0.2 if cols == 'xs' else 5} 0.1 0.1\n")
        assert sections.read_lammps_dump(spark, p, corner=True).first().x == pytest.approx(x)


def test_cells_in_rows(spark):
    cells = [(5.0, 6.0, 7.0, 90.0, 80.0, 70.0), (3.0, 4.0, 5.0, 90.0, 90.0, 90.0), (2.0, 10.0, 10.0, 90.0, 30.0, 40.0), (0.0, 1.0, 1.0, 90.0, 90.0, 90.0), (1.0, 1.0, 1.0, 180.0, 90.0, 90.0), (None, 1.0, 1.0, 90.0, 90.0, 90.0)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cells)], "k int, " + ", ".join(f"{c} double" for c in systems.CELL))
    c = [F.col(x) for x in systems.CELL]
    got = {r.k: r for r in rows.select("k", cell_volume(*c).alias("v"), *(a.alias(f"m{i}") for i, u in enumerate(cell_vectors(*c)) for a in [F.array(*u)])).collect()}
    for k in (0, 1):
        box = Box(*cells[k])
        assert got[k].v == pytest.approx(box.volume()) and [list(got[k][f"m{i}"]) for i in range(3)] == [pytest.approx(v) for v in box.vectors()]
    assert all(got[k].v == 0 for k in (2, 3, 4, 5))


def test_contact_bitmaps_hold_each_contact(spark):
    atoms = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in (0, 1, 2, 32767, 32768, 32769, 70000)], "atom_index long, x double, y double, z double")
    got = {(r.atom_index, r.bucket): r.contacts for r in neighbors.contact_bitmaps(atoms, 1.0).collect()}
    bits = {(i, (b - 1) * 32768 + k) for (i, b), raw in got.items() for k in range(8 * len(raw)) if raw[k // 8] >> (k % 8) & 1}
    assert bits == {(i, j) for i in (0, 1, 2, 32767, 32768, 32769) for j in (i - 1, i + 1) if j in (0, 1, 2, 32767, 32768, 32769)}
    matrix = {(r.atom_index, k) for r in neighbors.contact_matrix(atoms, 1.0).collect() for k, hit in zip((0, 1, 2, 32767, 32768, 32769, 70000), r.contacts) if hit}
    assert matrix == bits


def test_unique_atoms(spark):
    groups = spark.createDataFrame([(5, 3, 9), (3, None, 1), (0, 5, 5)], "a long, b long, c long")
    assert [r.atom_index for r in topology.unique_atoms(groups, ("a", "b", "c")).orderBy("place").collect()] == [0, 5, 3, 1, 9]


def test_groups_together_for_a_global_text(spark):
    u = system(spark, 8, 1)
    named = {"a": u.atoms.where("atom_index < 3").select("atom_index"), "b": u.atoms.where("atom_index in (2, 6)").select("atom_index")}
    among = u.atoms.where("atom_index = 7").select("atom_index")
    pick = lambda text: sorted(r.atom_index for r in u.select(text, among=among, groups=named).collect())
    assert pick("global all") == [0, 1, 2, 6] and pick("all") == [7] and pick("global not group a") == [6]
