"""Small files of every sectioned format."""

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import selection
from orbitframe.sources import sections as R
from orbitframe.sources import structures
from orbitframe.universe import Universe


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df, *columns, order="atom_index"):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r[order])]


def test_mol2(spark, tmp_path):
    p = put(tmp_path, "a.mol2", "@<TRIPOS>MOLECULE\nx\n 2 1\n@<TRIPOS>ATOM\n 1 CA 1.0 2.0 3.0 C.3 1 ALA1 0.5\n 5 N 4.0 5.0 6.0 N.ar\n@<TRIPOS>BOND\n 1 1 5 ar\n")
    assert rows(R.read_mol2_atoms(spark, p), "name", "x", "resid", "resname", "charge") == [("CA", 1.0, 1, "ALA1", 0.5), ("N", 4.0, 1, "UNK", None)]
    assert rows(R.read_mol2_bonds(spark, p), "atom1", "atom2", "order", order="atom1") == [(0, 1, None)]


def test_psf_crd_pdbqt(spark, tmp_path):
    p = put(tmp_path, "a.psf", "PSF\n\n 1 !NTITLE\n t\n\n 2 !NATOM\n 1 SEG 7 ALA CA CT1 -1.5D-01 12.011 0\n 2 SEG 7A ALA N NH1 0.1 14.007 0\n\n 0 !NBOND: bonds\n")
    assert rows(R.read_psf_atoms(spark, p), "segid", "resid", "name", "charge", "mass") == [("SEG", 7, "CA", -0.15, 12.011), ("SEG", 7, "N", 0.1, 14.007)]
    p = put(tmp_path, "a.crd", "* title\n*\n    2\n    1    1 ALA  N      1.00000   2.00000   3.00000 MAIN 1      0.00000\n    2    1 ALA  CA     4.00000   5.00000   6.00000 MAIN 1      0.00000\n")
    assert rows(R.read_crd(spark, p), "name", "z", "segid", "resid") == [("N", 3.0, "MAIN", 1), ("CA", 6.0, "MAIN", 1)]
    line = "ATOM      1  CA  ALA A   5      11.104   6.134  -6.504  1.00 20.00     0.250 C "
    p = put(tmp_path, "a.pdbqt", f"REMARK x\n{line}\nEND\n{line}\n")
    assert rows(R.read_pdbqt(spark, p), "name", "resid", "x", "charge", "atom_type") == [("CA", 5, 11.104, 0.25, "C")]


def test_lammps(spark, tmp_path):
    p = put(tmp_path, "a.data", "title\n\n2 atoms\n1 atom types\n\nMasses\n\n1 12.011\n\nAtoms # full\n\n9 3 1 0.5 1 2 3\n4 2 1 -0.5 4 5 6\n\nBonds\n\n1 2 9 4\n")
    assert rows(R.read_lammps_data(spark, p), "id", "name", "resid", "mass", "charge", "x") == [(4, "TYPE1", 2, 12.011, -0.5, 4.0), (9, "TYPE1", 3, 12.011, 0.5, 1.0)]
    assert rows(R.read_lammps_bonds(spark, p), "id1", "id2", "order", order="id1") == [(9, 4, 2)]
    frame = "ITEM: TIMESTEP\n{}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 20\n-5 5\nITEM: ATOMS id type {}\n7 1 0.5 0.5 0.5\n3 1 0.1 0.1 0.1\n"
    p = put(tmp_path, "a.dump", frame.format(100, "xs ys zs") + frame.format(200, "x y z"))
    got = R.read_lammps_dump(spark, p).orderBy("frame_index", "atom_index").collect()
    assert [(r.frame_index, r.step, r.atom_index, r.id, r.x, r.y, r.z) for r in got] == [(0, 100, 0, 3, 1.0, 2.0, -4.0), (0, 100, 1, 7, 5.0, 10.0, 0.0), (1, 200, 0, 3, 0.1, 0.1, 0.1), (1, 200, 1, 7, 0.5, 0.5, 0.5)]


def test_tinker_inpcrd_aims(spark, tmp_path):
    one = "2 title\n 30.0 30.0 30.0 90.0 90.0 90.0\n 1 O 1.0 2.0 3.0 5 2\n 2 H 4.0 5.0 6.0 6 1\n"
    got = R.read_tinker(spark, put(tmp_path, "a.arc", one + one)).orderBy("frame_index", "atom_index").collect()
    assert [(r.frame_index, r.atom_index, r.name, r.x, r.atom_type, r.partners) for r in got] == [(f, k, n, x, t, p) for f in (0, 1) for k, n, x, t, p in ((0, "O", 1.0, "5", [2]), (1, "H", 4.0, "6", [1]))]
    p = put(tmp_path, "a.rst", "title\n    3 0.0\n" + "".join(f"{v:12.7f}" for v in range(1, 7)) + "\n" + "".join(f"{v:12.7f}" for v in (-7, 8, 9)) + "\n  10.0000000  10.0000000  10.0000000\n")
    assert rows(R.read_inpcrd(spark, p), "x", "y", "z") == [(1, 2, 3), (4, 5, 6), (-7, 8, 9)]
    p = put(tmp_path, "g.in", "# c\nlattice_vector 10 0 0\nlattice_vector 0 20 0\nlattice_vector 0 0 30\natom_frac 0.5 0.5 0.5 C\natom 1 2 3 N\n")
    assert rows(R.read_aims(spark, p), "name", "x", "y", "z") == [("C", 5, 10, 15), ("N", 1, 2, 3)]


def test_dlpoly_and_hoomd(spark, tmp_path):
    p = put(tmp_path, "CONFIG", "title\n 1 1\n10 0 0\n0 10 0\n0 0 10\nNa 2\n4 5 6\n0 0 0\nCl 1\n1.0D0 2 3\n0 0 0\n")
    assert rows(R.read_dlpoly_config(spark, p), "name", "x", "z") == [("Cl", 1.0, 3.0), ("Na", 4.0, 6.0)]
    p = put(tmp_path, "a.xml", '<hoomd_xml><configuration><position num="2">\n1 2 3\n4 5 6\n</position><type>A\nB</type><diameter>2 4</diameter></configuration></hoomd_xml>')
    assert rows(R.read_hoomd_xml(spark, p), "name", "x", "mass", "radius") == [("A", 1, 1, 1), ("B", 4, 1, 2)]


def test_lines_read_back(spark, tmp_path):
    atoms = spark.createDataFrame([(0, 1.25, -2.5, 3.0, "CA", "ALA", "S", 1, 0.5, "C.3"), (1, 4.0, 5.0, 6.0, "N", "GLY", "S", 2, -0.5, "N.3"), (2, 7.0, 8.0, 9.0, "O", "GLY", "S", 2, 0.0, "O.2")], "atom_index long, x double, y double, z double, name string, resname string, segid string, resid int, charge double, atom_type string")
    want = rows(atoms, "x", "y", "z")
    for name, lines, head, read, order in (("crd", R.crd_lines(atoms), ["* t", "*", "    3"], R.read_crd, "atom_index"), ("mol2", R.mol2_lines(atoms), ["@<TRIPOS>ATOM"], R.read_mol2_atoms, "atom_index"), ("rst", R.inpcrd_lines(atoms), ["t", "    3"], R.read_inpcrd, "n"), ("in", R.aims_lines(atoms), ["# t"], R.read_aims, "atom_index")):
        structures.write_lines(lines, str(tmp_path / name), order, head=head)
        assert rows(read(spark, str(tmp_path / name)), "x", "y", "z") == want, name


def test_universe(spark):
    atoms = spark.createDataFrame([(0, "CA"), (1, "N")], "atom_index long, name string")
    coords = spark.createDataFrame([(f, i, float(f), 0.0, 0.0) for f in range(3) for i in range(2)], "frame_index int, atom_index long, x double, y double, z double")
    u = Universe(atoms, coords, spark.createDataFrame([(0, 1)], "atom1 long, atom2 long"))
    assert {r.x for r in u.frame(-1).collect()} == {2.0}
    assert [r.atom_index for r in u.select(selection.matches("name", "C*"), frame=1).collect()] == [0]
    assert [r.atom_index for r in u.bonded_to(F.col("name") == "CA").collect()] == [1]
    assert u.with_frames(coords).coords.agg(F.max("frame_index")).first()[0] == 5
    assert R.attach(atoms, coords).count() == 6
    with pytest.raises(Exception, match="other atoms than the topology"):
        R.attach(atoms.limit(1), coords).collect()
    same = R.attach(atoms.selectExpr("*", "atom_index + 5 as id"), coords.selectExpr("*", "atom_index + 5 as id"), ids=True)
    assert same.count() == 6 and "id" in same.columns
    with pytest.raises(Exception, match="other atoms than the topology"):
        R.attach(atoms.selectExpr("*", "atom_index + 6 as id"), coords.selectExpr("*", "atom_index + 5 as id"), ids=True).collect()


def test_pdb_records(spark, tmp_path):
    line = "ATOM  {:>5} {:<4} {:<3} {:1}{:>4}{:1}   {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    atoms = [("1", " CA", "ALA", "A", "9998", " ", 1, 2, 3), ("99999", " N", "ALA", "A", "9999", " ", 4, 5, 6), ("A0000", " C", "ALA", "A", "0", " ", 7, 8, 9), ("A0001", " O", "ALA", "A", "1", "B", 1, 1, 1)]
    text = "CRYST1    1.000    1.000    1.000  90.00  90.00  90.00 P 1\nCRYST1   10.000   20.000   30.000  90.00  80.00  70.00 P 1\n" + "\n".join(line.format(*a) for a in atoms) + "\nCONECT    199999\nCONECTA000099999A0001\nCONECT    1   77\nEND\n"
    p = put(tmp_path, "a.pdb", text)
    assert rows(structures.read_pdb(spark, p), "serial", "name", "resid", "insertion_code", "x") == [(1, "CA", 9998, None, 1.0), (99999, "N", 9999, None, 4.0), (100000, "C", 10000, None, 7.0), (100001, "O", 10001, "B", 1.0)]
    assert rows(structures.read_pdb_bonds(spark, p), "atom1", "atom2", order="atom2") == [(0, 1), (1, 2), (2, 3)][:1] + [(1, 2), (2, 3)]
    assert [tuple(r)[1:] for r in structures.read_pdb_box(spark, p).collect()] == [(10.0, 20.0, 30.0, 90.0, 80.0, 70.0)]
    wide = put(tmp_path, "b.pdb", line.format("1", " CA", "ALA", "A", "1234", "5", 1, 2, 3) + "\n" + line.format("2", " N", "ALA", "A", "A000", " ", 1, 2, 3) + "\n")
    assert rows(structures.read_pdb(spark, wide), "resid", "insertion_code") == [(12345, None), (10000, None)]
    models = put(tmp_path, "c.pdb", "".join(f"MODEL {m}\n" + "\n".join(line.format(*a) for a in atoms) + "\nENDMDL\n" for m in (1, 2, 3)))
    got = structures.read_pdb(spark, models).collect()
    assert sorted((r.frame_index, r.atom_index) for r in got) == [(m, k) for m in range(3) for k in range(4)]
    empty = put(tmp_path, "d.pdb", "")
    assert structures.read_pdb(spark, empty).count() == structures.read_pdb_bonds(spark, empty).count() == structures.read_pdb_box(spark, empty).count() == 0


def test_long_files_are_read_in_blocks(spark, tmp_path):
    """Blocks of 200 bytes: line numbers, models, sections and counts go on from block to block."""
    line = "ATOM  {:>5}  CA  ALA A   1    {:8.3f}   0.000   0.000"
    p = put(tmp_path, "a.pdb", "".join(f"MODEL {m}\n" + "".join(line.format(k + 1, k) + "\n" for k in range(40)) + "ENDMDL\n" for m in range(5)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "200b")
        got = sorted((r.frame_index, r.atom_index, r.x) for r in structures.read_pdb(spark, p).collect())
        assert got == [(m, k, float(k)) for m in range(5) for k in range(40)]
        from orbitframe.sources.lines import read_lines

        seen = sorted((r.n, r.line) for r in read_lines(spark, p).collect())
        assert [n for n, _ in seen] == list(range(210)) and len({r.block for r in read_lines(spark, p).collect()}) > 20
        assert [x for _, x in seen] == open(p).read().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_boxes_and_velocities(spark, tmp_path):
    atom = "{:>5}{:<5}{:>5}{:>5}{:8.3f}{:8.3f}{:8.3f}{:8.4f}{:8.4f}{:8.4f}\n"
    frame = "title\n2\n" + atom.format(99999, "SOL", "OW", 1, 1, 2, 3, 0.1, 0.2, 0.3) + atom.format(0, "SOL", "HW", 2, 4, 5, 6, 0, 0, 0)
    p = put(tmp_path, "a.gro", frame + "1.0 2.0 3.0\n" + frame + "1.0 2.0 3.0 0 0 0 0 0 1.0\n")
    got = structures.read_gro(spark, p).orderBy("frame_index", "atom_index").collect()
    assert [(r.frame_index, r.resid, r.name, r.x, r.vy) for r in got] == [(f, n, a, x, v) for f in (0, 1) for n, a, x, v in ((99999, "OW", 1.0, 0.2), (100000, "HW", 4.0, 0.0))]
    boxes = structures.read_gro_box(spark, p).orderBy("frame_index").collect()
    assert tuple(boxes[0])[2:] == (1.0, 2.0, 3.0, 90.0, 90.0, 90.0) and boxes[1].alpha == pytest.approx(71.56505118)
    values = lambda *v: "".join(f"{x:12.7f}" for x in v) + "\n"
    p = put(tmp_path, "v.rst", "t\n    3 0.5\n" + values(*range(1, 7)) + values(7, 8, 9) + values(*range(11, 17)) + values(17, 18, 19) + values(10, 20, 30, 90, 80, 70))
    assert rows(R.read_inpcrd(spark, p), "x", "z", "vx", "vz") == [(1, 3, 11, 13), (4, 6, 14, 16), (7, 9, 17, 19)]
    assert [tuple(r)[1:] for r in R.read_inpcrd_box(spark, p).collect()] == [(10, 20, 30, 90, 80, 70)]
    p = put(tmp_path, "v.data", "t\n\n1 atoms\n0 10 xlo xhi\n0 10 ylo yhi\n-5 5 zlo zhi\n5 0 0 xy xz yz\n\nAtoms\n\n4 2 1 -0.5 4 5 6\n\nVelocities\n\n4 0.1 0.2 0.3\n")
    assert rows(R.read_lammps_data(spark, p), "id", "vx", "vz") == [(4, 0.1, 0.3)]
    box = R.read_lammps_box(spark, p).first()
    assert (box.a, box.c, box.alpha) == (10.0, 10.0, 90.0) and box.b == pytest.approx(125**0.5) and box.gamma == pytest.approx(63.43494882)
    p = put(tmp_path, "t.dump", "ITEM: TIMESTEP\n7\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 15 5\n0 10 0\n-5 5 0\nITEM: ATOMS id xs ys zs vx\n1 0.5 0.5 0.5 2\n")
    got = R.read_lammps_dump(spark, p).first()
    assert (got.x, got.y, got.z, got.vx, got.vy) == (7.5, 5.0, 0.0, 2.0, None)
    assert R.read_lammps_dump_box(spark, p).first().gamma == pytest.approx(63.43494882)
    p = put(tmp_path, "h.in", "lattice_vector 10 0 0\nlattice_vector 0 20 0\nlattice_vector 0 0 30\natom 1 2 3 N\nvelocity 4 5 6\natom 7 8 9 O\n")
    assert rows(R.read_aims(spark, p), "x", "vx", "vz") == [(1, 4, 6), (7, None, None)]
    assert R.read_aims_box(spark, p).first().b == 20.0
    p = put(tmp_path, "HISTORY", "title\n 2 1 2\n" + "".join(f"timestep {s} 2 2 1 0.001 {s / 10}\n10 0 0\n0 10 0\n0 0 10\nNa 2\n4 5 6\n1 1 1\n7 8 9\nCl 1\n{s} 2 3\n0 0 0\n-1 -2 -3\n" for s in (10, 20)))
    got = R.read_dlpoly_history(spark, p).orderBy("frame_index", "atom_index").collect()
    assert [(r.frame_index, r.step, r.time, r.name, r.x, r.vx, r.fz) for r in got] == [(f, s, s / 10, n, x, v, z) for f, s in ((0, 10), (1, 20)) for n, x, v, z in (("Cl", s, 0, -3), ("Na", 4, 1, 9))]
    assert R.read_dlpoly_history_box(spark, p).count() == 2
    p = put(tmp_path, "b.xml", '<x><box lx="10" ly="20" lz="30" xy="0" xz="0" yz="0"/><position>1 2 3 4 5 6</position><bond>A-B 0 1\nB-B 1 1</bond><angle>t 0 1 0</angle></x>')
    assert rows(R.read_hoomd_groups(spark, p), "kind", "members", order="i") == [("A-B", [0, 1]), ("B-B", [1, 1])]
    assert R.read_hoomd_groups(spark, p, "angle").first().members == [0, 1, 0] and R.read_hoomd_box(spark, p).first().b == 20.0
    p = put(tmp_path, "c.mol2", "@<TRIPOS>MOLECULE\nx\n 3 0\n@<TRIPOS>ATOM\n 1 CA 1.0 2.0 3.0 C.3\n@<TRIPOS>CRYSIN\n 10 20 30 90 80 70 1 1\n")
    assert R.read_mol2_box(spark, p).first().beta == 80.0 and [tuple(r)[1:] for r in R.check_mol2(spark, p).collect()] == [("ATOM", 3, 1)]
