from orbitframe.sources import amber


def rows(df, *columns, order=("atom_index",)):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: tuple(r[o] for o in order))]


def test_prmtop(spark, tmp_path):
    def flag(name, form, text):
        return f"%FLAG {name}\n%FORMAT({form})\n{text}\n"

    text = "%VERSION  x\n" + flag("ATOM_NAME", "20a4", "N   CA  O   H1  ") + flag("CHARGE", "5E16.8", "".join(f"{v * 18.2223:16.8E}" for v in (0.5, -0.5, 1.0)) + "\n" + f"{-18.2223:16.8E}")
    text += flag("MASS", "5E16.8", "".join(f"{v:16.8E}" for v in (14.0, 12.0, 16.0, 1.0))) + flag("AMBER_ATOM_TYPE", "20a4", "N   CT  OW  HW  ") + flag("RESIDUE_LABEL", "20a4", "ALA WAT ") + flag("RESIDUE_POINTER", "10I8", "       1       3")
    text += flag("BONDS_INC_HYDROGEN", "10I8", "       6       9       1") + flag("BONDS_WITHOUT_HYDROGEN", "10I8", "       0       3       2")
    path = tmp_path / "a.prmtop"
    path.write_text(text)
    got = rows(amber.read_prmtop_atoms(spark, str(path)), "name", "atom_type", "charge", "mass", "resid", "resname")
    assert [(n, t, round(c, 6), m, i, r) for n, t, c, m, i, r in got] == [("N", "N", 0.5, 14.0, 1, "ALA"), ("CA", "CT", -0.5, 12.0, 1, "ALA"), ("O", "OW", 1.0, 16.0, 2, "WAT"), ("H1", "HW", -1.0, 1.0, 2, "WAT")]
    assert rows(amber.read_prmtop_bonds(spark, str(path)), "atom1", "atom2", order=("atom1",)) == [(0, 1), (2, 3)]


def test_prmtop_angles_and_dihedrals(spark, tmp_path):
    path = tmp_path / "a.prmtop"
    path.write_text("%VERSION\n%FLAG ANGLES_INC_HYDROGEN\n%FORMAT(10I8)\n       0       3       6       1       0       3       6       2\n%FLAG ANGLES_WITHOUT_HYDROGEN\n%FORMAT(10I8)\n       3       6       9       1\n%FLAG DIHEDRALS_WITHOUT_HYDROGEN\n%FORMAT(10I8)\n       0       3      -6       9       1       0       3       6      -9       2\n       0       3       6       9       4\n")
    names = ("atom1", "atom2", "atom3")
    assert rows(amber.read_prmtop_angles(spark, str(path)), *names, order=names) == [(0, 1, 2), (1, 2, 3)]
    assert rows(amber.read_prmtop_dihedrals(spark, str(path)), *names, "atom4", "improper", order=("improper",)) == [(0, 1, 2, 3, False), (0, 1, 2, 3, True)]


def test_mdcrd(spark, tmp_path):
    def frame(low, box):
        v = [low + k for k in range(12)]
        return "".join(f"{x:8.3f}" for x in v[:10]) + "\n" + "".join(f"{x:8.3f}" for x in v[10:]) + "\n" + ("  10.000  10.000  10.000\n" if box else "")

    for box in (False, True):
        path = tmp_path / f"{box}.mdcrd"
        path.write_text("title\n" + frame(0, box) + frame(-100, box))
        got = rows(amber.read_mdcrd(spark, str(path), 4), "frame_index", "atom_index", "x", "y", "z", order=("frame_index", "atom_index"))
        assert got == [(f, k, low + 3 * k, low + 3 * k + 1, low + 3 * k + 2) for f, low in ((0, 0), (1, -100)) for k in range(4)]


def test_gromos(spark, tmp_path):
    one = "TIMESTEP\n{0} {1}\nEND\nPOSITIONRED\n1.0 2.0 3.0\n4.0 5.0 6.0\n#  10\nEND\n"
    path = tmp_path / "a.trc"
    path.write_text("TITLE\nx\nEND\n" + one.format(5, 0.5) + one.format(10, 1.0))
    got = rows(amber.read_gromos(spark, str(path)), "frame_index", "step", "time", "atom_index", "x", order=("frame_index", "atom_index"))
    assert got == [(0, 5, 0.5, 0, 1.0), (0, 5, 0.5, 1, 4.0), (1, 10, 1.0, 0, 1.0), (1, 10, 1.0, 1, 4.0)]
    assert amber.read_gromos_box(spark, str(path)).count() == 0
    path.write_text("TITLE\nx\nEND\n" + (one + "GENBOX\n1\n3.0 4.0 5.0\n90 80 70\n0 0 0\n0 0 0\nEND\n").format(5, 0.5))
    assert rows(amber.read_gromos_box(spark, str(path)), "frame_index", "a", "c", "beta", order=("frame_index",)) == [(0, 3.0, 5.0, 80.0)]
