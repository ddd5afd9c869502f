"""Molecule-type topologies and program logs."""

import pytest

from orbitframe.sources import gamess, gromacs

TOP = """; a comment
#include "forcefield.itp"
#define HEAVY
[ atomtypes ]
 CT  6  12.011  0.10  A  0.3 0.4   ; with number
 HC  HC 1  1.008  0.05  A  0.1 0.2
 OW  16.0 -0.8 A 0.3 0.6
[ moleculetype ]
 Mol 3
[ atoms ]
 1 CT 1 ALA CA 1
 2 HC 1 ALA HA 1 0.25
#ifdef FLEX
 3 HC 2 ALA HB 1 0.5 2.0
#else
 3 HC 2 ALA HX 1 0.5 3.0
#ifndef FLEX
#if HEAVY
 4 CT 2 ALA HY 1 0.5 4.0
#endif
#endif
#endif
[ bonds ]
 1 2 1 0.1
 1 2 2
[ constraints ]
 2 3 1
[ angles ]
 1 2 3 1
[ dihedrals ]
 1 2 3 3 9
 3 2 1 3 2
[ moleculetype ]
 SOL 2
[ atoms ]
 10 OW 1 SOL OW 1
 20 CT 1 SOL LP 1
[ bonds ]
 10 20 1
 10 99 1
[ settles ]
 1 1 0.1 0.16
[ system ]
 two kinds
[ molecules ]
 Mol 2
 SOL 3
 Mol 1
"""


def test_topology(spark, tmp_path):
    path = tmp_path / "a.top"
    path.write_text(TOP)
    rows = gromacs.read_itp(spark, str(path), {"HEAVY": "1"})
    got = sorted(tuple(r) for r in gromacs.itp_atoms(rows).select("molecule", "atom_index", "name", "charge", "mass").collect())
    assert got == [("Mol", 0, "CA", 0.1, 12.011), ("Mol", 1, "HA", 0.25, 1.008), ("Mol", 2, "HX", 0.5, 3.0), ("Mol", 3, "HY", 0.5, 4.0), ("SOL", 0, "OW", -0.8, 16.0), ("SOL", 1, "LP", 0.1, 12.011)]
    other = gromacs.read_itp(spark, str(path), {"FLEX": "1"})
    assert [r.name for r in gromacs.itp_atoms(other).where("molecule = 'Mol'").orderBy("atom_index").collect()] == ["CA", "HA", "HB"]
    assert sorted(map(tuple, gromacs.itp_groups(rows, "bonds").select("molecule", "atom1", "atom2", "function").collect())) == [("Mol", 1, 2, 1), ("Mol", 2, 3, 1), ("SOL", 10, 20, 1), ("SOL", 10, 99, 1)]
    assert [r.function for r in gromacs.itp_groups(rows, "dihedrals").collect()] == [9] and [r.function for r in gromacs.itp_groups(rows, "impropers").collect()] == [2]
    assert gromacs.itp_groups(rows, "settles").first().oh == "0.1"
    atoms = gromacs.system_atoms(rows).orderBy("atom_index").collect()
    assert [r.atom_index for r in atoms] == list(range(18))
    assert [r.molecule_number for r in atoms] == [1] * 4 + [2] * 4 + [3, 3, 4, 4, 5, 5] + [6] * 4
    assert [r.resid for r in atoms] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9]
    assert sorted((r.atom1, r.atom2) for r in gromacs.system_groups(rows).collect()) == [(0, 1), (1, 2), (4, 5), (5, 6), (8, 9), (10, 11), (12, 13), (14, 15), (15, 16)]
    assert [(r.atom1, r.atom3) for r in gromacs.system_groups(rows, "angles").orderBy("atom1").collect()] == [(0, 2), (4, 6), (14, 16)]
    alone = tmp_path / "b.itp"
    alone.write_text(TOP.split("[ system ]")[0])
    assert gromacs.system_atoms(gromacs.read_itp(spark, str(alone), {"HEAVY": "1"})).count() == 6
    deep = tmp_path / "c.itp"
    deep.write_text("#ifdef A\n" * 9 + "[ atoms ]\n 1 CT 1 ALA CA 1\n" + "#endif\n" * 9)
    assert gromacs.read_itp(spark, str(deep)).count() == 0 and gromacs.read_itp(spark, str(deep), {"A": "0"}).count() == 1


def test_includes_and_names(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "ff").mkdir()
    files = {
        "a.top": '#define SIZE 0.25 7.5 ; of what follows\n#include "mol.itp"\n#include "lib/water.itp"\n#include "nowhere.itp"\n#ifdef SEEN\n#undef SIZE\n#endif\n[ moleculetype ]\nLast 1\n[ atoms ]\n 1 CT 1 L \\\n A 1 SIZE\n#include <shared.itp>\n[ system ]\nx\n[ molecules ]\nMol 1\nSOL 2\n',
        "mol.itp": "[ moleculetype ]\nMol 3\n[ atoms ]\n#include \"lib/atoms.itp\"\n 2 CT 1 ALA CB 1 KEPT\n#include \"lib/atoms.itp\"\n",
        "lib/atoms.itp": "#ifndef FIRST\n#define FIRST\n 1 CT 1 ALA CA 1 SIZE\n#else\n 3 CT 1 ALA CC 1 FIRST\n#endif\n#define SEEN\n#define KEPT 99\n",
        "lib/water.itp": "#include \"../lib/more.itp\"\n[ moleculetype ]\nSOL 2\n[ atoms ]\n 1 OW 1 SOL OW 1\n 2 HW 1 SOL H1 1\n 3 HW 1 SOL H2 1\n#if WET\n 4 HW 1 SOL H3 1\n#endif\n[ bonds ]\n 1 2 1\n[ settles ]\n 1 1 0.1 0.16\n",
        "lib/more.itp": "; nothing but\n#define WET false\n",
        "ff/shared.itp": " 2 CT 1 L B 1 0.5\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = gromacs.read_itp(spark, str(tmp_path / "a.top"), {"KEPT": "0.75"}, include_dirs=(str(tmp_path / "ff"),))
    got = sorted((r.molecule, r.atom_index, r.name, r.charge, r.mass) for r in gromacs.itp_atoms(rows).collect())
    assert got == [("Last", 0, "A", None, None), ("Last", 1, "B", 0.5, None), ("Mol", 0, "CA", 0.25, 7.5), ("Mol", 1, "CB", 0.75, None), ("Mol", 2, "CC", 1.0, None)] + [("SOL", k, n, None, None) for k, n in enumerate(("OW", "H1", "H2"))]
    assert {r.file.rsplit("/", 1)[1] for r in rows.select("file").distinct().collect()} == {"a.top"}
    bonds = [(r.atom1, r.atom2, r.function) for r in gromacs.system_groups(rows).orderBy("atom1", "atom2").collect()]
    assert bonds == [(3, 4, 1), (3, 5, 1), (6, 7, 1), (6, 8, 1)]
    wet = gromacs.read_itp(spark, str(tmp_path / "a.top"), {"WET": "yes"})
    assert gromacs.itp_atoms(wet).where("molecule = 'SOL'").count() == 4


@pytest.mark.parametrize("text, why", [('#include "b.itp"\n', "includes itself"), ("#else\n", "conditionals"), ("#ifdef A\n#else\n#else\n#endif\n", "conditionals"), ("#ifdef A\n", "conditionals"), ("#endif\n", "conditionals"), ("#include b.itp\n", "quoted")])
def test_directives_that_are_errors(spark, tmp_path, text, why):
    (tmp_path / "a.itp").write_text(text)
    (tmp_path / "b.itp").write_text('#include "a.itp"\n')
    with pytest.raises(ValueError, match=why):
        gromacs.read_itp(spark, str(tmp_path / "a.itp"))


HEAD = """ INPUT CARD> $CONTRL RUNTYP=ENERGY $END
 RUNTYP={run}
 TOTAL NUMBER OF ATOMS = 2
 ATOM      ATOMIC                      COORDINATES (BOHR)
           CHARGE         X                   Y                   Z
 O           8.0     0.0 0.0 1.0D-01
 H           1.0     0.0 0.0 2.0

 H           1.0     9.0 9.0 9.0
"""


def test_logs(spark, tmp_path):
    step = "1NSERCH=  {k}\n COORDINATES OF ALL ATOMS ARE (ANGS)\n   ATOM   CHARGE       X              Y              Z\n ------------------------\n O 8.0 0.5 0.0 {k}\n H 1.0 1.5 0.0 {k}\n\n junk 1 2 3 4\n"
    path = tmp_path / "o.log"
    path.write_text(HEAD.format(run="OPTIMIZE") + "".join(step.format(k=k) for k in range(3)))
    assert sorted((r.atom_index, r.name, r.charge) for r in gamess.read_gamess_atoms(spark, str(path)).collect()) == [(0, "O", 8.0), (1, "H", 1.0)]
    got = sorted((r.frame_index, r.atom_index, r.name, r.x, r.z) for r in gamess.read_gamess(spark, str(path)).collect())
    assert got == [(k, a, n, x, float(k)) for k in range(3) for a, n, x in ((0, "O", 0.5), (1, "H", 1.5))]
    scan = " COORD 1= 1.0 COORD 2= 2.0\n HAS ENERGY VALUE -1.5\n O 0.5 0.0 {k}\n H 1.5 0.0 {k}\n"
    path = tmp_path / "s.log"
    path.write_text(HEAD.format(run="surface") + "".join(scan.format(k=k) for k in range(2)))
    got = sorted((r.frame_index, r.atom_index, r.name, r.z) for r in gamess.read_gamess(spark, str(path)).collect())
    assert got == [(k, a, n, float(k)) for k in range(2) for a, n in ((0, "O"), (1, "H"))]
