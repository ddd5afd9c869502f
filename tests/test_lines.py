"""Running values over lines against plain Python, with many blocks a file, and the number of times a reader's plan reads its file."""

import random

import pytest
from pyspark.sql import functions as F

from orbitframe.sources import amber, sections, structures
from orbitframe.sources.lines import scan


@pytest.fixture
def tiny_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(text):
    lines = text.removesuffix("\n").split("\n")
    mark, kind, total, flags, inner = None, None, 0, 0, 0
    out, heads = [], [(k, x) for k, x in enumerate(lines) if x.startswith("x")][:3]
    for n, line in enumerate(lines):
        total += len(line)
        flags += line.startswith("x")
        if line.startswith("#"):
            mark, kind = (line[1:], n, total, flags), line[1:]
        inner += line.startswith("x") and kind in ("a", "c")
        out.append((n, line, total, flags, inner, mark))
    return [(*row, total, heads) for row in out]


@pytest.mark.parametrize("seed", range(4))
def test_scan(spark, tmp_path, tiny_blocks, seed):
    rng = random.Random(seed)
    texts = {}
    for k in range(3):
        lines = [rng.choice(["x1", "yy", "", "x " + "z" * rng.randrange(40), f"#{rng.choice('abc')}"] if rng.random() < 0.6 or k else ["x1", "x22"]) for _ in range(rng.choice((1, 40, 90)))]
        texts[f"f{k}.txt"] = "\n".join(lines) + "\n"
        (tmp_path / f"f{k}.txt").write_text(texts[f"f{k}.txt"])
    line = F.col("line")
    got = scan(spark, str(tmp_path), {"m": F.when(line.startswith("#"), F.substring(line, 2, 9))}, {"total": F.length(line), "flags": line.startswith("x")}, {"inner": ("m", ("a", "c"), line.startswith("x"))}, {"head": (line.startswith("x"), 3)}).collect()
    for name, text in texts.items():
        rows = sorted((r for r in got if r.file.endswith(name)), key=lambda r: r.n)
        assert [(r.n, r.line, r.total, r.flags, r.inner, tuple(r.m) if r.m else None, r.total_total, [tuple(h) for h in r.head]) for r in rows] == brute(text)
    assert len({r.block for r in got}) > 3


def test_readers_go_on_from_block_to_block(spark, tmp_path, tiny_blocks):
    frames = "".join(f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n9\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 20\n-5 5\nITEM: ATOMS id x y z ix iy iz q\n" + "".join(f"{i} {i}.5 {t} 0 1 0 -1 {i * 0.25}\n" for i in (5, 3, 9, 1, 2, 8, 7, 6, 4)) for t in (100, 200, 300))
    (tmp_path / "a.dump").write_text(frames)
    got = sections.read_lammps_dump(spark, str(tmp_path / "a.dump"), unwrap=True, extra=("q",)).orderBy("frame_index", "atom_index").collect()
    assert [(r.frame_index, r.step, r.atom_index, r.id, r.x, r.y, r.z, r.q) for r in got] == [(f, t, i - 1, i, i + 10.5, float(t), -10.0, i * 0.25) for f, t in enumerate((100, 200, 300)) for i in range(1, 10)]
    mol = "".join(f"@<TRIPOS>MOLECULE\nm\n 3 2\n@<TRIPOS>ATOM\n" + "".join(f" {i} C{i} {i}.0 {m} 0.0 C.3 1 ALA 0.5\n" for i in (1, 2, 3)) + "@<TRIPOS>BOND\n 1 1 2 1\n 2 2 3 ar\n" for m in range(5))
    (tmp_path / "a.mol2").write_text(mol)
    path = str(tmp_path / "a.mol2")
    assert sorted((r.atom_index, r.serial, r.y) for r in sections.read_mol2_atoms(spark, path).collect()) == [(3 * m + i - 1, i, float(m)) for m in range(5) for i in (1, 2, 3)]
    assert sorted((r.atom1, r.atom2, r.order) for r in sections.read_mol2_bonds(spark, path).collect()) == sorted((3 * m + k, 3 * m + k + 1, 1 if k == 0 else None) for m in range(5) for k in (0, 1))
    assert sections.check_mol2(spark, path).count() == 0
    (tmp_path / "b.mol2").write_text(mol.replace(" 3 2\n", " 4 2\n", 1))
    assert [(r.section, r.declared, r.found) for r in sections.check_mol2(spark, str(tmp_path / "b.mol2")).collect()] == [("ATOM", 16, 15)]


def test_plans_read_a_file_few_times(spark, tmp_path):
    path = str(tmp_path / "a")
    (tmp_path / "a").write_text("x\n")
    two = [structures.read_pdb, structures.read_pdb_bonds, structures.read_xyz, structures.read_gro, structures.read_gro_box, structures.read_pqr, structures.read_psf_bonds, sections.read_mol2_atoms, sections.read_mol2_bonds, sections.check_mol2, sections.read_psf_atoms, sections.read_crd, sections.read_pdbqt, sections.read_lammps_bonds, sections.read_lammps_dump, sections.read_lammps_dump_box, sections.read_tinker, sections.read_inpcrd, sections.read_inpcrd_box, sections.read_aims, sections.read_aims_box, sections.read_dlpoly_config, sections.read_dlpoly_history, amber.read_gromos_box, lambda s, p: amber.read_mdcrd(s, p, 5)]
    four = [sections.read_lammps_data, amber.read_gromos, amber.read_prmtop_atoms, amber.read_prmtop_bonds]  # two sections joined, or values numbered once more
    for most, readers in ((2, two), (4, four)):
        for reader in readers:
            plan = reader(spark, path)._jdf.queryExecution().executedPlan().toString()
            assert 0 < plan.count("FileScan text") <= most, (reader, plan.count("FileScan text"))
