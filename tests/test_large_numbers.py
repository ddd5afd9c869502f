"""Numbers and labels beyond the columns of a format: they are written in its wider form and read back."""

from pyspark.sql import functions as F

from orbitframe.sources import sections, structures

TOPS = (0, 9_998, 99_998, 99_999, 124_999, 125_000, 4_999_999, 43_770_014, 43_770_015, 43_770_016)


def _atoms(spark):
    at = F.col("atom_index")
    rows = spark.createDataFrame([(k,) for k in TOPS], "atom_index long")
    return rows.select("atom_index", F.lit("CA").alias("name"), F.lit("ALA").alias("resname"), F.lit("A").alias("chain_id"), F.least(F.floor(at / 5) + 1, F.lit(2_000_000)).alias("resid"), F.concat(F.lit("S"), F.floor(at / 125).cast("string")).alias("segid"), F.lit("C").alias("element"), *(F.lit(v).alias(c) for c, v in zip("xyz", (1.5, -2.5, 3.0))))


def test_pdb_serials_residues_and_segments(spark, tmp_path):
    atoms, path = _atoms(spark), str(tmp_path / "a.pdb")
    lines = structures.pdb_lines(atoms)
    assert {len(r.value) for r in lines.collect()} == {80}
    structures.write_lines(lines, path, "atom_index")
    want = sorted((r.atom_index + 1, r.resid, r.segid, r.x) for r in atoms.collect())
    assert sorted((r.serial, r.resid, r.segid, r.x) for r in structures.read_pdb(spark, path).collect()) == want


def test_conect_of_large_serials(spark, tmp_path):
    path = str(tmp_path / "b.pdb")
    bonds = spark.createDataFrame(list(zip(TOPS, TOPS[1:])), "atom1 long, atom2 long")
    atoms = structures.pdb_lines(_atoms(spark)).select(F.lit(0).alias("part"), F.col("atom_index").alias("n"), "value")
    links = structures.conect_lines(bonds).select(F.lit(1).alias("part"), F.col("atom1").alias("n"), "value")
    structures.write_lines(atoms.union(links), path, "part", "n")
    got = {(r.atom1, r.atom2) for r in structures.read_pdb_bonds(spark, path).collect()}
    assert got == {(k, k + 1) for k in range(len(TOPS) - 1)}


def test_crd_takes_the_layout_with_room(spark, tmp_path):
    for low, wide in ((0, False), (99_999, True), (125_000, True)):
        atoms, path = _atoms(spark).where(F.col("atom_index").isin(0, low)), str(tmp_path / f"{low}.crd")
        count, extended = sections.crd_head(atoms)
        assert extended == wide
        structures.write_lines(sections.crd_lines(atoms, extended=extended, digits=5), path, "atom_index", head=["* t", "*", count])
        got = sorted((r.resid, r.segid, r.x) for r in sections.read_crd(spark, path).collect())
        assert got == sorted((r.resid, r.segid, r.x) for r in atoms.collect())
    assert sections.crd_head(atoms.where("atom_index < 0")) == ("0", False)
