"""Hand-made cases: conventions, edge cases and numbers known beforehand."""

import math

import pytest
from pyspark.sql import functions as F

from orbitframe.functions import chemistry, units
from orbitframe.functions.vectors import Box, Vec, angle, dihedral, dihedral_atan2, rotation
from orbitframe.operators import aggregates, fitting, neighbors, selection, timeseries, topology, transforms
from orbitframe.sources import structures
from orbitframe.sources.checkpoints import ensure_checkpoints
from orbitframe.streaming.frames import centers_of_arriving_frames


def v(*p):
    return Vec(*map(F.lit, map(float, p)))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def frame(spark, points):
    rows = [(0, k, *map(float, p)) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "frame_index int, atom_index long, x double, y double, z double")


def test_angles(spark):
    assert one(spark, angle(v(1, 0, 0), v(0, 2, 0))) == pytest.approx(math.pi / 2)
    assert one(spark, angle(v(0, 0, 0), v(0, 2, 0))) == 0
    cis = v(0, 1, 0), v(1, 0, 0), v(0, -1, 0)
    assert one(spark, dihedral(*cis)) == pytest.approx(0) or abs(one(spark, dihedral(*cis))) == pytest.approx(math.pi)
    assert one(spark, dihedral(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0))) == 0
    assert math.isnan(one(spark, dihedral_atan2(v(0, 0, 0), v(1, 0, 0), v(1, 0, 0), v(2, 1, 0))))


def test_box():
    assert Box(5, 6, 7).volume() == 210 and Box(5, 6, 7).vectors()[2] == [0, 0, 7]
    for bad in ((0, 1, 1), (1, math.nan, 1), (1, 1, 1, 180, 90, 90)):
        with pytest.raises(ValueError):
            Box(*bad)
    assert rotation(1.0, (0, 0, 0)) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_units():
    assert units.factor("nm", "Angstrom ") == 10 and units.factor("kcal/mol", "kj/mol") == 4.184
    for pair in (("nm", "ps"), ("x", "nm")):
        with pytest.raises(ValueError):
            units.factor(*pair)


def test_elements(spark):
    labels = [("CA", None, "C"), ("1HB2", None, "H"), ("CL-", None, "CL"), ("XX", None, "X"), ("XYZ", None, "X"), ("CA", "CA", "C"), ("SOD+", None, "NA"), ("POT1", None, "K"), ("X", "  ", "X"), (None, None, ""), ("OW", "NA+", "NA"), ("", None, "")]
    df = spark.createDataFrame(labels, "name string, kind string, want string")
    for r in df.withColumn("got", chemistry.guess_element(F.col("name"), F.col("kind"))).collect():
        assert r.got == r.want, r
    assert one(spark, chemistry.element_mass(F.lit("cl"))) == 35.45 and one(spark, chemistry.element_mass(F.lit("??"))) is None


def test_globs(spark):
    df = spark.createDataFrame([(x,) for x in ("CA", "CB", "C", "OA", "[A", None)], "name string")
    got = lambda *p: {r.name for r in df.where(selection.matches("name", *p)).collect()}
    assert got("C?") == {"CA", "CB"} and got("[!C]A") == {"OA", "[A"} and got("[^C]A") == {"OA", "[A"} and got("C", "O*") == {"C", "OA"}
    with pytest.raises(ValueError):
        selection.within("resid", (5, 3))
    with pytest.raises(ValueError):
        selection.group(df, {}, "none")


def test_neighbors(spark):
    points = frame(spark, [(0, 0, 0), (1, 0, 0), (4.9, 0, 0), (2.5, 2.5, 2.5)])
    flat = neighbors.self_pairs_within(points, 1.0).collect()
    assert [(r.i, r.j, r.distance) for r in flat] == [(0, 1, 1.0)]
    near = {(r.i, r.j): r.distance for r in neighbors.self_pairs_within(points, 1.2, box=Box(5, 5, 5)).collect()}
    assert near == {(0, 1): 1.0, (0, 2): pytest.approx(0.1), (1, 2): pytest.approx(1.1)}
    wide = {(r.i, r.j) for r in neighbors.self_pairs_within(points, 4.5, box=Box(5, 5, 5)).collect()}
    assert len(wide) == 6  # fewer than three cells a side: every pair once
    with pytest.raises(ValueError):
        neighbors.pairs_within(points, points, -1.0)
    assert neighbors.pairs_within(points.limit(0), points, 1.0).count() == 0


def test_topology(spark):
    ensure_checkpoints(spark)
    atoms = frame(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (5, 5, 5)])
    bonds = spark.createDataFrame([(0, 1), (2, 1), (1, 2), (2, 0), (7, 9)], "atom1 long, atom2 long")
    assert {r.atom_index: r.neighbors for r in topology.adjacency(atoms, bonds).collect()} == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: []}
    assert {r.atom_index: r.fragment for r in topology.fragments(atoms, bonds).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert any(r["first"] == r["last"] for r in topology.dihedral_quads(bonds).collect())  # a ring of three
    chain = spark.range(200).select((F.col("id") + 1).alias("atom1"), F.col("id").alias("atom2"))
    path = spark.range(201).withColumnRenamed("id", "atom_index")
    assert {r.fragment for r in topology.fragments(path, chain).collect()} == {0}


def test_numbers_follow_the_order(spark):
    from orbitframe.operators.numbering import numbered

    df = spark.range(5000).select((F.col("id") * 7 % 5000 * 3).alias("o"))
    assert [r.k for r in numbered(df, "o", "k").orderBy("o").collect()] == list(range(5000))
    assert numbered(df.limit(0), "o", "k").count() == 0


def test_residues_of_interleaved_segments(spark):
    rows = [(0, 1, "ALA", "A"), (1, 1, "ALA", "B"), (2, 1, "ALA", "A"), (3, 2, "ALA", "A"), (4, 2, "ALA", "A")]
    atoms = spark.createDataFrame([(*r, None) for r in rows], "atom_index long, resid int, resname string, segid string, insertion_code string")
    assert {r.atom_index: r.residue_index for r in topology.residues(atoms).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_fit_recovers_a_rotation(spark):
    points = frame(spark, [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3), (1, 1, 1)])
    turned = transforms.translate(transforms.rotate(points, 0.7, (1, 2, 3)), (4, 5, 6))
    fit = fitting.fit_to_reference(turned, points)
    assert fit.first().rmsd == pytest.approx(0, abs=1e-6)
    assert aggregates.rmsd(fitting.apply_fit(turned, fit), points).first().rmsd == pytest.approx(0, abs=1e-9)
    none = fitting.fit_to_reference(points.withColumn("w", F.lit(0.0)), points, weight="w").first()
    assert none.rmsd == 0 and none.translation == [0, 0, 0]


def test_gyration_without_mass_is_unweighted(spark):
    points = frame(spark, [(0, 0, 0), (2, 0, 0)]).withColumn("mass", F.lit(0.0))
    assert aggregates.radius_of_gyration(points).first().rg == 1
    assert aggregates.center_of_mass(points).first().x is None


def test_regression_guards(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert aggregates.linear_regression(flat, "x", "y").first().slope is None
    level = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert aggregates.linear_regression(level, "x", "y").first().r2 == 1
    assert aggregates.exponential_decay(level.withColumn("y", F.col("x") - 1), "x", "y").first().rate is None


def test_survival_and_gaps(spark):
    states = spark.createDataFrame([(0, 1), (1, 1), (3, 1), (0, 2), (1, 2), (2, 2), (3, 2)], "frame int, id int")
    got = {r.tau: r.survival for r in timeseries.survival(states, 2).collect()}
    assert got == {0: 1.0, 1: pytest.approx((1 + 0.5 + 1) / 3), 2: pytest.approx((0.5 + 0.5) / 2)}
    filled = timeseries.fill_gaps(states, 1)
    assert {r.frame for r in filled.where("id = 1").collect()} == {0, 1, 2, 3}


def test_files(spark, tmp_path):
    path = tmp_path / "a.pdb"
    path.write_text("MODEL        1\nATOM      1  CA AALA A   5A     11.104   6.134  -6.504  1.00 20.00      SEGA C  \nENDMDL\nMODEL        2\nATOM      1  CA AALA A   5A     12.104   6.134  -6.504                  SEGA C  \nENDMDL\nEND\n")
    rows = sorted(structures.read_pdb(spark, str(path)).collect(), key=lambda r: r.frame_index)
    assert [(r.frame_index, r.name, r.x, r.occupancy) for r in rows] == [(0, "CA", 11.104, 1.0), (1, "CA", 12.104, None)]
    assert (rows[0].insertion_code, rows[0].segid, rows[0].element) == ("A", "SEGA", "C")
    psf = tmp_path / "b.psf"
    psf.write_text("PSF\n\n       3 !NATOM\n 1 A 1 B C\n\n       3 !NBOND: bonds\n       1       2       2       3\n       1       3\n\n       0 !NTHETA\n")
    assert sorted((r.atom1, r.atom2) for r in structures.read_psf_bonds(spark, str(psf)).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_stream(spark, tmp_path):
    rows = [(0, 1.0, "2024-01-01 00:01:00"), (0, 3.0, "2024-01-01 00:02:00"), (1, 5.0, "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "frame_index int, x double, time string").selectExpr("frame_index", "x", "0.0D as y", "0.0D as z", "cast(time as timestamp) as time")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = centers_of_arriving_frames(stream).writeStream.outputMode("complete").format("memory").queryName("centers").start()
    q.processAllAvailable()
    got = {r.frame_index: (r.n, r.x) for r in spark.table("centers").collect()}
    q.stop()
    assert got == {0: (2, 2.0), 1: (1, 5.0)}


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name in ('corpus_pipeline', 'orbitframe.llm'):\n            raise ModuleNotFoundError(name, name=name)\ndel sys.modules['corpus_pipeline']\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
