"""Pairing by id, nearest images in any cell, residues over ranges, components of any shape."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.functions.vectors import Box, Vec
from orbitframe.operators import neighbors, topology
from orbitframe.sources import sections
from orbitframe.universe import Universe


def test_frames_meet_the_topology_by_id(spark):
    atoms = spark.createDataFrame([(0, 6, "A"), (1, 5, "B"), (2, 9, "C")], "atom_index long, id long, name string")
    schema = "frame_index int, atom_index long, id long, x double, y double, z double"
    frames = spark.createDataFrame([(f, k, i, float(i), float(f), 0.0) for f in (0, 1) for k, i in enumerate((5, 6, 9))], schema)
    got = sorted((r.frame_index, r.atom_index, r.x) for r in Universe.from_topology(atoms, frames, ids=True).coords.collect())
    assert got == [(f, k, x) for f in (0, 1) for k, x in ((0, 6.0), (1, 5.0), (2, 9.0))]
    for ids in ((5, 6, 7), (5, 6, 6), (5, 6), (5, 6, 9, 9), (5, 6, None), ()):
        other = frames.where("frame_index = 0").union(spark.createDataFrame([(1, k, i, 0.0, 0.0, 0.0) for k, i in enumerate(ids)] or [(1, 0, 77, 0.0, 0.0, 0.0)], schema))
        with pytest.raises(Exception, match="frame 1 has other atoms than the topology"):
            sections.attach(atoms, other, ids=True).collect()
    with pytest.raises(Exception, match="other atoms than the topology"):
        sections.attach(atoms.union(atoms.where("id = 5").selectExpr("3L", "id", "name")), frames, ids=True).collect()


def test_id_sets_with_one_sum_of_hashes(spark):
    """Two pairs of ids whose 32-bit hashes have the same sum are still told apart."""
    from collections import defaultdict

    hashes = [r.h for r in spark.range(3000).select(F.hash("id").alias("h")).collect()]
    met = defaultdict(list)
    pair = None
    for a, b in itertools.combinations(range(3000), 2):
        s = hashes[a] + hashes[b]
        if s in met and not {a, b} & set(met[s][0]):
            pair = met[s][0], (a, b)
            break
        met[s].append((a, b))
    assert pair
    atoms = spark.createDataFrame([(k, i) for k, i in enumerate(pair[0])], "atom_index long, id long")
    frames = spark.createDataFrame([(0, k, i, 0.0, 0.0, 0.0) for k, i in enumerate(pair[1])], "frame_index int, atom_index long, id long, x double, y double, z double")
    with pytest.raises(Exception, match="other atoms than the topology"):
        sections.attach(atoms, frames, ids=True).collect()


CELLS = [(5, 20, 20, 90, 90, 40), (1, 20, 20, 90, 90, 30), (3, 9, 12, 100, 50, 70), (10, 10, 10, 60, 60, 60), (2, 30, 9, 80, 60, 35), (7, 7, 7, 109, 109, 109)]


@pytest.mark.parametrize("cell", CELLS)
def test_nearest_image_in_any_cell(spark, cell):
    box, rng = Box(*map(float, cell)), np.random.default_rng(3)
    v = np.array(box.vectors())
    d = rng.normal(size=(60, 3)) * 6
    rows = spark.createDataFrame(d.tolist(), "x double, y double, z double")
    near = box.nearest(Vec(F.col("x"), F.col("y"), F.col("z")))
    got = np.array([tuple(r) for r in rows.select("x", "y", "z", near.x, near.y, near.z).collect()])
    steps = [range(-math.ceil(60 / h), math.ceil(60 / h) + 1) for h in box.heights()]
    shifts = np.array(list(itertools.product(*steps))) @ v
    for row in got:
        best = np.sqrt(((row[:3] + shifts) ** 2).sum(1).min())
        assert np.linalg.norm(row[3:]) == pytest.approx(best, abs=1e-9)
        whole = (row[:3] - row[3:]) @ np.linalg.inv(v)
        assert np.allclose(whole, np.round(whole), atol=1e-9)


def test_pairs_in_a_needle(spark):
    box, rng = Box(1.0, 20.0, 20.0, 90.0, 90.0, 30.0), np.random.default_rng(1)
    p = rng.random((60, 3)) * (1, 8, 8)
    atoms = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "atom_index long, x double, y double, z double")
    v = np.array(box.vectors())
    shifts = np.array(list(itertools.product(range(-40, 41), (-1, 0, 1), (-1, 0, 1)))) @ v
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if ((p[j] - p[i] + shifts) ** 2).sum(1).min() <= 1.44}
    assert {(r.i, r.j) for r in neighbors.self_pairs_within(atoms, 1.2, box=box).collect()} == want


@pytest.mark.parametrize("cell", [(2, 10, 10, 90, 30, 40), (5, 5, 5, 60, 60, 120), (5, 5, 5, 120, 120, 120), (1, 1, 1, 170, 170, 170), (0, 1, 1, 90, 90, 90), (1, 1, float("nan"), 90, 90, 90), (1, 1, 1, 180, 90, 90)])
def test_cells_without_volume_are_refused(cell):
    with pytest.raises(ValueError):
        Box(*map(float, cell))


def test_one_segment_is_looked_through_in_many_tasks(spark):
    rng = random.Random(5)
    rows, resid = [], 1
    for k in range(4000):
        resid += rng.random() < 0.2
        if rng.random() < 0.98:
            rows.append((k, resid, rng.choice("AB") if rng.random() < 0.02 else "A", "S", None))
    want, before, index = {}, None, -1
    for r in rows:
        if before is None or r[0] != before[0] + 1 or r[1:] != before[1:]:
            index, start = index + 1, r[0]
        want[r[0]], before = (index, start), r
    atoms = spark.createDataFrame(rows, "atom_index long, resid int, resname string, segid string, insertion_code string").repartition(3)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = topology.residues(atoms)
        assert {r.atom_index: (r.residue_index, r.residue_start) for r in held.collect()} == want
        sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert topology.residues(atoms.limit(0)).count() == 0


def components(n, links):
    label = list(range(n))

    def find(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {k: find(k) for k in range(n)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "two stars", "none"])
def test_fragments_of_any_shape(spark, shape):
    rng, n = random.Random(2), 400
    links = {"chain": [(k, k + 1) for k in range(n - 1)], "star": [(n - 1, k) for k in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(300)], "two stars": [(199, k) for k in range(0, 199)] + [(399, k) for k in range(200, 399)] + [(150, 250)], "none": []}[shape]
    order = list(range(n))
    rng.shuffle(order)
    links = [(order[a], order[b]) for a, b in links]
    atoms = spark.range(n).withColumnRenamed("id", "atom_index")
    bonds = spark.createDataFrame([*links, *links[:5], (3, 3), (5, 9999)], "atom1 long, atom2 long")
    for hub in (1_000_000, 7):  # the second splits every key of more than seven rows
        assert {r.atom_index: r.fragment for r in topology.fragments(atoms, bonds, hub).collect()} == components(n, links)


def test_a_star_of_100000_atoms(spark):
    n = 100_000
    atoms = spark.range(n).withColumnRenamed("id", "atom_index")
    bonds = spark.range(n - 1).select(F.lit(n - 1).cast("long").alias("atom1"), F.col("id").alias("atom2"))
    got = topology.fragments(atoms, bonds, hub=10_000)
    assert got.agg(F.count("*"), F.max("fragment")).first() == (n, 0)
    pairs = bonds.select(F.col("atom1").alias("key"), F.col("atom2").alias("other"))
    parts = topology._with_least(pairs, 10_000)
    assert parts.agg(F.count("*"), F.max("least")).first() == (n - 1, 0)
